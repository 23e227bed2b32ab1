"""Audit reports as .docx files, a data source that is written to: one file for each run.

``report_parts`` lays a report out as rows: the pictures of its documents, its head, and one
row for each document in order.  Each task writes the runs it has, row after row, into a
zip of its own attempt; commit moves the files into place and abort removes them, so there
are no halves.  A run is one file, hence one task; memory holds a row at a time.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import IO
from uuid import uuid4
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from auditlake.functions.rounding import shown
from auditlake.operators.report import numbered, result_label, with_page
from auditlake.shared import open_store

# fixed values of the format: name spaces, part names, colours of results
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
GREEN, RED, GREY, SHADE = "0F6E56", "993C1D", "5F5E5A", "E1F5EE"
#: Units of the format in two inches.
TWO_INCHES = 2 * 914_400
PICTURE, HEAD, DOCUMENT = 0, 1, 2


# ---------------------------------------------------------------- rows


def report_parts(report: DataFrame, documents: DataFrame, failed: DataFrame, run: str = "run_id", generated: str = "") -> DataFrame:
    """(run, kind, no, head, document, picture) of the reports of some runs, in the order of no.

    report: one row a run as scoring.report gives it, with elapsed_seconds if known; documents: run, doc_key,
    document_name, passed, score, remarks and preview_base64; failed: run, doc_key, pos and the looked-up items.
    A document's failed rules are as many as a checklist has.
    """
    label = result_label(F.col("overall_result"))
    elapsed = F.col("elapsed_seconds") if "elapsed_seconds" in report.columns else F.lit(0.0)
    lines = F.array(
        F.col("audit_title"), F.lit(f"Generated: {generated}"), F.concat(F.lit("Elapsed: "), shown(elapsed, 1), F.lit("s")), label, F.concat(shown(F.col("overall_score"), 1), F.lit("%")),
        F.concat(F.lit("Prediction interval: "), shown(F.col("lower"), 1), F.lit("% — "), shown(F.col("upper"), 1), F.lit("%")),
        F.format_string("Documents: %d processed, %d passed, %d failed", "documents_processed", "documents_passed", "documents_failed"), F.col("summary"),
    )
    head = report.select(run, F.lit(HEAD).alias("kind"), F.lit(0).cast("long").alias("no"), lines.alias("head"))
    item = F.struct("pos", F.concat_ws(": ", "rule_id", "rule_title").alias("rule"), F.upper("severity").alias("severity"), with_page(F.col("evidence"), F.col("page_number")).alias("evidence"))
    items = failed.groupBy(run, "doc_key").agg(F.sort_array(F.collect_list(item)).alias("failed"))
    placed = numbered(documents, run).join(items, [run, "doc_key"], "left")
    score = F.concat(shown(F.col("score"), 1), F.lit("%"))
    document = F.struct(F.col("document_name").alias("name"), score.alias("score"), "passed", "remarks", (F.col("preview_base64") != "").alias("picture"), F.coalesce("failed", F.array().cast("array<struct<pos:int,rule:string,severity:string,evidence:string>>")).alias("failed"))
    bodies = placed.select(run, F.lit(DOCUMENT).alias("kind"), F.col("no").cast("long").alias("no"), document.alias("document"))
    pictures = placed.where("preview_base64 <> ''").select(run, F.lit(PICTURE).alias("kind"), F.col("no").cast("long").alias("no"), F.unbase64("preview_base64").alias("picture"))
    return head.unionByName(bodies, allowMissingColumns=True).unionByName(pictures, allowMissingColumns=True)


def write_reports(parts: DataFrame, folder: str, run: str = "run_id") -> None:
    """Writes the rows of report_parts as one <run>.docx each."""
    parts.sparkSession.dataSource.register(ReportSink)
    named = parts.select(F.col(run).cast("string").alias("run"), "kind", "no", "head", "document", "picture")
    named.repartition("run").sortWithinPartitions("run", "kind", "no").write.format("docx_report").option("path", folder).mode("append").save()


# ---------------------------------------------------------------- parts of a file


def text_run(text: str | None, bold: bool = False, colour: str | None = None, size: int | None = None) -> str:
    style = "<w:b/>" * bold + (f'<w:color w:val="{colour}"/>' if colour else "") + (f'<w:sz w:val="{2 * size}"/>' if size else "")
    clean = "".join(c for c in text or "" if c >= " " or c in "\t\n")
    return f'<w:r><w:rPr>{style}</w:rPr><w:t xml:space="preserve">{escape(clean)}</w:t></w:r>'


def paragraph(*runs: str, style: str | None = None, centred: bool = False) -> str:
    how = (f'<w:pStyle w:val="{style}"/>' if style else "") + '<w:jc w:val="center"/>' * centred
    return f"<w:p><w:pPr>{how}</w:pPr>{''.join(runs)}</w:p>"


def failed_table(failed: list[Row]) -> str:
    def cell(text: str, head: bool) -> str:
        return f"<w:tc><w:tcPr>{f'<w:shd w:val="clear" w:color="auto" w:fill="{SHADE}"/>' * head}</w:tcPr>{paragraph(text_run(text, head, size=10))}</w:tc>"

    rows = [("Rule", "Severity", "Evidence"), *((x.rule, x.severity, x.evidence) for x in failed)]
    lines = "".join(f"<w:tr>{''.join(cell(x, k == 0) for x in row)}</w:tr>" for k, row in enumerate(rows))
    return f'<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/></w:tblPr><w:tblGrid>{"<w:gridCol/>" * 3}</w:tblGrid>{lines}</w:tbl>'


def picture(no: int, size: tuple[int, int]) -> str:
    high = TWO_INCHES * size[1] // max(1, size[0])
    box = f'<a:graphic><a:graphicData uri="{DRAWING}/picture"><pic:pic><pic:nvPicPr><pic:cNvPr id="{no}" name="{no}.png"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="p{no}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{TWO_INCHES}" cy="{high}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic>'
    return paragraph(f'<w:r><w:drawing><wp:inline><wp:extent cx="{TWO_INCHES}" cy="{high}"/><wp:docPr id="{no}" name="{no}"/>{box}</wp:inline></w:drawing></w:r>')


def head_of(lines: list[str]) -> str:
    title, generated, elapsed, label, score, interval, counts, summary = lines
    colour = {"PASSED": GREEN, "FAILED": RED}.get(label, GREY)
    return "".join(
        [paragraph(text_run(title), style="Title", centred=True), paragraph(text_run(generated), centred=True), paragraph(text_run(elapsed), centred=True), paragraph(), paragraph(text_run("Overall Result"), style="Heading1")]
        + [paragraph(text_run(f"{label}  —  {score}", True, colour, 16)), *(paragraph(text_run(x)) for x in (interval, counts, summary)), paragraph()]
    )


def body_of(no: int, d: Row, size: tuple[int, int] | None) -> str:
    out = [paragraph(text_run(f"{no}. {d.name}"), style="Heading2")]
    if size:
        out += [picture(no, size), paragraph()]
    out.append(paragraph(text_run("Score: ", True), text_run(f"{d.score}    "), text_run("PASS" if d.passed else "FAIL", True, GREEN if d.passed else RED)))
    if d.remarks:
        out.append(paragraph(text_run(f"Remarks: {d.remarks}")))
    if d.failed:
        out += [paragraph(), failed_table(d.failed)]
    return "".join([*out, paragraph()])


def styles() -> str:
    head = lambda name, size: f'<w:style w:type="paragraph" w:styleId="{name}"><w:name w:val="{name}"/><w:rPr><w:b/><w:sz w:val="{2 * size}"/></w:rPr></w:style>'
    grid = "".join(f'<w:{side} w:val="single" w:sz="4"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV"))
    return f'<?xml version="1.0" encoding="UTF-8"?><w:styles xmlns:w="{WORD}"><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Calibri" w:hAnsi="Calibri"/><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults>{head("Title", 26)}{head("Heading1", 16)}{head("Heading2", 13)}<w:style w:type="table" w:styleId="TableGrid"><w:name w:val="Table Grid"/><w:tblPr><w:tblBorders>{grid}</w:tblBorders></w:tblPr></w:style></w:styles>'


def write_file(out, rows: Iterator[Row]) -> None:
    """One report from its rows: pictures, head, documents."""
    sizes: dict[int, tuple[int, int]] = {}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", TYPES)
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{RELATIONS}"><Relationship Id="d" Type="{OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/styles.xml", styles())
        rest = None
        for r in rows:
            if r.kind != PICTURE:
                rest = r
                break
            z.writestr(f"word/media/{r.no}.png", bytes(r.picture), zipfile.ZIP_STORED)
            sizes[r.no] = int.from_bytes(r.picture[16:20]), int.from_bytes(r.picture[20:24])
        with z.open("word/document.xml", "w", force_zip64=True) as doc:
            put = lambda text: doc.write(text.encode())
            put(f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{WORD}" xmlns:r="{OFFICE}" xmlns:wp="{DRAWING}/wordprocessingDrawing" xmlns:a="{DRAWING}/main" xmlns:pic="{DRAWING}/picture"><w:body>')
            while rest is not None:
                put(head_of(rest.head) if rest.kind == HEAD else body_of(rest.no, rest.document, sizes.get(rest.no)))
                rest = next(rows, None)
            put("<w:sectPr/></w:body></w:document>")
        links = "".join(f'<Relationship Id="p{no}" Type="{OFFICE}/image" Target="media/{no}.png"/>' for no in sizes)
        z.writestr("word/_rels/document.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{RELATIONS}"><Relationship Id="s" Type="{OFFICE}/styles" Target="styles.xml"/>{links}</Relationships>')


# ---------------------------------------------------------------- the sink


@dataclass
class Written(WriterCommitMessage):
    """(half, final) names of an attempt's files."""

    files: list[tuple[str, str]] = field(default_factory=list)


class ReportWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid4().hex

    def halves(self) -> str:
        return f"{self.folder.rstrip('/')}/_halves-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, path = open_store(self.halves())
        store.create_dir(path, recursive=True)
        done = Written()
        for run, rows in groupby(iterator, lambda r: r.run):
            half = f"{uuid4().hex}.docx"
            with store.open_output_stream(f"{path}/{half}", compression=None) as out:
                write_file(out, iter(rows))
            done.files.append((half, f"{''.join(c if c.isalnum() or c in '-_. ' else '_' for c in run or 'report')}.docx"))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, path = open_store(self.halves())
        for message in messages:
            for half, name in message.files if message else []:
                store.move(f"{path}/{half}", f"{path.rpartition('/')[0]}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, path = open_store(self.halves())
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_dir(path)


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx_report"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"])


def report_lines(file: IO[bytes]) -> Iterator[tuple[str, str]]:
    """(style, text) of a written report: its pictures, then paragraphs and table rows in order; memory holds a part at a time."""
    from xml.etree import ElementTree

    w = f"{{{WORD}}}"
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    with zipfile.ZipFile(file) as z:
        yield from (("pictures", n) for n in z.namelist() if n.startswith("word/media/"))
        with z.open("word/document.xml") as doc:
            above: list = []
            for event, e in ElementTree.iterparse(doc, ("start", "end")):
                if event == "start":
                    above.append(e)
                    continue
                above.pop()
                if len(above) != 2:  # only what lies in the body itself
                    continue
                if e.tag == f"{w}p":
                    style = e.find(f"{w}pPr/{w}pStyle")
                    yield (style.get(f"{w}val") if style is not None else "plain"), text(e)
                elif e.tag == f"{w}tbl":
                    yield from (("rows", "|".join(text(c) for c in row.iter(f"{w}tc"))) for row in e.iter(f"{w}tr"))
                above[-1].clear()


def read_report(content: bytes) -> dict[str, list[str]]:
    """Texts of a written report by the style of their paragraphs, and of table rows; for tests."""
    import io

    out: dict[str, list[str]] = {"pictures": [], "rows": [], "plain": []}
    for style, line in report_lines(io.BytesIO(content)):
        out.setdefault(style, []).append(line)
    return out
