"""Queries over files that Spark makes of the given tables: folders, PDFs, pictures, audits, reports."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.images import png, thumbnail
from auditlake.functions.names import base_name
from auditlake.functions.pdf import Pdf, page_count
from auditlake.functions.replies import decode_replies
from auditlake.functions.rounding import round_exact
from auditlake.operators import extract
from auditlake.operators import report as reports
from auditlake.operators.references import found_references, similar
from auditlake.operators.scoring import report
from auditlake.plans.audit import run_audit
from auditlake.plans.catalog import query, table
from auditlake.shared import dealt, open_store, shared_path
from auditlake.sources.docx import report_lines, report_parts, write_reports
from auditlake.sources.files import own_rules, scan_folder, write_files
from auditlake.sources.folder import register

#: Suffixes of every kind and case, and some that are no documents.
SCANNED = (".pdf", ".PNG", ".jpg", ".JpEg", ".tif", ".TIFF", ".bmp", ".txt", ".docx", "")


@query(f"""
WITH f AS (SELECT replace(n_name, ' ', '_') || (CAST({list(SCANNED)} AS VARCHAR[]))[n_nationkey % {len(SCANNED)} + 1] AS document_name, CAST(length(n_name) * (n_regionkey + 1) AS BIGINT) AS bytes FROM nation)
SELECT document_name, 'ok' AS status, bytes > 20 AS passed, CAST(least(100, bytes) AS DOUBLE) AS score FROM f
WHERE regexp_matches(lower(document_name), '\\.(pdf|png|jpg|jpeg|tiff|tif|bmp)$')""")
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder filled from a table: files of every suffix and case, read and judged by their size."""
    name = F.concat(F.replace("n_name", F.lit(" "), F.lit("_")), F.element_at(F.array(*map(F.lit, SCANNED)), (F.col("n_nationkey") % len(SCANNED) + 1).cast("int")))
    content = F.repeat("n_name", (F.col("n_regionkey") + 1).cast("int")).cast("binary")
    folder = shared_path(spark, "scan")
    write_files(table(spark, sf_dir, "nation").select(name.alias("name"), content.alias("content")), folder)
    judged = lambda path, content: f'{{"passed": {str(len(content) > 20).lower()}, "score": {min(100, len(content))}}}'
    d = decode_replies(extract.extracted(scan_folder(spark, folder), judged))
    return d.select(base_name(F.col("doc_key")).alias("document_name"), "status", "passed", "score")


@query("SELECT 'page-' || page_id AS doc_key, 'ok' AS status, octet_length(encode(coalesce(html, ''))) > 2000 AS passed, CAST(least(100, octet_length(encode(coalesce(html, ''))) // 100) AS DOUBLE) AS score FROM pages")
def extractor_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the place of files, read by a function that judges their size."""
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))

    def read(path: str, content: bytes) -> str:
        return f'{{"passed": {str(len(content) > 2000).lower()}, "score": {min(100, len(content) // 100)}}}'

    return decode_replies(extract.extracted(files, read)).select("doc_key", "status", "passed", "score")


@query("""SELECT 'page-' || page_id AS doc_key, CAST(p AS INTEGER) AS page_no, CAST(least(1000, n - (p - 1) * 1000) AS INTEGER) AS bytes
 FROM (SELECT page_id, n, unnest(range(1, least(10, (n + 999) // 1000) + 1)) AS p FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n FROM pages))""")
def page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ten pages of each file, with 1000 bytes in the place of a page."""
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))

    def render(path: str, content: bytes):
        for at in range(0, len(content), 1000):
            yield content[at : at + 1000]

    return extract.rendered_pages(files, render).select("doc_key", "page_no", F.length("image").alias("bytes"))


# ---------------------------------------------------------------- folders


#: Names of the files made of pages: hidden ones, some in subfolders, some of no document.
PAGE_NAMES = ("page-{}.pdf", ".hidden-{}.PNG", "_draft-{}.jpg", "day=1/in-{}.pdf", "scan.{}.tar.bmp", "note-{}.txt", ".pdf-{}", "P{}.TIFF")
PAGE_NAME_SQL = "replace((CAST(" + str(list(PAGE_NAMES)) + " AS VARCHAR[]))[page_id % 8 + 1], '{}', CAST(page_id AS VARCHAR))"
PAGE_TEXT_SQL = "CASE WHEN page_id % 5 = 0 THEN '' ELSE coalesce(html, '') END"


def page_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each page; every fifth is empty."""
    name = F.replace(F.element_at(F.array(*map(F.lit, PAGE_NAMES)), (F.col("page_id") % 8 + 1).cast("int")), F.lit("{}"), F.col("page_id").cast("string"))
    content = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.coalesce("html", F.lit(""))).cast("binary")
    folder = shared_path(spark, "pages")
    write_files(table(spark, sf_dir, "pages").select(name.alias("name"), content.alias("content")), folder)
    return folder


@query(rf"""WITH f AS (SELECT {PAGE_NAME_SQL} AS document_name, CAST(octet_length(encode({PAGE_TEXT_SQL})) AS BIGINT) AS length, sha256({PAGE_TEXT_SQL}) AS sha FROM pages)
SELECT document_name, lower(regexp_extract(document_name, '(\.[^.]*)$', 1)) AS ext, length, sha, CAST(row_number() OVER (ORDER BY document_name) AS INTEGER) AS no FROM f
WHERE NOT contains(document_name, '/') AND regexp_matches(lower(document_name), '.\.(pdf|png|jpg|jpeg|tiff|tif|bmp)$')""")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of a folder, hidden and empty ones too, numbered in order of its path; subfolders are left out."""
    files = scan_folder(spark, page_files(spark, sf_dir), strict=True)
    files = files.select("path", "document_name", "ext", "length", F.sha2("content", 256).alias("sha"), F.lit("run").alias("run_id"))
    return reports.numbered(files, by="path").select("document_name", "ext", "length", "sha", "no")


# ---------------------------------------------------------------- PDFs and pictures


def made_pdf(pages: int) -> bytes:
    """A PDF with so many pages, two to a node of its tree, each a little wider."""
    out, places = b"%PDF-1.4\n", []

    def put(body: bytes) -> int:
        nonlocal out
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (len(places), body)
        return len(places)

    leaves = [put(b"<< /Type /Page /MediaBox [0 0 %d 200] >>" % (100 + k)) for k in range(pages)]
    nodes = [put(b"<< /Type /Pages /Kids [%s] /Rotate 90 >>" % b" ".join(b"%d 0 R" % x for x in leaves[k : k + 2])) for k in range(0, pages, 2)]
    tree = put(b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % x for x in nodes), pages))
    root = put(b"<< /Type /Catalog /Pages %d 0 R >>" % tree)
    table = b"".join(b"%010d 00000 n\r\n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f\r\n%strailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(places) + 1, table, len(places) + 1, root, len(out))


def page_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, ext, content): a PDF of 0 to 12 pages for each page of the table, some cut off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                keys = batch.column(0).slice(lo, 1000).to_pylist()
                made = [made_pdf(k % 13) for k in keys]
                cut = [x[: len(x) // 2] if k % 17 == 0 else x for k, x in zip(keys, made, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([f"/in/{k}.pdf" for k in keys]), pa.array([".pdf"] * len(keys)), pa.array(cut, pa.binary())], ["path", "ext", "content"])

    return dealt(table(spark, sf_dir, "pages").select("page_id"), "page_id").mapInArrow(run, "path string, ext string, content binary")


@query("SELECT '/in/' || page_id || '.pdf' AS doc_key, CAST(CASE WHEN page_id % 17 = 0 THEN 1 ELSE page_id % 13 END AS INTEGER) AS page_count FROM pages")
def pdf_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages counted in the tree of every PDF, not capped; 1 for those that are damaged."""
    return extract.page_counts(page_pdfs(spark, sf_dir), page_count)


@query("""SELECT '/in/' || page_id || '.pdf' AS doc_key, CAST(p AS INTEGER) AS page_no, CAST(99 + p AS DOUBLE) AS width, 200.0::DOUBLE AS height, 90 AS rotation
 FROM (SELECT page_id, unnest(range(1, least(10, page_id % 13) + 1)) AS p FROM pages WHERE page_id % 17 <> 0)""")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten pages of every PDF with their size, which they may have from the tree above them."""

    def boxes(path: str, content: bytes | None):
        for width, height, rotation in Pdf(content).pages():
            yield f"{width!r} {height!r} {rotation}".encode()

    size = F.split(F.col("image").cast("string"), " ")
    pages = extract.rendered_pages(page_pdfs(spark, sf_dir), boxes)
    return pages.select("doc_key", "page_no", *[size[k].cast(kind).alias(c) for k, (c, kind) in enumerate((("width", "double"), ("height", "double"), ("rotation", "int")))])


@query("""WITH s AS (SELECT page_id, 40 + page_id % 400 AS w, 30 + page_id * 7 % 300 AS h FROM pages),
t AS (SELECT *, least(1.0::DOUBLE, 180.0::DOUBLE / greatest(w, h)) AS k FROM s)
SELECT page_id, CAST(greatest(1, round_even(w * k, 0)) AS INTEGER) AS width, CAST(greatest(1, round_even(h * k, 0)) AS INTEGER) AS height, CAST(page_id % 256 AS INTEGER) AS red FROM t WHERE page_id % 9 <> 0
UNION ALL SELECT page_id, NULL, NULL, NULL FROM t WHERE page_id % 9 = 0""")
def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of at most 180 pixels a side of a BMP for each page; none of those that are cut off."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from base64 import b64decode

        for batch in batches:
            rows = []
            for page in batch["page_id"].tolist():
                w, h = 40 + page % 400, 30 + page * 7 % 300
                line = bytes([9, 99, page % 256]) * w
                body = (line + b"\0" * (-len(line) % 4)) * h
                image = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body
                small = thumbnail(image[: len(image) // 2] if page % 9 == 0 else image)
                shape = png(b64decode(small)) if small else None
                rows.append((page, *((shape.shape[1], shape.shape[0], int(shape[0, 0, 0])) if small else (None,) * 3)))
            yield pd.DataFrame(rows, columns=["page_id", "width", "height", "red"]).astype({c: "Int32" for c in ("width", "height", "red")})

    return table(spark, sf_dir, "pages").select("page_id").mapInPandas(run, "page_id long, width int, height int, red int")


# ---------------------------------------------------------------- audits of files


TURNS_SQL = "(SELECT conv_id, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes, count(*) AS turns FROM conversations GROUP BY conv_id)"
#: A conversation is an invoice with many turns, else a receipt; long ones fail a rule, and every seventh is beyond the reader.
AUDITED_SQL = f"""(SELECT 'c' || conv_id || '.pdf' AS document_name, CASE WHEN turns > 6 THEN 'invoice' ELSE 'receipt' END AS document_type, bytes, conv_id % 7 = 0 AS broken,
 bytes > 1000 AS long, CAST(least(100, 12 + turns) AS DOUBLE) AS score FROM {TURNS_SQL})"""


def conversation_audit(spark: SparkSession, sf_dir: str):
    """An audit of a file for each conversation, by a reader that uses the summary and the rules it is given."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"), F.count(F.lit(1)).alias("turns"))
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".pdf"))
    folder, rules = shared_path(spark, "conversations"), shared_path(spark, "rules")
    write_files(turns.select(name.alias("name"), F.to_json(F.struct("conv_id", "bytes", "turns")).cast("binary").alias("content")), folder)
    write_files(spark.createDataFrame([("rules.md", bytearray(own_rules().encode()))], "name string, content binary"), rules)

    def summarize(path: str, content: bytes) -> str:
        x = json.loads(content)
        return json.dumps({"document_type": "invoice" if x["turns"] > 6 else "receipt", "summary": f"{x['turns']} turns", "language": "en", "key_fields": {"total_amount": x["bytes"]}})

    def judge(path: str, content: bytes, brief: extract.Brief) -> str:
        x = json.loads(content)
        if x["conv_id"] % 7 == 0:
            raise ValueError("beyond the reader")
        failed = [{"rule_id": line[3:7], "evidence": f"{brief.document_type} of {brief.metadata['total_amount']} bytes, {brief.summary}", "page_number": 1} for line in brief.rules.split("\n") if line.startswith("- [R002]") and x["bytes"] > 1000]
        return json.dumps({"passed": not failed, "score": min(100, brief.rules.count("- [R0") + x["turns"]), "failed_rules": failed, "remarks": "read"})

    return run_audit(spark, f"{folder}", f"{rules}/rules.md", judge, "Conversations", summarize=summarize)


@query(f"""SELECT document_name, document_type, CASE WHEN broken THEN 'api_error' ELSE 'ok' END AS status, NOT broken AND NOT long AS passed, NOT broken AND NOT long AS passed_computed,
 CASE WHEN broken THEN 0.0 ELSE score END AS score, CASE WHEN broken THEN '' ELSE 'read' END AS remarks FROM {AUDITED_SQL}""")
def audited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of a whole audit: listed, summarised, judged with the rules and the summary, decoded."""
    return conversation_audit(spark, sf_dir).documents.select("document_name", "document_type", "status", "passed", "passed_computed", "score", "remarks")


@query(f"""SELECT 'c' || conv_id || '.pdf' AS document_name, 0 AS pos, 'R002' AS rule_id, 'Required fields' AS rule_title, 'critical' AS severity, CASE WHEN turns > 6 THEN 'invoice' ELSE 'receipt' END || ' of ' || bytes || ' bytes, ' || turns || ' turns' AS evidence, 1 AS page_number
 FROM {TURNS_SQL} WHERE conv_id % 7 <> 0 AND bytes > 1000""")
def failed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failed rules of the same audit with what the checklist says of them."""
    failed = conversation_audit(spark, sf_dir).failed
    return failed.select(base_name(F.col("doc_key")).alias("document_name"), "pos", "rule_id", "rule_title", "severity", "evidence", "page_number")


# ---------------------------------------------------------------- reports


#: Documents as results: a run for each source, scores by length.
RESULTS_SQL = "(SELECT source AS run_id, 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS doc_key, n_chars % 3 > 0 AS passed, CAST(n_chars % 1000 AS DOUBLE) / 10 AS score, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'lang ' || lang END AS remarks, CAST(n_chars % 3 AS INTEGER) AS fails FROM documents)"


def document_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    key = F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    remarks = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("lang "), F.col("lang")))
    return d.select(F.col("source").alias("run_id"), key.alias("doc_key"), key.alias("document_name"), (F.col("n_chars") % 3 > 0).alias("passed"), ((F.col("n_chars") % 1000).cast("double") / 10).alias("score"), remarks.alias("remarks"), F.lit("").alias("preview_base64"), (F.col("n_chars") % 3).cast("int").alias("fails"))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY doc_key) AS no FROM {RESULTS_SQL}),
lines AS (SELECT run_id, 'Heading2' AS style, CAST(no || '. ' || doc_key AS VARCHAR) AS line FROM r
 UNION ALL SELECT run_id, 'rows', 'R00' || (k + 1) || ': Rule ' || (k + 1) || '|HIGH|<&> ' || doc_key || CASE WHEN k = 1 THEN ' (p. 2)' ELSE '' END FROM (SELECT *, unnest(range(0, fails)) AS k FROM r)
 UNION ALL SELECT run_id, 'rows', 'Rule|Severity|Evidence' FROM r WHERE fails > 0
 UNION ALL SELECT run_id, 'plain', 'Score: ' || printf('%.1f', score) || '%    ' || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END FROM r
 UNION ALL SELECT run_id, 'plain', 'Remarks: ' || remarks FROM r WHERE remarks <> ''
 UNION ALL SELECT run_id, 'Title', 'Sources' FROM r GROUP BY run_id)
SELECT run_id || '.docx' AS file, style, line, count(*) AS uses FROM lines GROUP BY ALL""")
def docx_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written report for each source, opened again: its headings, table rows, scores and remarks."""
    results = document_results(spark, sf_dir)
    failed = results.where("fails > 0").select("run_id", "doc_key", F.explode(F.sequence(F.lit(0), F.col("fails") - 1)).alias("pos"))
    number = (F.col("pos") + 1).cast("string")
    failed = failed.select("run_id", "doc_key", "pos", F.concat(F.lit("R00"), number).alias("rule_id"), F.concat(F.lit("Rule "), number).alias("rule_title"), F.lit("high").alias("severity"), F.concat(F.lit("<&> "), F.col("doc_key")).alias("evidence"), F.when(F.col("pos") == 1, 2).alias("page_number"))
    folder = shared_path(spark, "reports")
    write_reports(report_parts(report(results, "Sources", ("run_id",)), results, failed), folder)

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (p for batch in batches for p in batch["path"]):
            store, place = open_store(path)
            with store.open_input_file(place) as f:
                shown = ((path.rpartition("/")[2], *r) for r in report_lines(f) if r[0] in ("Heading2", "rows", "Title") or r[1].startswith(("Score: ", "Remarks: ")))
                while rows := list(islice(shown, 10_000)):
                    yield pd.DataFrame(rows, columns=["file", "style", "line"])

    register(spark)
    written = spark.read.format("document_folder").option("content", "false").load(folder)
    return written.select("path").mapInPandas(opened, "file string, style string, line string").groupBy("file", "style", "line").agg(F.count(F.lit(1)).alias("uses"))


@query(f"""SELECT * FROM (SELECT document_name, score, passed, CAST(row_number() OVER (ORDER BY document_name) AS INTEGER) AS no, (SELECT CAST(printf('%.2f', avg(score)) AS DOUBLE) FROM {RESULTS_SQL}) AS overall_score
 FROM (SELECT doc_key AS document_name, score, passed FROM {RESULTS_SQL}))""")
def json_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response over all documents, written as files of lines and read again as one JSON text."""
    results = document_results(spark, sf_dir)
    folder = shared_path(spark, "response")
    reports.write_json(reports.json_lines(report(results, "All"), results.select("doc_key", "document_name", "passed", "score")), folder)
    # every line but the first and the last is a document; those two enclose them
    lines = spark.read.text(folder).where("value <> ''")
    document = F.from_json(F.regexp_replace("value", "^,", ""), "document_name string, passed boolean, score double")
    ends = lines.where(F.col("value").startswith('{"report"')).select(F.get_json_object(F.concat("value", F.lit("]}}")), "$.report.overall_score").cast("double").alias("overall_score"))
    docs = lines.where(F.col("value").rlike('^,?\\{"document_name"')).select(document.alias("d")).select("d.*")
    numbered = reports.numbered(docs.withColumn("run_id", F.lit("r")), by="document_name")
    return numbered.select("document_name", "score", "passed", "no").crossJoin(F.broadcast(ends))


@query("SELECT l_orderkey, l_linenumber, CAST(printf('%.2f', x) AS DOUBLE) AS two, CAST(printf('%.1f', x) AS DOUBLE) AS one, count(*) AS lines FROM (SELECT *, l_extendedprice * (1 - l_discount) / 8 AS x FROM lineitem) GROUP BY ALL")
def exact_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts rounded half to even by what the double is exactly."""
    d = table(spark, sf_dir, "lineitem").withColumn("x", F.col("l_extendedprice") * (1 - F.col("l_discount")) / 8)
    return d.groupBy("l_orderkey", "l_linenumber", round_exact(F.col("x"), 2).alias("two"), round_exact(F.col("x"), 1).alias("one")).agg(F.count(F.lit(1)).alias("lines"))


# ---------------------------------------------------------------- inexact references

#: How orders refer to each other: in other cases, spacing, zeros and with a slip of the pen.
MENTIONS = ("INV-{}", "inv {}", "Inv-00{}", "IMV-{}", "invv/{}", "XYZ-{}", "INV-{}9", "nv-{}")
MENTION_SQL = "replace((CAST(" + str(list(MENTIONS)) + " AS VARCHAR[]))[o_orderkey % 8 + 1], '{}', CAST(o_custkey AS VARCHAR))"
PLAIN_SQL = "upper(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))".format


@query(rf"""WITH w AS (SELECT o_orderkey AS doc_id, {MENTION_SQL} AS wanted FROM orders),
n AS (SELECT DISTINCT 'INV-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS number FROM customer WHERE c_custkey % 3 > 0),
p AS (SELECT doc_id, wanted, regexp_replace({PLAIN_SQL('wanted')}, '[0-9]', '', 'g') AS l, regexp_replace(regexp_replace({PLAIN_SQL('wanted')}, '[A-Z]', '', 'g'), '^0+(.)', '\1') AS d FROM w),
q AS (SELECT number, 'INV' AS l, regexp_replace(regexp_replace(number, '[^0-9]', '', 'g'), '^0+(.)', '\1') AS d FROM n)
SELECT doc_id, wanted, number AS found FROM p LEFT JOIN q ON p.d = q.d AND levenshtein(p.l, q.l) <= 1""")
def inexact_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customer's document each order's text means, however it is written."""
    mention = F.replace(F.element_at(F.array(*map(F.lit, MENTIONS)), (F.col("o_orderkey") % 8 + 1).cast("int")), F.lit("{}"), F.col("o_custkey").cast("string"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(None).cast("string").alias("document_number"), F.concat(F.lit("see <"), mention, F.lit("> for more")).alias("text"))
    numbers = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.lit(-1).cast("long").alias("doc_id"), F.concat(F.lit("INV-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("document_number"), F.lit("").alias("text"))
    return found_references(orders.unionByName(numbers), "see <([^>]*)>")


@query("""WITH n AS (SELECT DISTINCT p_name AS b FROM part), t AS (SELECT DISTINCT p_brand, overlay AS a FROM (SELECT p_brand, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN replace(p_name, 'e', 'ee') ELSE reverse(p_name) END AS overlay FROM part))
SELECT DISTINCT a, b, CAST(levenshtein(a, b) AS INTEGER) AS distance FROM t, n WHERE levenshtein(a, b) <= 2""")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt part names with all the names at most two edits away."""
    part = table(spark, sf_dir, "part")
    slip = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, F.expr("substr(p_name, 2)")).when(F.col("p_partkey") % 4 == 2, F.replace("p_name", F.lit("e"), F.lit("ee"))).otherwise(F.reverse("p_name"))
    return similar(part.select(slip.alias("text")), part.select(F.col("p_name").alias("text")), 2)
