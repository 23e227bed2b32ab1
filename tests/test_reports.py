"""Audits that outlive a run, readers that fail, and reports as files."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from auditlake.operators.extract import Calls
from auditlake.operators.report import json_lines, write_json
from auditlake.operators.scoring import report
from auditlake.plans.audit import load_checklist, run_audit
from auditlake.sources.docx import read_report, report_parts, write_reports
from auditlake.sources.files import scan_folder
from auditlake.sources.folder import register


def counting(log):
    """A reader that writes a line for each call into a file."""

    def read(path, content):
        with open(log, "a") as f:
            f.write(os.path.basename(path) + "\n")
        return json.dumps({"passed": True, "score": len(content)})

    return read


def called(log):
    return sorted(open(log).read().split()) if os.path.exists(log) else []


@pytest.fixture
def folder(tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for k in range(5):
        (docs / f"{k}.pdf").write_bytes(b"x" * (k + 1))
    (docs / "k=v").mkdir()
    (docs / "k=v" / "in.pdf").write_bytes(b"x")
    (docs / "_half.png").write_bytes(b"")
    return docs


def test_only_new_and_changed_files_are_read_again(spark, folder, tmp_path):
    rules, log, store = tmp_path / "r.md", str(tmp_path / "log"), str(tmp_path / "store")
    rules.write_text("\n### R001: One\n**Severity:** low\n")
    run = lambda: run_audit(spark, str(folder), str(rules), counting(log), store=store)
    assert run().report.first().overall_score == 3.0
    assert called(log) == [f"{k}.pdf" for k in range(5)]
    assert run().report.first().overall_score == 3.0
    assert len(called(log)) == 5
    (folder / "2.pdf").write_bytes(b"x" * 13)
    (folder / "9.pdf").write_bytes(b"x" * 7)
    (folder / "0.pdf").unlink()
    got = {r.document_name: r.score for r in run().documents.collect()}
    assert got == {"1.pdf": 2.0, "2.pdf": 13.0, "3.pdf": 4.0, "4.pdf": 5.0, "9.pdf": 7.0}
    assert called(log)[5:] != called(log)[:5] and len(called(log)) == 7
    rules.write_text("\n### R002: Two\n")
    run()
    assert len(called(log)) == 12


def test_the_ledger_repeats_no_call(spark, folder, tmp_path):
    log, ledger = str(tmp_path / "log"), str(tmp_path / "ledger")
    run = lambda: run_audit(spark, str(folder), str(tmp_path / "none"), counting(log), calls=Calls(at_once=3, ledger=ledger))
    first = sorted((r.document_name, r.score) for r in run().documents.collect())
    # a run without its results, as after a lost executor
    assert sorted((r.document_name, r.score) for r in run().documents.collect()) == first
    assert len(called(log)) == 5


def test_failures_are_tried_again(spark, folder, tmp_path):
    log = str(tmp_path / "log")
    plain = counting(log)

    def flaky(path, content):
        reply = plain(path, content)
        with open(log) as f:
            tries = f.read().split().count(os.path.basename(path))
        if tries < 3:
            raise TimeoutError("later")
        return reply

    result = run_audit(spark, str(folder), str(tmp_path / "none"), flaky, calls=Calls(at_once=1, again=2, wait=0.001))
    assert {r.status for r in result.documents.collect()} == {"ok"}
    assert len(called(log)) == 15
    broken = run_audit(spark, str(folder), str(tmp_path / "none"), lambda path, content: 1 / 0, calls=Calls(again=1, wait=0.001))
    assert {(r.status, r.score) for r in broken.documents.collect()} == {("api_error", 0.0)}


def test_a_reader_gets_rules_and_summary(spark, folder, tmp_path):
    (tmp_path / "r.md").write_text("**Audit Name:** Mine\n**Version:** 7\n\n### R001: One\n**Severity:** low\n**Mandatory:** true\n**Description:** d\n")

    def read(path, content, brief):
        return json.dumps({"passed": True, "score": 1, "remarks": "|".join([brief.rules, brief.document_type, brief.summary, brief.metadata.get("date", "-")])})

    got = run_audit(spark, str(folder), str(tmp_path / "r.md"), read, strict=True, summarize=lambda p, c: '{"document_type": "receipt", "summary": "s", "key_fields": {"date": "d1"}}')
    assert {(r.status, r.remarks) for r in got.documents.collect()} == {("ok", "- [R001] One (low, mandatory): d|receipt|s|d1"), ("empty_content", "")}
    head = got.report.first()
    assert (head.checklist_name, head.checklist_version) == ("Mine", "7")
    none = load_checklist(spark, str(tmp_path / "none.md"))
    assert (none.name, none.version, none.rules.count(), none.lines) == ("Default", "1.0", 0, "")


def test_the_folder_source(spark, folder):
    register(spark)
    load = lambda **o: spark.read.format("document_folder").options(**o).load(str(folder))
    assert sorted(r.path.rpartition("/")[2] for r in load().collect()) == ["0.pdf", "1.pdf", "2.pdf", "3.pdf", "4.pdf", "_half.png"]
    assert load(content="false").columns == ["path", "modificationTime", "length"]
    assert load(suffixes=".png", shards="2").first().length == 0
    assert load(shards="3").rdd.getNumPartitions() == 3
    assert spark.read.format("document_folder").load(f"file://{folder}/none").count() == 0
    assert scan_folder(spark, f"file://{folder}", strict=True).count() == 6


# ---------------------------------------------------------------- reports


def results(spark, n=3, runs=("b", "a/..")):
    rows = [(run, f"/in/{k:03}.png", f"{k:03}.png", k % 2 == 0, 10.25 * k, "fine <&>\x00" if k else "", "") for run in runs for k in range(n)]
    return spark.createDataFrame(rows, "run_id string, doc_key string, document_name string, passed boolean, score double, remarks string, preview_base64 string")


ITEMS = "run_id string, doc_key string, pos int, rule_id string, rule_title string, severity string, evidence string, page_number int"


def test_reports_are_written_and_opened_again(spark, tmp_path):
    from auditlake.functions import images
    import base64
    import numpy as np

    small = base64.b64encode(images.as_png(np.zeros((10, 20, 3), np.uint8))).decode()
    docs = results(spark).withColumn("preview_base64", F.when(F.col("doc_key") == "/in/001.png", small).otherwise(""))
    items = spark.createDataFrame([("b", "/in/001.png", 1, "R2", "Two", "low", "late", None), ("b", "/in/001.png", 0, "R1", "One", "critical", "e <1>", 4)], ITEMS)
    head = report(docs, "Title & more", ("run_id",)).withColumn("elapsed_seconds", F.lit(1.25))
    write_reports(report_parts(head, docs, items, generated="2026-01-01 10:00"), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["a_...docx", "b.docx"]
    got = read_report((tmp_path / "out" / "b.docx").read_bytes())
    assert got["Title"] == ["Title & more"]
    assert got["Heading2"] == ["1. 000.png", "2. 001.png", "3. 002.png"]
    assert got["rows"] == ["Rule|Severity|Evidence", "R1: One|CRITICAL|e <1> (p. 4)", "R2: Two|LOW|late"]
    assert got["pictures"] == ["word/media/2.png"]
    assert {"Generated: 2026-01-01 10:00", "Elapsed: 1.2s", "Documents: 3 processed, 2 passed, 1 failed", "Score: 10.2%    FAIL", "Remarks: fine <&>"} <= set(got["plain"])
    with zipfile.ZipFile(tmp_path / "out" / "b.docx") as z:
        assert z.testzip() is None
        assert b'Target="media/2.png"' in z.read("word/_rels/document.xml.rels")
        assert b'r:embed="p2"' in z.read("word/document.xml")


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    docs = results(spark)
    parts = report_parts(report(docs, "T", ("run_id",)), docs, spark.createDataFrame([], ITEMS))
    # a picture that is no picture has no size; one that is null cannot be written
    bad = parts.unionByName(spark.createDataFrame([("b", 0, 1)], "run_id string, kind int, no long"), allowMissingColumns=True)
    with pytest.raises(Exception, match="NoneType"):
        write_reports(bad, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []


@pytest.mark.parametrize("n", [0, 1, 25])
def test_json_in_parts_is_one_response(spark, tmp_path, n):
    docs = results(spark, n, ("r",)).repartition(4)
    head = report(docs, "All").withColumn("elapsed_seconds", F.lit(2.5))
    write_json(json_lines(head, docs), str(tmp_path / "json"))
    names = sorted(x for x in os.listdir(tmp_path / "json") if x.startswith("part-"))
    out = json.loads("".join((tmp_path / "json" / x).read_text() for x in names))
    assert [d["document_name"] for d in out["report"]["document_results"]] == [f"{k:03}.png" for k in range(n)]
    assert (out["report"]["documents_processed"], out["elapsed_seconds"]) == (n, 2.5)
    assert set(out["prediction_interval"]) == {"lower", "upper"}


def test_the_command_line_prints_the_report(spark, folder, tmp_path, capsys, monkeypatch):
    from auditlake.__main__ import main

    (tmp_path / "own_reader.py").write_text("import json\n\n\ndef read(path, content):\n    return json.dumps({'passed': True, 'score': 90, 'failed_rules': [{'rule_id': 'R001', 'evidence': 'e'}]})\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "own_reader.py"))
    (tmp_path / "r.md").write_text("\n### R001: One\n**Severity:** low\n")
    args = [str(folder), "--rules", str(tmp_path / "r.md"), "--reader", "own_reader:read", "--title", "T", "--docx", str(tmp_path / "out"), "--json", str(tmp_path / "lines")]
    main(args)
    out = json.loads(capsys.readouterr().out)
    assert (out["audit_title"], out["documents_processed"], out["overall_score"], len(out["document_results"])) == ("T", 5, 90.0, 5)
    got = read_report((tmp_path / "out" / "report.docx").read_bytes())
    assert got["rows"].count("R001: One|LOW|e") == 5
    with pytest.raises(SystemExit):
        main([*args[:4], "nothing"])
    with pytest.raises(FileNotFoundError, match="Folder not found"):
        main([str(folder / "none"), *args[1:5]])


def test_images_and_rendered_pages_are_one_table(spark):
    from auditlake.operators.extract import shown_pages

    files = spark.createDataFrame([("a.pdf", ".pdf", "image/jpeg", bytearray(b"123")), ("b.jpg", ".jpg", "image/jpeg", bytearray(b"x")), ("c.tif", ".tif", "image/tiff", bytearray(b"y")), ("d.txt", ".txt", None, bytearray(b"z")), ("e.pdf", ".pdf", "image/jpeg", None)], "path string, ext string, page_media_type string, content binary")
    render = lambda path, content: (bytes([c]) for c in content)
    got = sorted((r.doc_key, r.page_no, r.url) for r in shown_pages(files, render, 2).collect())
    assert got == [("a.pdf", 1, "data:image/jpeg;base64,MQ=="), ("a.pdf", 2, "data:image/jpeg;base64,Mg=="), ("b.jpg", 1, "data:image/jpeg;base64,eA=="), ("c.tif", 1, "data:image/tiff;base64,eQ==")]


def test_written_reports_are_read_in_a_new_session(spark):
    from auditlake.plans import registry

    # a session in which no other query has registered the folder source; making rows makes it the active one
    new = spark.newSession()
    new.createDataFrame([(1,)], "x int")
    try:
        assert registry.QUERIES["docx_reports"](new, "/root/testdata/sf0.001").where("style = 'Title'").count() > 1
    finally:
        spark.createDataFrame([(1,)], "x int")


def test_pages_of_many_files_go_on_in_bounded_batches(spark):
    from auditlake.operators.extract import BATCH_BYTES, rendered_pages

    files = spark.range(0, 3000, numPartitions=1).selectExpr("cast(id as string) AS path", "cast('x' as binary) AS content")
    small = rendered_pages(files, lambda path, content: iter([content, None]))
    assert (small.count(), small.where("image IS NULL").count(), small.agg(F.max("page_no")).first()[0]) == (6000, 3000, 2)
    large = rendered_pages(files.limit(9), lambda path, content: (bytes(BATCH_BYTES) for _ in range(99)), 3)
    assert [r.n for r in large.groupBy("doc_key").agg(F.sum(F.length("image")).alias("n")).collect()] == [3 * BATCH_BYTES] * 9


def test_pdfs_are_dealt_over_tasks(spark):
    from auditlake.plans import registry

    # the pages lie in one part of one file
    assert registry.QUERIES["pdf_pages"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
