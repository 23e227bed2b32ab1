"""Scoring, replies, checklists, folders and whole audits on literal cases."""

import json
import math
import random
from fractions import Fraction
from itertools import permutations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.functions.replies import decode_replies
from auditlake.functions.sums import mean_and_deviation, pieces
from auditlake.operators.checklist import parse_checklist, with_rule
from auditlake.operators.report import as_json, displayed, result_label
from auditlake.operators.rules import missing_attachments, number_gaps
from auditlake.operators.scoring import document_scores, report
from auditlake.plans.audit import run_audit
from auditlake.sources.files import data_urls, own_rules, read_checklist, scan_folder
from auditlake.streaming.folder import audit_new_files


def scored(spark, scores):
    return report(spark.createDataFrame([(s >= 80, float(s)) for s in scores], "passed boolean, score double")).first()


@pytest.mark.parametrize(
    ("scores", "overall", "result", "lower", "upper"),
    [
        ([], 100.0, "PASS", 100.0, 100.0),
        ([90], 90.0, "PASS", 77.5, 100.0),
        ([79.996], 80.0, "REVIEW REQUIRED", 67.5, 92.5),
        ([50], 50.0, "REVIEW REQUIRED", 37.5, 62.5),
        ([49.999], 50.0, "FAIL", 37.5, 62.5),
        ([60, 60], 60.0, "REVIEW REQUIRED", 60.0, 60.0),
        ([100, 0], 50.0, "REVIEW REQUIRED", 0.0, 100.0),
        ([100, 75, 50], 75.0, "REVIEW REQUIRED", 46.71, 100.0),
    ],
)
def test_scoring(spark, scores, overall, result, lower, upper):
    r = scored(spark, scores)
    assert (r.overall_score, r.overall_result, r.lower, r.upper) == (overall, result, lower, upper)
    assert r.documents_passed + r.documents_failed == r.documents_processed == len(scores)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 100), max_size=6))
def test_interval_holds_the_score(spark, scores):
    r = scored(spark, scores)
    assert 0 <= r.lower <= r.overall_score <= r.upper <= 100


def test_report_ignores_partitions(spark):
    d = spark.range(50).select((F.col("id") % 2 == 0).alias("passed"), (F.col("id") * 2.0).alias("score"))
    assert len({report(d.repartition(n)).first() for n in (1, 4, 32)}) == 1


def test_a_report_is_the_same_however_its_rows_are_parted(spark):
    # the lower end of 50, 50, 56.5 and 80 is 45.155 but for the last bits, which a sum of doubles has from its order
    rows = [(f"{p} {cut}", s >= 50, s, k < cut) for p in set(permutations([50.0, 50.0, 56.5, 80.0])) for cut in (1, 2, 3) for k, s in enumerate(p)]
    halves = spark.sparkContext.parallelize(sorted(rows, key=lambda r: not r[3]), 2)  # as many first rows as others
    d = spark.createDataFrame(halves, "run string, passed boolean, score double, first boolean")
    assert d.where("first").select(F.spark_partition_id().alias("p")).distinct().count() == d.where("NOT first").select(F.spark_partition_id().alias("p")).distinct().count() == 1
    got = displayed(report(d, "T", ("run",))).select("overall_score", "lower", "upper", "shown_interval").collect()
    assert len(got) == 36
    assert {tuple(r) for r in got} == {(59.12, 45.16, 73.08, "45.2 - 73.1")}


def test_mean_and_deviation_equal_the_exact_ones(spark):
    rnd = random.Random(7)
    third = 100 / 3
    runs = [[rnd.uniform(0, 100) for _ in range(rnd.randint(1, 9))] for _ in range(60)] + [[rnd.randrange(401) / 4 for _ in range(rnd.randint(2, 9))] for _ in range(60)]
    runs += [[third] * 7, [third, math.nextafter(third, 0)], [85.8, 85.55], [0.005], [0.0, 0.0], [100.0] * 5, [100.0, 0.0], [1e-9, 99.0, 1e-320], [rnd.choice([third, 200 / 3, 100.0]) for _ in range(3000)]]
    d = spark.createDataFrame([(k, True, x) for k, run in enumerate(runs) for x in run], "run int, passed boolean, score double")
    rows = [{r.run: (r.mean, r.deviation) for r in e.select("run", *(p.alias(c) for c, p in zip("abc", pieces(F.col("score")), strict=True))).groupBy("run").agg(*(x.alias(c) for c, x in zip(("mean", "deviation"), mean_and_deviation(*map(F.col, "abc")), strict=True))).collect()} for e in (d, d.repartition(7), d.orderBy("score"))]
    assert rows[0] == rows[1] == rows[2]
    for k, run in enumerate(runs):
        xs, (mean, deviation) = [Fraction(x) for x in run], rows[0][k]
        exact = sum(xs) / len(xs)
        assert abs(mean - float(exact)) <= math.ulp(float(exact)) or float(exact) < 1e-9
        if len(xs) == 1:
            assert deviation is None
        else:
            squared = sum((x - exact) ** 2 for x in xs) / (len(xs) - 1)
            assert abs(deviation - math.sqrt(squared)) <= max(2 * math.ulp(deviation), 1e-14)


def test_scores_beyond_100_are_still_reported(spark):
    assert scored(spark, [150, 50]).overall_score == 100.0
    assert scored(spark, [-10, 30]).lower == 0.0


def test_mandatory_failure_fails_the_document(spark):
    rows = [("a", "R1", True, True), ("a", "R2", False, False), ("b", "R1", True, False), ("b", "R2", False, True)]
    got = {r.doc_key: (r.passed, r.score) for r in document_scores(spark.createDataFrame(rows, "doc_key string, rule_id string, mandatory boolean, complies boolean")).collect()}
    assert got == {"a": (True, 50.0), "b": (False, 50.0)}


def decoded(spark, reply, strict=False):
    return decode_replies(spark.createDataFrame([(reply,)], "reply string"), strict).first()


def test_replies(spark):
    assert decoded(spark, '{"passed":true,"passed":false}').passed is False
    assert decoded(spark, None).status == "parse_error"
    assert decoded(spark, '{"passed": "false"}').passed is False
    assert decoded(spark, '{"passed": "false"}', strict=True).passed is True
    assert decoded(spark, '{"passed": false}', strict=True).passed is False
    assert decoded(spark, '{"remarks": null}').remarks == ""
    assert decoded(spark, '{"remarks": null}', strict=True).remarks == "None"
    assert decoded(spark, '{"failed_rules": null}').status == "parse_error"
    assert decoded(spark, '{"score": NaN}').status == "invalid_score"
    r = decoded(spark, '{"score": 1, "failed_rules": [{"rule_id": "R1", "page_number": 3.5}]}')
    assert (r.status, r.failed_rules[0].page_number) == ("invalid_page", None)
    assert decoded(spark, '{"failed_rules": [{"page_number": true}]}').failed_rules[0].page_number == 1


def test_own_rules(spark):
    r = parse_checklist(spark.createDataFrame([("own", own_rules())], "checklist string, text string")).collect()
    assert [x.rule_id for x in r] == [f"R{k:03}" for k in range(1, 13)]
    assert sum(x.mandatory for x in r) == 8
    assert all(x.valid for x in r)


def test_lookup_takes_the_first_rule(spark):
    rules = spark.createDataFrame([(2, "R1", "late", "", "low", True), (1, "R1", "early", "", "high", True)], "ord int, rule_id string, title string, description string, severity string, mandatory boolean")
    item = with_rule(spark.createDataFrame([("R1", "e", 1)], "rule_id string, evidence string, page_number int"), rules).first()
    assert (item.rule_title, item.severity) == ("early", "high")


def test_gaps_and_attachments(spark):
    n = number_gaps(spark.createDataFrame([(x,) for x in (1, 2, 5, 6, 9)], "number long")).collect()
    assert sorted(r.after for r in n) == [2, 6]
    d = spark.createDataFrame([(1, "A-1", "attached A-2 and attached B-7"), (2, "A-2", None)], "doc_id int, document_number string, text string")
    assert [(r.doc_id, r.wanted) for r in missing_attachments(d).collect()] == [(1, "B-7")]


@pytest.fixture
def folder(tmp_path):
    for name in ("b.pdf", "a.PDF", "Z.jpg", "e.tar.bmp", "d.txt", ".hid.pdf", "_und.png", "c.webp", "noext"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.pdf").write_bytes(b"x")
    return str(tmp_path)


def test_scan(spark, folder, tmp_path):
    names = lambda d: sorted(r.document_name for r in d.collect())
    assert names(scan_folder(spark, folder)) == ["Z.jpg", "a.PDF", "b.pdf", "e.tar.bmp"]
    assert names(scan_folder(spark, folder, strict=True)) == [".hid.pdf", "Z.jpg", "_und.png", "a.PDF", "b.pdf", "e.tar.bmp"]
    assert {r.document_name: r.url for r in data_urls(scan_folder(spark, folder)).collect()}["Z.jpg"] == "data:image/jpeg;base64,Wi5qcGc="
    assert read_checklist(spark, str(tmp_path / "none.md")).count() == 0


def test_whole_audit(spark, folder, tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "r.md").write_text("\n### R001: One\n**Severity:** low\n")

    def read(path, content):
        if path.endswith("b.pdf"):
            raise RuntimeError("no answer")
        return json.dumps({"passed": True, "score": 100, "failed_rules": [{"rule_id": "R001", "evidence": content.decode()}]})

    a = run_audit(spark, folder, str(tmp_path / "rules" / "r.md"), read, "T")
    r = a.report.first()
    assert (r.audit_title, r.documents_processed, r.documents_passed, r.overall_score) == ("T", 4, 3, 75.0)
    assert {x.status for x in a.documents.collect()} == {"ok", "api_error"}
    assert {(x.rule_title, x.severity) for x in a.failed.collect()} == {("One", "low")}
    out = json.loads(as_json(a.report, a.documents).first().json)
    assert out["report"]["documents_failed"] == 1
    assert len(out["report"]["document_results"]) == 4
    assert a.report.select(result_label(F.col("overall_result")).alias("x")).first().x == "REVIEW REQUIRED"


def test_new_files_are_audited_once(spark, folder, tmp_path):
    run = lambda: audit_new_files(spark, folder, lambda p, c: '{"passed": true, "score": 80}', str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert run()
    (tmp_path / "new.png").write_bytes(b"n")
    assert run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_a_missing_folder_is_an_empty_run(spark, tmp_path):
    from auditlake.plans.audit import run_audit

    audit = run_audit(spark, str(tmp_path / "none"), str(tmp_path / "none.md"), lambda path, content: "{}")
    assert audit.documents.count() == 0
    assert audit.failed.count() == 0
    assert audit.report.first().documents_processed == 0


def test_replies_are_judged_as_parsed(spark):
    from auditlake.functions.replies import decode_replies

    data = [("two", '{"passed": true} {"x": 1}'), ("inner", '{"failed_rules": [{"rule_id": "R1", "score": 900}]}'), ("null", '{"failed_rules": null}'), ("text", '{"remarks": "\\"failed_rules\\": null"}')]
    got = {r.id: r.status for r in decode_replies(spark.createDataFrame(data, "id string, reply string")).collect()}
    assert got == {"two": "parse_error", "inner": "ok", "null": "parse_error", "text": "ok"}


def test_a_whole_run_summarises_and_keeps_both_verdicts(spark, tmp_path):
    from auditlake.plans.audit import timed_audit

    docs, rules = tmp_path / "docs", tmp_path / "rules"
    docs.mkdir(), rules.mkdir()
    for name, content in (("a.pdf", b"a"), ("b.png", b"b"), ("c.pdf", b"c"), ("d.jpg", b""), ("_e.png", b"e")):
        (docs / name).write_bytes(content)
    block = "### {}: {}\n\n- **Severity:** low\n- **Mandatory:** {}\n- **Description:** text\n\n"
    (rules / "r.md").write_text("# Rules\n\n" + block.format("R001", "One", "true") + block.format("R002", "Two", "false"))
    failed = {"a.pdf": "R001", "b.png": "R002"}

    def read(path, content):
        name = path.rsplit("/", 1)[-1]
        items = f'{{"rule_id": "{failed[name]}"}}' if name in failed else ""
        return f'{{"passed": true, "score": 90, "failed_rules": [{items}]}}'

    def summarize(path, content):
        if path.endswith("c.pdf"):
            raise ValueError("no")
        return '{"document_type": "invoice", "summary": "s", "language": "en", "key_fields": {"total": "7"}}'

    def count(path, content):
        return {b"a": 12}[content]

    args = (str(docs), str(rules / "r.md"), read, "T")
    audit, response = timed_audit(spark, *args, strict=True, summarize=summarize, count_pages=count)
    got = {r.document_name: r for r in audit.documents.collect()}
    assert {n: (r.passed, r.passed_computed, r.status) for n, r in got.items()} == {
        "a.pdf": (True, False, "ok"), "b.png": (True, True, "ok"), "c.pdf": (True, True, "ok"), "d.jpg": (False, False, "empty_content"), "_e.png": (True, True, "ok"),
    }
    assert {n: (r.document_type, r.page_count, r.summary_status) for n, r in got.items()} == {
        "a.pdf": ("invoice", 12, "ok"), "b.png": ("invoice", 1, "ok"), "c.pdf": ("unknown", 1, "api_error"), "d.jpg": ("unknown", 1, "empty_content"), "_e.png": ("invoice", 1, "ok"),
    }
    assert got["a.pdf"].metadata["total"] == "7"
    assert (got["d.jpg"].metadata["error"], got["d.jpg"].summary) == ("unable to load content", "Unsupported or empty document.")
    assert response.first().elapsed_seconds > 0
    assert response.first().documents_processed == 5
    plain, _ = timed_audit(spark, *args)
    assert {r.document_name for r in plain.documents.collect()} == {"a.pdf", "b.png", "c.pdf"}


def test_text_rules_take_nulls(spark):
    from auditlake.operators.rules import text_audit

    d = spark.createDataFrame([(1, None, None, None), (2, "invoice", "A-1", ""), (3, "invoice", "A-1", "x")], "doc_id long, document_type string, document_number string, text string")
    got = {(r.doc_key, r.rule_id): (r.applies, r.complies) for r in text_audit(d, "2020-01-01").collect()}
    assert len(got) == 33 and all(None not in v for v in got.values())
    assert got[1, "R002"] == (False, True) and got[2, "R002"] == (True, False)
    assert [got[k, "R008"] for k in (1, 2, 3)] == [(True, False)] * 3
    assert text_audit(d.limit(0), "2020-01-01").count() == 0
