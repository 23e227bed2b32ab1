"""The running report against the report of all files at once, and inexact references against brute force."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditlake.operators.references import found_references, similar
from auditlake.operators.rules import text_audit
from auditlake.operators.scoring import merged, moments, report, report_of_moments
from auditlake.streaming.report import current_report, run_report


def test_a_running_report_follows_new_and_replaced_files(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    rnd, scores, clock = random.Random(3), {}, [1_700_000_000]

    def put(name, score):
        (folder / name).write_text(str(score))
        clock[0] += 1
        os.utime(folder / name, (clock[0], clock[0]))
        scores[name] = score

    read = lambda path, content: json.dumps({"passed": float(content) >= 50, "score": float(content)})
    assert current_report(spark, out).first().overall_score == 100.0
    steps = [["a.png"], ["b.png", "c.pdf", "d.pdf"], ["a.png", "e.png"], [], ["b.png"], ["b.png", "f.png"]]
    for names in steps:
        for name in names:
            put(name, rnd.randrange(401) / 4)
        (folder / "skip.txt").write_text("1")
        assert run_report(spark, str(folder), read, out, state).awaitTermination(200)
        want = report(spark.createDataFrame([(s >= 50, s) for s in scores.values()], "passed boolean, score double"), "T").first()
        assert current_report(spark, out, "T").first() == want
    assert want.documents_processed == 6


def test_moments_merge_and_retract(spark):
    rnd = random.Random(1)
    rows = [("r" + str(k % 3), rnd.random() < 0.5, rnd.uniform(0, 100), k % 5 == 0) for k in range(200)]
    d = spark.createDataFrame(rows, "run string, passed boolean, score double, gone boolean")
    parts = moments(d.where("score < 50"), ("run",), F.lit(1)).unionByName(moments(d.where("score >= 50"), ("run",), F.lit(1))).unionByName(moments(d.where("gone"), ("run",), F.lit(-1)))
    got = {r.run: r for r in report_of_moments(merged(parts, ("run",)), "T", ("run",)).collect()}
    assert got == {r.run: r for r in report(d.where("NOT gone"), "T", ("run",)).collect()}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_similar_texts_match_brute_force(spark, most):
    rnd = random.Random(most)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12)))
    left = [(word(), "xy"[rnd.randrange(2)]) for _ in range(150)] + [("aaaaaaaaaaaa", "x"), ("aaaaaaaaaaa", "x"), (None, "x"), ("", "x")]
    right = [(word(), "xy"[rnd.randrange(2)]) for _ in range(150)] + [("aaaaaaaaaaaab", "x"), ("baaaaaaaaaaaa", "x"), ("a", None), ("", "x")]
    frames = [spark.createDataFrame(d, "text string, kind string") for d in (left, right)]
    got = Counter((r.kind, r.a, r.b, r.distance) for r in similar(*frames, most, ("kind",)).collect())
    want = Counter({(k, a, b, edits(a, b)) for a, k in left for b, j in right if a is not None and k == j and edits(a, b) <= most})
    assert got == want


def test_references_are_found_however_they_are_written(spark):
    docs = [(1, "INV-3", "see INV 3"), (2, "PO-77", "see inv-03 and see IVN-3 and see INW/0003"), (None, "inv 12", "see Inv.12 and see INV-13"), (4, None, None), (5, "INV-3", "see 3")]
    got = Counter((r.doc_id, r.wanted, r.found) for r in found_references(spark.createDataFrame(docs, "doc_id int, document_number string, text string"), r"see ([^ ]+ ?[0-9]*)").collect())
    found = {(i, w.strip()): f for i, w, f in got}
    assert found[1, "INV 3"] == found[2, "inv-03"] == found[2, "INW/0003"] == "INV-3"
    assert found[None, "Inv.12"] == "inv 12"
    assert found[None, "INV-13"] is None and found[2, "IVN-3"] is None and found[5, "3"] is None


def test_the_text_rules_lose_no_row(spark):
    rnd = random.Random(9)
    docs = [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, "invoice", "contract"]), rnd.choice([None, "A-1", "A-1", "A-2", "odd"]), rnd.choice([None, "", "attached A-1", "attached B-9"])) for _ in range(44)]
    rows = text_audit(spark.createDataFrame(docs, "doc_id int, document_type string, document_number string, text string"), "2020-01-01").collect()
    assert Counter(r.doc_key for r in rows) == Counter({k: 11 * n for k, n in Counter(d[0] for d in docs).items()})
    uses, numbers = Counter(d[2] for d in docs), {d[2] for d in docs}
    assert Counter((r.doc_key, r.complies) for r in rows if r.rule_id == "R008") == Counter((d[0], d[2] in ("A-1", "A-2") and uses[d[2]] == 1) for d in docs)
    assert Counter((r.doc_key, r.complies) for r in rows if r.rule_id == "R012") == Counter((d[0], "B-9" not in (d[3] or "") or "B-9" in numbers) for d in docs)
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("invoice").alias("document_type"), F.when(F.col("id") % 2 == 0, "A-7").otherwise(F.concat(F.lit("N-"), F.col("id"))).alias("document_number"), F.lit("attached A-7").alias("text"))
    assert text_audit(hot, "2020-01-01").where("rule_id = 'R008' AND NOT complies").count() == 1500


# ---------------------------------------------------------------- typed fields


def all_paths(tokens, edges, at=0):
    """The weight of the heaviest choice of edges that do not overlap, by trying every one."""
    if at >= tokens:
        return 0.0
    return max([all_paths(tokens, edges, at + 1)] + [w + all_paths(tokens, edges, e) for s, e, w in edges if s == at])


def test_fields_are_the_heaviest_path():
    from auditlake.functions import fields as g

    rnd = random.Random(5)
    words = ["12", "Mill", "Road", "street", "net", "30", "days", "due", "by", "on", "2024-01-05", "3", "May", "2025", "$", "9.50", "EUR", "tax", "id", "77", "%", "signed", "Clerk", ",", ":", "misc"]
    for _ in range(300):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 11)))
        tokens = [g.kinds(m[0]) for m in g.TOKEN.finditer(text)]
        edges = [(at, e, w + 0.01 * (e - at)) for at in range(len(tokens)) for _, w, shape in g.GRAMMAR for e in g.ends(shape.split(" "), tokens, at) if e > at]
        spans = [(len(g.TOKEN.findall(text[: f.start])), len(g.TOKEN.findall(text[f.start : f.end])), f.weight) for f in g.fields(text)]
        assert abs(sum(w + 0.01 * n for _, n, w in spans) - all_paths(len(tokens), edges)) < 1e-9
        assert all(a + n <= b for (a, n, _), (b, _, _) in zip(spans, spans[1:], strict=False))


def test_fields_and_their_rules(spark):
    from auditlake.operators.fields import field_findings, header_fields

    docs = [
        (1, "invoice", "12 Old Mill Road, tax id: 77. Total $1,234.50, net 30 days, 1.234,5 EUR"),
        (2, "contract", "Signed by A. Clerk on 3 May 2024, various goods"),
        (3, "invoice", "the road to 12 streets; due by 1 June 2025"),
        (None, None, None),
        (2, "receipt", "May 5, 2024 and 2024-13-99 £5 7 %"),
    ]
    d = spark.createDataFrame(docs, "doc_id int, document_type string, text string")
    got = [(r.doc_id, r.kind, r.value, r.evidence) for r in header_fields(d).collect()]
    assert got == [
        (1, "address", "12 Old Mill Road", "12 Old Mill Road"), (1, "tax_id", "77", "tax id: 77"), (1, "total", "1234.50", "Total $1,234.50"), (1, "term", "net 30 days", "net 30 days"), (1, "amount", "1234.5", "1.234,5 EUR"),
        (2, "signature", "Signed by A. Clerk", "Signed by A. Clerk"), (2, "date", "2024-05-03", "3 May 2024"), (2, "vague", "various", "various"),
        (3, "term", "2025-06-01", "due by 1 June 2025"),
        (2, "date", "2024-05-05", "May 5, 2024"), (2, "date", "2024-13-99", "2024-13-99"), (2, "amount", "5", "£5"), (2, "rate", "7", "7 %"),
    ]
    rows = field_findings(d).collect()
    assert len(rows) == 35
    by = {(r.doc_key, r.rule_id, r.applies): (r.complies, r.evidence) for r in rows}
    assert by[1, "R007", True] == (True, "address: 12 Old Mill Road; tax_id: tax id: 77")
    assert by[3, "R007", True] == (False, "no address; no tax_id")
    assert by[2, "R004", True] == (True, "signature: Signed by A. Clerk")
    assert by[2, "R011", True] in ((False, "vague: various"), (True, ""))
    assert by[None, "R009", False] == (True, "")


def test_fields_of_the_longest_numbers():
    from auditlake.functions import fields as g

    # int() refuses so many digits
    got = g.fields(f"{'7' * 5000} May 2024; quantity {'1' * 5000}, net 30\tnet 45")
    assert [(f.kind, f.value) for f in got] == [("quantity", "1" * 5000), ("term", "net 30"), ("term", "net 45")]


def test_orders_are_dealt_over_tasks_for_their_fields(spark):
    from auditlake.plans import registry

    # the orders lie in one part of one file
    for name in ("field_rules", "document_fields", "required_fields"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
