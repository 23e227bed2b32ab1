import importlib
import random
import time
from collections import Counter

import pytest
from helpers import SCHEMA, frame, linked_components, prose, rows
from pyspark.sql import functions as F

import corpus_pipeline as cp
from auditlake.llm import common, queries
from auditlake.llm import op1_pii as op1
from auditlake.llm import op6_langid as op6

TRAINED = []


@pytest.fixture
def one_tagger(monkeypatch):
    """An untrained tagger, for the tests that do not look at its spans."""
    if not TRAINED:
        TRAINED.append(op1.Tagger())
    monkeypatch.setattr(cp, "train_tagger", lambda docs: TRAINED[0])


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stages(spark):
    docs = frame(spark)
    columns = docs.columns
    known = cp.language(spark, docs, "")
    assert known.columns == columns
    ids = {r.doc_id for r in known.collect()}
    assert ids == {i for i, t, *_ in rows() if any(c.isalpha() for c in t or "")}
    kept = cp.near_duplicate(spark, docs, "")
    assert kept.columns == columns
    want = linked_components(rows(), cp.SHINGLE_WORDS, cp.PERCENT)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(-1 if i is None else i for i, c in want.items() if i == c)
    clean = cp.personal_data(spark, frame(spark, [(1, "a@b.cd", "en", "s", 6), (2, None, None, None, None)]), "")
    assert clean.columns == columns
    assert {(r.doc_id, r.text, r.n_chars) for r in clean.collect()} == {(1, "[email]", 7), (2, None, None)}
    assert cp.mixing(spark, docs, "").columns == columns
    assert {r.doc_id for r in cp.encoding(spark, docs, "").collect()} == {i for i, *_ in rows()}


def test_different_texts_of_one_doc_id_stay(spark):
    rnd = random.Random(4)
    a, b, c, d, e = (prose(rnd, 60) for _ in range(5))
    data = [(None, a, "en", "s", 1), (None, b, "en", "s", 1), (None, b, "en", "s", 1), (7, c, "en", "s", 1), (7, d, "en", "s", 1), (8, d, "en", "s", 1), (9, e, "en", "s", 1), (None, e, "en", "s", 1)]
    kept = cp.near_duplicate(spark, frame(spark, data), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, a), (0, b), (7, c), (7, d), (9, e)])


def shuffled(spark):
    """Bytes that all shuffles so far have written."""
    time.sleep(0.5)
    spark.range(1).count()  # the end of a task brings the sums up to date
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_texts_without_copies_are_not_shuffled(spark, without_broadcast, tmp_path):
    rnd = random.Random(31)
    data = [(k, prose(rnd, 2500, "abcdefghijklmnopqrstuvwxyz0123456789"), "en", "s", 1) for k in range(400)]
    data += [(500 + k, data[k][1] + " more", "en", "s", 1) for k in range(0, 20, 2)] + [(600, data[1][1], "en", "s", 1), data[3]]
    spark.createDataFrame(data, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents"))
    before = shuffled(spark)
    cp.near_duplicate(spark, spark.read.parquet(str(tmp_path / "documents")), "").write.parquet(str(tmp_path / "kept"))
    moved = shuffled(spark) - before
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == list(range(400))
    assert moved < sum(len(t) for _, t, *_ in data)


@pytest.mark.parametrize("most", [64, 256])
def test_a_full_sieve_changes_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(common, "SIEVE_MOST", most)
    rnd = random.Random(32)
    data = [(k, prose(rnd, 30), "en", "s", 1) for k in range(300)]
    data += [(300 + k, data[k % 40][1] + " x" * (k % 3), "en", "s", 1) for k in range(200)] + data[:50] + [(None, data[7][1], "en", "s", 1), (None, data[8][1] + " x y z 1 2 3 4", "en", "s", 1)]
    got = sorted(-1 if r.doc_id is None else r.doc_id for r in cp.near_duplicate(spark, frame(spark, data), "").collect())
    want = linked_components([(k, t) for k, (_, t, *_) in enumerate(sorted(set(data), key=lambda r: (r[0] is None, r[0] or 0)))], cp.SHINGLE_WORDS, cp.PERCENT)
    ids = [r[0] for r in sorted(set(data), key=lambda r: (r[0] is None, r[0] or 0))]
    assert got == sorted(-1 if ids[k] is None else ids[k] for k, c in want.items() if k == c)


def test_empty_table(spark, one_tagger):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, none, "").count() == 0




def test_run(spark, tmp_path):
    frame(spark).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert out.columns == [*frame(spark).columns, "ids"]
    assert out.count() > 0


def test_columns_named_like_those_inside(spark, one_tagger):
    docs = frame(spark)
    names = ["_lang_pred", "_lang_share", "_letter", "_key", "_kept_id", "_kept_key", "_row", "_mix_id", "_mix_draw", "_mix_source", "_mix_copies", "_mix_copy", "_held", "component_id", "ids", "part", "draw", "same"]
    for name in names:
        docs = docs.withColumn(name, F.lit("clash"))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, "")
        rows_ = out.collect()
        assert rows_, name
        if name == "encoding":
            assert set(out.columns) == set(docs.columns)
        else:
            assert out.columns == docs.columns
            assert all(r[c] == "clash" for r in rows_ for c in names)


def test_language_stage_keeps_what_the_operator_knows(spark):
    """The stage's verdict follows predictions and shares of the operator, and drops nothing else."""
    docs = frame(spark)
    langs, table = op6.learn(docs.select("doc_id", "text", "lang"))
    found = op6.predict(docs.select("doc_id", "text"), langs, table).collect()
    want = sorted((r.doc_id or 0, r.text) for r in found if r.lang_pred != op6.UNKNOWN and r.score >= cp.MIN_SHARE)
    assert sorted((r.doc_id or 0, r.text) for r in cp.language(spark, docs, "").collect()) == want


def test_mixing_stage_takes_whole_documents(spark):
    """Each source's words come near its target, no document comes more than three times, and rows are whole."""
    rnd = random.Random(21)
    data = [(k, prose(rnd, rnd.randint(1, 40)), None, "abc"[k % 3], 1) for k in range(600)]
    out = cp.mixing(spark, frame(spark, data), "").collect()
    whole = {i: t for i, t, *_ in data}
    assert all(r.text == whole[r.doc_id] for r in out)
    assert max(Counter(r.doc_id for r in out).values()) <= 3
    size, taken = Counter(), Counter()
    for _, t, _, s, _ in data:
        size[s] += len(t.split())
    for r in out:
        taken[r.source] += len(r.text.split())
    total, capped = sum(size.values()), {}
    want = {s: total * w / 6 for s, w in zip("abc", (1, 2, 3), strict=True)}
    assert not capped
    assert all(want[s] <= 3 * size[s] for s in want)
    assert all(abs(taken[s] - want[s]) <= 10 for s in want)


def test_rows_of_one_document_that_differ_elsewhere(spark):
    rnd = random.Random(22)
    a = prose(rnd, 60)
    docs = frame(spark, [(1, a, "en", "z", 1), (1, a, "de", "y", 2), (1, a, "en", "y", 3)])
    for parts in (1, 3):
        (got,) = cp.near_duplicate(spark, docs.repartition(parts), "").collect()
        assert (got.lang, got.source, got.n_chars) == ("de", "y", 2)


def test_quality_matches_sql(spark):
    duckdb = importlib.import_module("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        want = con.sql(sql)
        at = [want.columns.index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr), name
