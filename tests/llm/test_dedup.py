import random
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, by_id, frame, linked_components, prose, rows, shingles, windows_removed
from pyspark.sql import functions as F

from auditlake.llm import common
from auditlake.llm import op2_substrings as op2
from auditlake.llm import op7_minhash as op7
from auditlake.llm.common import Words, sliding
from auditlake.llm.components import components


@pytest.mark.parametrize("width", [10, 50])
def test_substrings_match_brute_force(spark, width):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op2.substring_dedup(frame(spark), width).collect())
    assert got == windows_removed(rows(), width)


def test_substrings_of_hot_passages(spark):
    rnd = random.Random(5)
    passage = prose(rnd, 60)
    data = [(k, prose(rnd, rnd.randint(0, 40)) + " " + passage + " " + prose(rnd, rnd.randint(0, 40)), None, None, None) for k in range(60)]
    data += [(100 + k, "a b " * 80, None, None, None) for k in range(5)]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op2.substring_dedup(frame(spark, data)).collect())
    assert got == windows_removed(data, 50)


def test_longest_repeats_double_until_none_survives(spark):
    rnd = random.Random(6)
    a = prose(rnd, 500)
    data = [(1, a, None, None, None), (2, " ".join(a.split()[20:350]), None, None, None), (3, " ".join(a.split()[:70]), None, None, None), (4, prose(rnd, 100), None, None, None)]
    got = {r.doc_id: r.length for r in op2.longest_repeats(frame(spark, data), 50).collect()}
    assert got == {2: 200, 3: 50}


def mirrored(n, a, b):
    """A row of n letters, each half the other with letters exchanged: equal sums of powers of any odd base modulo 2**64."""
    out, other = a, b
    while len(out) < n:
        out, other = out + other, other + out
    return out, other


def test_words_and_texts_that_a_polynomial_confuses(spark):
    x, y = mirrored(1024, "a", "b")
    rnd = random.Random(3)
    head, tail = prose(rnd, 24), prose(rnd, 25)
    data = [(1, f"{head} {x} {tail}", None, None, None), (2, f"{head} {y} {tail}", None, None, None)]
    data += [(k + 3, " ".join(w), None, None, None) for k, w in enumerate(mirrored(2048, "a", "b"))]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op2.substring_dedup(frame(spark, data)).collect())
    assert got == windows_removed(data, 50)
    assert all(r[2] == 0 for r in got if r[0] == 2)
    near = {r.doc_id: r.component_id for r in op7.near_duplicates(frame(spark, data), 3, 85).collect()}
    assert near == linked_components(data, 3, 85)


def test_word_hashes_differ():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("ab\0\xff") for _ in range(rnd.randint(1, 90))) for _ in range(20000)} | set(mirrored(4096, "a", "b")))
    data = " ".join(words).encode("latin-1")
    found = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(found) == len(words) == len(set(found.hash.tolist())) == len(set(found.second_hash.tolist()))
    assert not (found.hash == found.second_hash).any()


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 99, 200)
    for w in (1, 2, 5, 26):
        assert sliding(np.minimum, x, w).tolist() == [x[k : k + w].min() for k in range(len(x) - w + 1)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, width, percent):
    got = by_id(op7.near_duplicates(frame(spark), width, percent))
    want = linked_components(rows(), width, percent)
    assert {i: {r.component_id for r in x} for i, x in got.items()} == {i: {c} for i, c in want.items()}
    size = {i: len(shingles(t, width)) for i, t, *_ in rows()}
    assert all(r.n_shingles == size[i] and r.kept == (r.component_id == i) for i, x in got.items() for r in x)
    assert len(got[13]) == 2


def test_near_duplicates_of_a_large_group(spark):
    """Edits of one text: many pairs are linked only through others, or not at all."""
    rnd = random.Random(7)
    base, data = prose(rnd, 120).split(), []
    for k in range(420):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            w[rnd.randrange(len(w))] = prose(rnd, 1, "xyz")
        data.append((k, " ".join(w), None, None, None))
    got = {r.doc_id: r.component_id for r in op7.near_duplicates(frame(spark, data), 3, 85).collect()}
    want = linked_components(data, 3, 85)
    assert got == want
    assert 1 < len(set(want.values())) < 400


def test_sieve_marks_every_wanted_row_and_few_others(spark):
    df = spark.range(20000).select("id", F.lit("clash").alias("_word"), F.lit("clash").alias("_Slot"))
    wanted = spark.range(0, 20000, 40).union(spark.range(0, 200, 40)).withColumnRenamed("id", "x")
    got = common.sieved(df, "id", wanted, "hit")
    assert got.columns == [*df.columns, "hit"]
    hit = {r.id: r.hit for r in got.collect()}
    assert len(hit) == got.count() == 20000
    assert all(hit[k] for k in range(0, 20000, 40))
    assert sum(hit.values()) < 0.2 * 20000
    assert not any(r.hit for r in common.sieved(df, "id", wanted.limit(0), "hit").collect())


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 103: 100}


def test_match_threshold():
    t = op7.matches_needed(85)
    assert 20 < t < 30
    assert op7.matches_needed(80) < t


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert op2.substring_dedup(none).count() == 0
    assert op7.near_duplicates(none).count() == 0
    assert op2.longest_repeats(none).count() == 0
