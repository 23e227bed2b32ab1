"""Divergence, byte-level deduplication and the manifest against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, frame, prose, rows, sha

from auditlake.llm import op11_divergence as op11
from auditlake.llm import op12_suffixes as op12
from auditlake.llm import op13_manifest as op13

# ---------------------------------------------------------------- divergence


def diverging(data, min_docs, top):
    """The rows of the result, by the definition."""
    d = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, lang, source, *_ in data]
    out = Counter()
    for lang in {x[0] for x in d}:
        docs = [x for x in d if x[0] == lang]
        held = Counter(t for x in docs for t in set(x[2]))
        kept = sorted(t for t in held if held[t] >= min_docs)
        groups = sorted({x[1] for x in docs})
        count = {s: Counter(t for x in docs if x[1] == s for t in x[2] if held[t] >= min_docs) for s in groups}
        whole = sum(count.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        of, q = {s: p(count[s]) for s in groups}, p(whole)
        for s in groups:
            terms = sorted(((-f(of[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] and of[s][t] > q[t]))
            for k, (v, _, t) in enumerate(terms[:top]):
                out[lang, s, "term", t, -v, k + 1] += 1
            pairs = sorted((-sum(f(of[s][t], of[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            for k, (v, _, o) in enumerate(pairs):
                out[lang, s, "pair", o, -v, k + 1] += 1
    return out


def sources(seed):
    """Few words and many ties, sources that lack them, one source with a third of all rows."""
    rnd = random.Random(seed)
    data = [(k, prose(rnd, rnd.randint(0, 30), "abçÀ"), rnd.choice(["en", "de", None]), "hot" if k % 3 == 0 else f"s{rnd.randint(0, 9)}", 1) for k in range(150)]
    return [*data, (900, "12 :: 34", "fr", "a", 1), (901, None, "fr", "b", 1), (902, "x", "fr", None, 1)]


def found(df):
    return Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("min_docs", "top", "bits"), [(1, 3, 8), (4, 10, 1)])
def test_divergence_matches_brute_force(spark, monkeypatch, min_docs, top, bits):
    # with one bit, a language's sources go in several blocks
    monkeypatch.setattr(op11, "BLOCK_BITS", bits)
    data = sources(min_docs)
    assert found(op11.divergence(frame(spark, data), min_docs, top)) == diverging(data, min_docs, top)


def test_divergence_of_awkward_documents(spark):
    assert found(op11.divergence(frame(spark), 2, 10)) == diverging(rows(), 2, 10)
    assert op11.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ties_are_refined_by_bytes(spark):
    """Equal values and long common beginnings: the bytes decide."""
    names = ["z" * 40 + x for x in "edcbaé"] + ["z" * 40, "z" * 39]
    data = [(k, " ".join(names), "en", "s1", 1) for k in range(2)] + [(9, "other " * 50, "en", "s2", 1)]
    got = found(op11.divergence(frame(spark, data), 1, 3))
    assert got == diverging(data, 1, 3)
    assert ("en", "s1", "term", "z" * 39, 1) in {x[:4] + (x[5],) for x in got}


# ---------------------------------------------------------------- bytes that repeat


def bytes_removed(data, width):
    order = lambda i: float("inf") if i is None else i
    texts = [(i, (t or "").encode()) for i, t, *_ in data]
    first = {}
    for i, b in texts:
        for k in range(len(b) - width + 1):
            first[b[k : k + width]] = min(first.get(b[k : k + width], float("inf")), order(i))
    out = Counter()
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < order(i):
                gone[k : k + width] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out[i, len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone, strict=False) if not g))] += 1
    return out


def cut(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def shared(seed):
    """Passages shared in part, edits, runs of one byte, cut characters."""
    rnd = random.Random(seed)
    base = prose(rnd, 60) + " ünïcödé 😀😀 " + prose(rnd, 20)
    out = []
    for k in range(60):
        x, y = sorted(rnd.sample(range(len(base)), 2))
        piece = list(base[x:y])
        for _ in range(rnd.choice([0, 0, 1, 3])):
            if piece:
                piece[rnd.randrange(len(piece))] = rnd.choice("aé😀")
        out.append((rnd.randint(0, 40), prose(rnd, rnd.randint(0, 9)) + "".join(piece) + prose(rnd, 3), None, None, None))
    return [*out, (50, "a" * 300, None, None, None), (51, "b" + "a" * 120, None, None, None), (52, "ab" * 90, None, None, None), (53, "é" * 49 + "a" * 49, None, None, None)]


@pytest.mark.parametrize(("width", "hot"), [(50, 1 << 16), (20, 3), (50, 2)])
def test_bytes_match_brute_force(spark, width, hot):
    data = rows() + shared(width + hot)
    assert cut(op12.suffix_dedup(frame(spark, data), width, hot_places=hot)) == bytes_removed(data, width)


def test_bytes_of_files_in_place(spark, tmp_path):
    data = rows() + shared(1)
    frame(spark, data).repartition(5).write.parquet(str(tmp_path / "d"))
    assert cut(op12.suffix_dedup(spark.read.parquet(str(tmp_path / "d")), in_place=True)) == bytes_removed(data, 50)


def test_bytes_of_no_documents(spark):
    assert op12.suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_kept_positions_cover_every_window():
    data = np.frombuffer((prose(random.Random(1), 400) + "a" * 200).encode(), np.uint8)
    offsets = np.array([0, 30, 30, 700, len(data)])
    _, first, last, text = op12.positions_of(data, offsets, 50)
    starts = [s for a, b in zip(first.tolist(), last.tolist(), strict=True) for s in range(a, b + 1)]
    assert starts == [s for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for s in range(a, b - 49)]
    assert all(offsets[t] <= a and b + 50 <= offsets[t + 1] for a, b, t in zip(first, last, text, strict=True))


# ---------------------------------------------------------------- manifest


def listed(data):
    """The manifest's rows, built level by level from lists."""

    def leaf(i, t, lang, source, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, at):
        for level in levels[:-1]:
            yield at % 2, level[at ^ 1 : (at ^ 1) + 1]
            at //= 2

    order = sorted({x[2] for x in data}, key=lambda x: (x is not None, (x or "").encode()))
    rows_of = {lang: sorted((x for x in data if x[2] == lang), key=lambda x: (x[0] is not None, x[0] or 0, leaf(*x))) for lang in order}
    trees = {lang: tree([leaf(*x) for x in rows_of[lang]]) for lang in order}
    top = tree([trees[lang][-1][0] for lang in order])
    out = Counter()
    for k, lang in enumerate(order):
        for at, x in enumerate(rows_of[lang]):
            steps = [*path(trees[lang], at), *path(top, k)]
            hit = x[0] is not None and x[4] is not None and zlib.crc32(str(x[0]).encode()) % 7 == 0
            node = leaf(*x[:4], x[4] + 1) if hit else leaf(*x)
            for right, sibling in steps:
                node = sha("".join([*sibling, node] if right else [node, *sibling]))
            out[x[0], leaf(*x), trees[lang][-1][0], top[-1][0], sha("".join(s for _, ss in steps for s in ss)), node, node == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_matches_lists(spark, bits):
    data = rows() + [(1000 + k, "é" * k, f"l{k % 6}", "s", k) for k in range(40)] + [(None, "x", "zz", None, (1 << 63) - 1), (7, "x", "one", None, (1 << 63) - 1)]
    got = Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in op13.manifest(frame(spark, data), bits).collect())
    assert got == listed(data)
    assert {x[-1] for x in got} == {True, False}


def test_manifest_of_little(spark):
    one = op13.manifest(frame(spark, [(3, "t", "en", "s", 1)])).first()
    assert one.leaf == one.subroot == one.root == one.folded_root
    assert one.proof_sha256 == sha("")
    assert op13.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
