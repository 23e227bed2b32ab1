import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, by_id, frame, rows, words
from pyspark.sql import functions as F

from auditlake.llm import op6_langid as op6
from auditlake.llm import op8_mixing as op8
from auditlake.llm import op9_quality as op9
from auditlake.llm import op10_lm as op10

# ---------------------------------------------------------------- quality


def base_figures(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = set()
    for k in range(len(w) - 7):
        if grams[tuple(w[k : k + 8])] > 1:
            again |= set(range(k, k + 8))
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_quality_base(spark):
    extra = [(200, "a b c d e f g h i\n" * 3 + "tail # of | it", "en", "s1", 1), (201, "\n\n x \n x \ny", "en", None, 1)]
    got = by_id(op9.quality(frame(spark, rows() + extra)))
    for i, t, *_ in rows() + extra:
        for r in got[i]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_figures(t)
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert op9.quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quality_rejects_what_is_left_of_boilerplate(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    banner = " ".join(word() for _ in range(30))
    data = [(k, banner + "\n" + " ".join(word() for _ in range(60)), None, "h", 1) for k in range(30)]
    data += [(100, banner.upper() + "\n" + " ".join(word() for _ in range(5)), None, "h", 1), (101, banner, None, "other", 1)]
    data += [(300 + k, banner + "\ncopy", None, "copies", 1) for k in range(30)]
    got = {r.doc_id: r for r in op9.quality(frame(spark, data)).collect()}
    assert all(got[k].kept and got[k].n_removed_words == 30 for k in range(30))
    assert not got[100].kept
    # another host, and a line that only copies of one page hold
    assert got[101].kept
    assert all(got[300 + k].kept for k in range(30))


def test_quality_counts_lines_of_any_length(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    banner = " ".join(word() for _ in range(60))
    data = [(k, banner + "\n" + " ".join(word() for _ in range(100)), None, "h", 1) for k in range(30)]
    data += [(100, banner + "\n" + " ".join(word() for _ in range(5)), None, "h", 1), (101, banner, None, "other", 1)]
    got = {r.doc_id: r for r in op9.quality(frame(spark, data)).collect()}
    assert all(got[k].kept and got[k].n_removed_words == 60 for k in range(30))
    assert not got[100].kept
    assert got[100].n_removed_words == 60
    assert got[101].kept
    assert got[101].n_removed_words == 0


def test_quality_of_a_host_that_is_mostly_copies(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    banner = " ".join(word() for _ in range(30))
    data = [(k, banner + "\n" + " ".join(word() for _ in range(5 if k == 0 else 60)), None, "h", 1) for k in range(12)]
    data += [(100 + k, data[1][1], None, "h", 1) for k in range(700)]
    got = {r.doc_id: r for r in op9.quality(frame(spark, data)).collect()}
    assert all(r.n_removed_words == 30 for r in got.values())
    assert [i for i, r in got.items() if not r.kept] == [0]


def test_lines_of_one_hot_banner_do_not_meet_in_one_task(spark, without_broadcast):
    banner = "one two three"
    data = [(k, f"{banner}\n{banner}\nown {k}", None, "h", 1) for k in range(1500)]
    data += [(5000 + k, f"footer {k // 12}\nline {k}", None, "few" if k < 120 else "g", 1) for k in range(3000)]
    features = op9.stored(op9.features(frame(spark, data).repartition(4)), "quality")
    got = op9.removed_lines(features).withColumn("task", F.spark_partition_id()).join(features.select("row", "doc_id"), "row").collect()
    tasks = Counter(r.task for r in got if r.doc_id < 5000)
    assert sum(tasks.values()) == 3000
    assert max(tasks.values()) < 1200
    # a light line of a host of 120 documents is above its limit, one of a host of 2880 is not
    assert sorted(r.doc_id for r in got if r.doc_id >= 5000) == list(range(5000, 5120))


# ---------------------------------------------------------------- mixing


def targets(size, weights=(1, 2, 3), most=3):
    """Shares by weight; what is above a limit is given to the others again and again."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(size.values()), {}
    while True:
        rest, w = total - sum(capped.values()), sum(weight[s] for s in names if s not in capped)
        out = capped | {s: rest * weight[s] / w for s in names if s not in capped}
        over = [s for s in names if s not in capped and out[s] > most * size[s] + 1e-9]
        if not over:
            return out
        capped |= {s: most * size[s] for s in over}


def test_targets_and_mix(spark):
    rnd = random.Random(9)
    data = [(k, "w " * rnd.randint(0, 60), None, rnd.choice(["a", "b", "c", "d", None, "é"]), 1) for k in range(1500)]
    data += [(5000 + k, "w " * 3, None, "tiny", 1) for k in range(3)] + [(6000, None, None, "void", 0), (6001, "w w", None, "a", 1), (6001, "w w", None, "a", 1)]
    found = op8.mix_sources(frame(spark, data)).collect()
    size = Counter()
    for _, t, _, s, _ in data:
        size[s] += len(words(t))
    want = targets(size)
    taken = Counter()
    for r in found:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in size:
        assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]), s
    again = op8.mix_sources(frame(spark, data).repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    # whole rows: equal rows are taken equally often
    out = Counter((r.doc_id, r.text) for r in op8.mixed(frame(spark, data)).collect())
    assert out[6001, "w w"] % 2 == 0
    assert sum(len(words(t)) * n for (_, t), n in out.items()) == sum(taken.values())
    assert op8.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("docs", [20, 50, 300])
def test_rounding_keeps_the_expected_copies(spark, docs):
    """Over many sources documents are taken about as often as their fraction says, large and small ones alike, with all of them at the root or few."""
    data = [(k, "w " * (1 + k // sources % 50), None, f"s{k % sources:03}", 1) for sources in [6000 // docs] for k in range(6000)]
    found = op8.mix_sources(frame(spark, data)).collect()
    error = {large: np.mean([r.copies - r.target / r.source_size for r in found if (r.size > min(docs, 50) // 2) == large]) for large in (False, True)}
    assert abs(error[False]) < 0.03
    assert abs(error[True]) < 0.03
    taken, target = Counter(), {}
    for r in found:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 5 for s in target)


# ---------------------------------------------------------------- language model


def test_language_model(spark):
    rnd = random.Random(4)
    vocabulary = ["the", "of", "a"] + ["".join(rnd.choice("abcdef") for _ in range(4)) for _ in range(60)]
    data = rows() + [(1000 + k, " ".join(rnd.choice(vocabulary[: 5 + k % 50]) for _ in range(rnd.randint(0, 60))), None, None, 1) for k in range(150)]
    got = by_id(op10.scores(frame(spark, data)))
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*words((t or "").translate(low)), None]
    c = Counter(w for i, t, *_ in data if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    gain = 0
    for i, t, *_ in data:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n)
            assert r.base_score == pytest.approx(base)
            assert r.score < 0
            gain += (r.score - r.base_score) * r.held_out
    assert gain > 0
    assert op10.scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_language_model_equals_its_formula(spark):
    """Scores from plain counts and the weights the operator learned."""
    data = [(k, x, None, None, 1) for k, x in enumerate(["a b a b", "a b c", "b a b", "c c", "a", "", "b c a b a b"] * 6)]
    learned = {}
    real = op10.learned_weights

    def spy(*args):
        learned["w"] = real(*args)
        return learned["w"]

    op10.learned_weights = spy
    try:
        got = by_id(op10.scores(frame(spark, data)))
    finally:
        op10.learned_weights = real
    train = [t for i, t, *_ in data if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(), Counter()
    for t in train:
        x = [*t.split(), "</s>"]
        one.update(x)
        two.update(zip(["</s>", *x[:-1]], x, strict=True))
    n, v = sum(one.values()), len(one)
    for i, t, *_ in data:
        x, want = [*t.split(), "</s>"], 0
        for u, w in zip(["</s>", *x[:-1]], x, strict=True):
            k = min(1 + int(math.log2(one[u])), op10.BUCKETS - 1) if one[u] else 0
            want += math.log10(learned["w"][k] @ np.array([two[u, w] / max(one[u], 1), one[w] / n, 1 / (v + 1)]))
        assert got[i][0].score == pytest.approx(want)
    assert np.allclose(learned["w"].sum(axis=1), 1)


def test_weights_leave_one_document_out(spark, monkeypatch):
    """Far fewer documents than any sample: weights are learned, from counts without the own document's."""
    rnd = random.Random(12)
    data = [(k, " ".join(rnd.choice("abcdefghijkl"[: 2 + k % 11]) for _ in range(rnd.randint(0, 40))), None, None, 1) for k in range(120)]
    learned = {}
    real = op10.learned_weights
    monkeypatch.setattr(op10, "learned_weights", lambda *args: learned.setdefault("w", real(*args)))
    op10.scores(frame(spark, data))
    of = lambda i: zlib.crc32(str(i).encode()) % 7
    pairs = {i: list(zip(["</s>", *t.split()], [*t.split(), "</s>"], strict=True)) for i, t, *_ in data if of(i) != 2}
    one, two = (Counter(key(x) for p in pairs.values() for x in p) for key in (lambda x: x[1], lambda x: x))
    n, v, parts, at = sum(one.values()), len(one), [], []
    for i, p in pairs.items():
        if of(i) != 3:
            continue
        own, own_two = Counter(w for _, w in p), Counter(p)
        for u, w in p:
            c = one[u] - own[u]
            at.append(1 + int(math.log2(c)) if c else 0)
            parts.append([(two[u, w] - own_two[u, w]) / max(c, 1), (one[w] - own[w]) / (n - len(p)), 1 / (v + 1)])
    want = op10.expectation_maximisation(np.array(parts), np.array(at))
    assert np.allclose(learned["w"], want, atol=1e-9)
    default = op10.expectation_maximisation(np.ones((0, 3)), np.zeros(0, np.int64))
    assert all(np.abs(learned["w"][b] - default[b]).max() > 0.01 for b in set(at))


def test_expectation_maximisation_finds_the_weights():
    r = np.random.default_rng(1)
    truth = np.array([0.6, 0.3, 0.1])
    # three token kinds, each likely under one estimate
    kinds = np.array([[0.8, 0.1, 0.1], [0.1, 0.7, 0.2], [0.1, 0.2, 0.7]])
    p = kinds @ truth
    seen = r.choice(3, 20000, p=p / p.sum())
    w = op10.expectation_maximisation(kinds[seen], np.full(20000, 3))
    assert np.abs(kinds @ w[3] / (kinds @ w[3]).sum() - p / p.sum()).max() < 0.02


# ---------------------------------------------------------------- language identification

LANGS = {"en": "the of and to in that house water", "de": "der die und das von mit haus wasser", "fr": "le la les des et dans maison eau"}


def say(rnd, lang, n):
    return " ".join(rnd.choice(LANGS[lang].split()) for _ in range(n))


def test_language_identification(spark):
    rnd = random.Random(8)
    data = [(k, say(rnd, lang := rnd.choice(list(LANGS)), rnd.randint(5, 60)), lang, None, 1) for k in range(300)]
    data += [(1000, None, "en", None, 0), (1001, "123 456 !!", "en", None, 1), (1002, "", None, None, 0), (1003, "\U0001f600", "fr", None, 1)]
    data += [(1004, say(rnd, "en", 60) + " " + say(rnd, "fr", 20), None, None, 1), (1005, say(rnd, "de", 20000), None, None, 1)]
    docs = frame(spark, data)
    held = op6.fold("doc_id", 4) == 2
    langs, table = op6.learn(docs.select("doc_id", "text", "lang").where(~held))
    assert langs == ["de", "en", "fr"]
    got = {r.doc_id: r for r in op6.predict(docs.select("doc_id", "text"), langs, table).collect()}
    out = [k for k in range(300) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([got[k].lang_pred == data[k][2] for k in out]) > 0.97
    for k in (1000, 1001, 1002, 1003):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    assert got[1004].lang_pred == "en"
    assert 0.6 < got[1004].score < 0.9
    assert got[1005].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())


def plain_inference(text, logs):
    """(language, proportion) by the definition, for one text; logs: log likelihoods of a word in each language."""
    w = [x for x in words(text.lower()) if any(chr(c).isalpha() or c > 127 for c in x)]
    k = len(logs(w[0], b""))
    like, behind = [], b""
    for x in words(text.lower()):
        if x in w:
            like.append([math.exp(v) for v in logs(x, behind)])
        behind = (behind + b"\0" + x)[-8:]
    fit = lambda share: sum(math.log(sum(share[j] * x[j] for j in share)) for x in like)
    chosen = [max(range(k), key=lambda j: (fit({j: 1}), -j))]
    share = {chosen[0]: 1}
    best, penalty = (fit(share), share), 0.5 * math.log(len(like) + 1)
    while len(chosen) < k:
        slope = {j: sum(x[j] / sum(share[i] * x[i] for i in share) for x in like) - len(like) for j in range(k) if j not in share}
        new = max(slope, key=lambda j: (slope[j], -j))
        if slope[new] <= penalty:
            break
        share = {j: v * len(chosen) / (len(chosen) + 1) for j, v in share.items()} | {new: 1 / (len(chosen) + 1)}
        chosen.append(new)
        for _ in range(op6.STEPS):
            share = {j: sum(share[j] * x[j] / sum(share[i] * x[i] for i in share) for x in like) / len(like) for j in share}
        value = fit(share) - penalty * (len(chosen) - 1)
        if value <= best[0]:
            break
        best = value, share
    top = max(best[1], key=lambda j: (best[1][j], -j))
    return top, best[1][top]


@pytest.mark.parametrize("dense", [64, 1, 0])
def test_language_inference_matches_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(op6, "DENSE", dense)
    rnd = random.Random(18)
    data = [(k, say(rnd, lang := rnd.choice(list(LANGS)), rnd.randint(3, 30)), lang, None, 1) for k in range(90)]
    mixed = [(1000 + k, say(rnd, "en", rnd.randint(1, 12)) + " " + say(rnd, "fr", rnd.randint(1, 12)) + " 12 " + say(rnd, "de", rnd.randint(0, 6)), None, None, 1) for k in range(40)]
    # copies of a row are learned from once
    docs = frame(spark, data + [data[0]] * 3 + mixed)
    langs, table = op6.learn(docs.select("doc_id", "text", "lang"))

    def number(n, c, k):
        if k in table["dense"]:
            return table["logs"][n, c, list(table["dense"]).index(k)]
        at, key = list(table["sparse"]).index(k), n * op6.CELLS + c
        stretch = slice(table["first"][key], table["first"][key + 1])
        return table["unseen"][n][at] + sum(v for j, v in zip(table["lang"][stretch], table["above"][stretch], strict=True) if j == at)

    assert len(table["dense"]) == min(dense, len(langs))
    # the table itself, from plain counts of n-grams
    cell = lambda gram, back: int(op6.mix(np.array([int.from_bytes(gram, "big") + back], np.uint64))[0] % op6.CELLS)
    seen = {(lang, o): Counter() for lang in langs for o in op6.ORDERS}
    for _, t, lang, *_ in data:
        raw = b"\0\0\0" + t.lower().encode().replace(b" ", b"\0")
        for at in range(3, len(raw)):
            for o in op6.ORDERS:
                if raw[at]:
                    seen[lang, o][cell(raw[at - o + 1 : at + 1], o - 1)] += 1
    for n, o in enumerate(op6.ORDERS):
        used = len(set().union(*(seen[lang, o] for lang in langs)))
        for k, lang in enumerate(langs):
            total = sum(seen[lang, o].values())
            for c in list(seen[lang, o])[:50]:
                want = math.log((seen[lang, o][c] + op6.SMOOTHING) / (total + op6.SMOOTHING * (used + 1))) / len(op6.ORDERS)
                assert number(n, c, k) == pytest.approx(want, rel=1e-5)

    def logs(word, behind):
        raw, out = b"\0\0\0" + behind + b"\0" + word, np.zeros(len(langs))
        for at in range(len(raw) - len(word), len(raw)):
            for n, o in enumerate(op6.ORDERS):
                out = out + np.array([number(n, cell(raw[at - o + 1 : at + 1], o - 1), k) for k in range(len(langs))])
        return out

    monkeypatch.setattr(op6, "STEP_BYTES", 7)
    got = {r.doc_id: r for r in op6.predict(docs.select("doc_id", "text"), langs, table).collect()}
    for i, t, *_ in mixed:
        top, share = plain_inference(t, logs)
        assert got[i].lang_pred == langs[top]
        assert got[i].score == pytest.approx(share, abs=1e-4)


def test_arrays_of_a_step_stay_small():
    """An executor holds those of every worker besides its heap, and workers keep what they once had."""
    r, n = np.random.default_rng(1), 10_000
    table = op6.tabled(r.integers(0, 4, n), r.integers(0, 2, n), r.integers(0, op6.CELLS, n), r.integers(1, 50, n), 4)
    data = np.frombuffer(b"word " * (op6.step_bytes(4) // 5), np.uint8)
    offsets = np.array([0, len(data)])
    tracemalloc.start()
    words = op6.Words(data, offsets, lower=True)
    logs = op6.word_logs(words, offsets, table)
    top = logs.max(axis=1)
    op6.proportions(np.exp(logs - top[:, None]), words.first, top)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20


def test_every_labelled_language_is_learned(spark, monkeypatch):
    """However many there are, and however rare."""
    monkeypatch.setattr(op6, "DENSE", 8)
    rnd = random.Random(5)
    own = [["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for _ in range(300)]
    text = lambda k, n: " ".join(rnd.choice(own[k]) for _ in range(n))
    data = [(100 * k + j, " ".join(rnd.sample(own[k], 30)), f"l{k:03}", None, 1) for k in range(300) for j in range(2 if k else 50)]
    langs, table = op6.learn(frame(spark, data).select("doc_id", "text", "lang"))
    assert langs == [f"l{k:03}" for k in range(300)]
    assert len(table["dense"]) == 8 and len(table["sparse"]) == 292
    asked = frame(spark, [(k, text(k, 20), None, None, 1) for k in range(300)] + [(1000 + k, text(k, 30) + " " + text(k + 100, 20), None, None, 1) for k in range(100)])
    got = {r.doc_id: r for r in op6.predict(asked.select("doc_id", "text"), langs, table).collect()}
    assert all(got[k].lang_pred == f"l{k:03}" and got[k].score == 1 for k in range(300))
    assert all(got[1000 + k].lang_pred == f"l{k:03}" and got[1000 + k].score == pytest.approx(0.6, abs=0.05) for k in range(100))


def test_no_larger_set_is_better_where_no_slope_exceeds_the_penalty():
    rnd = np.random.default_rng(4)
    for _ in range(20):
        like = rnd.random((60, 5)) ** 4
        like[:45, rnd.integers(5)] = 1
        like /= like.max(axis=1, keepdims=True)
        share, value = op6.proportions(like, np.array([0, 60]), np.zeros(60))
        mixed = like @ share[0]
        if ((like / mixed[:, None]).sum(axis=0) - 60 <= 0.5 * np.log(61)).all():
            full = np.full(5, 0.2)
            for _ in range(2000):
                full = (like * full / (like @ full)[:, None]).mean(axis=0)
            extra = 5 - np.count_nonzero(share[0])
            assert np.log(like @ full).sum() - 0.5 * np.log(61) * max(1, extra) <= np.log(mixed).sum() + 1e-6


def test_language_of_unlabelled_and_empty_tables(spark):
    docs = frame(spark, [(1, "some text", None, None, 1)])
    langs, table = op6.learn(docs.select("doc_id", "text", "lang"))
    assert op6.predict(docs.select("doc_id", "text"), langs, table).first().lang_pred == "und"
    none = spark.createDataFrame([], SCHEMA)
    assert op6.predict(none.select("doc_id", "text"), *op6.learn(none)).count() == 0


def test_proportions_of_a_mixture():
    like = np.array([[1, 0.01, 0.01]] * 30 + [[0.01, 1, 0.01]] * 10 + [[1, 0.02, 0.01]] * 5)
    share, _ = op6.proportions(like, np.array([0, 40, 45]), np.zeros(45))
    assert share[0] == pytest.approx([0.75, 0.25, 0], abs=0.02)
    assert share[1].tolist() == [1, 0, 0]


def test_fold_is_crc32(spark):
    got = spark.range(50).select("id", op6.fold("id", 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in got)
    assert spark.sql("SELECT CAST(NULL AS LONG) AS id").select(op6.fold(F.col("id") if False else "id", 7).alias("f")).first().f == 0
