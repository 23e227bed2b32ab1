import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, by_id, frame, rows, sha

from auditlake.llm import op1_pii as op1
from auditlake.llm import tagger as tg

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_definition(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and op1.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((k, *m.span()))
    return out


def test_base_spans_follow_the_patterns():
    rnd = random.Random(1)
    letters = "a.b@-_%+1 2(3)4.5\n\té"
    for k in range(20000):
        s = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        if k % 50 == 0:
            s += "4111 1111-1111 1111" + s + "1.2.3.4.5.6.7.8" + "a@b.c_d@e.f@g.h"
        assert op1.base_spans(s) == by_definition(s), repr(s)


def test_long_runs_take_linear_time():
    for s in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 100_000, "+1" * 100_000):
        op1.emails(s)
        op1.IP.findall(s)
        op1.PHONE.findall(s)


@pytest.fixture(scope="module")
def trained(spark):
    text = [(k, f"mail {k}.x@mail{k % 9}.example.com or +1 (523) 555-{1000 + k} from {k % 250}.1.2.3 today", "en", "s", 1) for k in range(200)]
    return op1.train_tagger(frame(spark, text))


def test_tagger_adds_what_the_patterns_miss(trained):
    texts = ["please call (523) 555-1055 tomorrow", "no numbers here", "in 2021-10-12 we had 4465758382 items", "the rest of it " * 30 + "call 310-555-4510 now " + "and so on " * 30]
    (_, a), (_, b), (_, c), (_, d) = op1.all_spans(trained, texts)
    assert [(k, texts[0][s:e]) for k, s, e in a] == [(3, "(523) 555-1055")]
    assert not b
    assert not c
    assert [texts[3][s:e] for _, s, e in d] == ["310-555-4510"]


def test_spans_are_no_parts_of_longer_runs(trained):
    texts = ["id 4f41111111111111115a9 and more", "key a1b2(523) 555-1055x9 end"]
    assert all(not added for _, added in op1.all_spans(trained, texts))


def held_out_texts(seed, n):
    """Texts with numbers written as the patterns miss them, in other surroundings than the tagger learned from, and with harmless numbers."""
    rnd = random.Random(seed)
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    filler = "please the office reach between monday order under account about with for was them team send next".split()
    say = lambda k: " ".join(rnd.choice(filler) for _ in range(k))
    makers = [
        (3, lambda: f"({num(3)}) {num(3)}-{num(4)}"),
        (3, lambda: f"{num(3)}-{num(3)}-{num(4)}"),
        (0, lambda: f"{rnd.choice(filler)} [at] {rnd.choice(filler)} [dot] com"),
        (1, lambda: " . ".join(str(rnd.randint(1, 255)) for _ in range(4))),
        (None, lambda: f"{rnd.randint(1990, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}"),
        (None, lambda: f"{num(2)}:{num(2)}"),
        (None, lambda: f"${num(1)},{num(3)}.{num(2)}"),
        (None, lambda: f"#{num(6)}"),
        (None, lambda: "at home"),
    ]
    for k in range(n):
        kind, make = makers[k % len(makers)]
        before, span = say(rnd.randint(1, 30)), make()
        yield f"{before} {span} {say(rnd.randint(1, 30))}", None if kind is None else (kind, len(before) + 1, len(before) + 1 + len(span))


def test_held_out_precision_and_recall(trained):
    data = list(held_out_texts(11, 900))
    found = op1.all_spans(trained, [t for t, _ in data])
    wanted = sum(w is not None for _, w in data)
    touched = lambda w, x: x[0] == w[0] and x[1] < w[2] and x[2] > w[1]
    caught = sum(w is not None and any(touched(w, x) for x in every) for (_, w), (_, every) in zip(data, found, strict=True))
    exact = sum(w is not None and w in every for (_, w), (_, every) in zip(data, found, strict=True))
    added = [(w, x) for (_, w), (_, every) in zip(data, found, strict=True) for x in every]
    right = sum(w is not None and touched(w, x) for w, x in added)
    print(f"recall {caught / wanted:.3f}, exact {exact / wanted:.3f}, precision {right / max(1, len(added)):.3f}")
    assert caught / wanted > 0.8
    assert right / len(added) > 0.9


def test_a_long_stretch_of_numbers_is_bounded(trained):
    import tracemalloc

    rnd = random.Random(4)
    text = " ".join(str(rnd.randint(0, 99999)) for _ in range(60_000)) + " (523) 555-1055 " + " ".join(str(rnd.randint(0, 99)) for _ in range(300))
    tracemalloc.start()
    ((_, spans),) = op1.all_spans(trained, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    assert all(a < b for _, a, b in spans)


def test_addresses_without_digit_or_at_sign(trained):
    texts = ["write to jane [at] corp [dot] com", "so on " * 40 + "mail word(at)tenor.org or not " + "and on " * 40, "we met at noon and sat at home all day"]
    (_, a), (_, b), (_, c) = op1.all_spans(trained, texts)
    assert [k for k, *_ in a] == [0]
    assert " [at] corp" in texts[0][a[0][1] : a[0][2]]
    assert [k for k, *_ in b] == [0]
    assert "(at)tenor" in texts[1][b[0][1] : b[0][2]]
    assert not c


def test_query_columns(spark, trained):
    data = rows() + [(500, "é a.b@c.de, 10.0.0.1 and 4111 1111 1111 1111; +44 20 7946 0958", "en", "s", 1)]
    got = by_id(op1.find_personal_data(frame(spark, data).select("doc_id", "text"), trained))
    for i, t, *_ in data:
        base = by_definition(t)
        for r in got[i]:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in base) for k in range(4))
            assert r.base_sha256 == sha(op1.written(base))
            assert set(filter(None, op1.written(base).split(","))) <= set(r.spans.split(","))
    assert op1.written(by_definition(data[-1][1])) == "email:2:10,ip:12:20,card:25:44,phone:46:62"


def test_redaction_keeps_columns(spark, trained):
    data = [(1, "mail a@b.cd now", None, None, None), (2, None, None, None, None), (1, "mail a@b.cd now", None, None, None)]
    docs = frame(spark, data)
    out = op1.find_personal_data(docs, trained, redact=True)
    assert out.columns == docs.columns
    assert sorted(str(r.text) for r in out.collect()) == ["None", "mail [email] now", "mail [email] now"]
    assert op1.redacted("abcdef", [(0, 1, 3), (3, 2, 5)]) == "a[email]f"
    none = spark.createDataFrame([], SCHEMA)
    assert op1.find_personal_data(none, op1.train_tagger(none)).count() == 0


def test_gradients():
    r, t = np.random.default_rng(0), tg.Tagger(4, 3)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    ids, tags = r.integers(0, tg.LETTER_COUNT, (2, 6)), np.array([[0, 1, 2, 2, 0, 3], [0, 0, 5, 6, 0, 0]])
    _, g = t.gradients(ids, tags)
    for k, v in t.p.items():
        at = tuple(r.integers(0, s) for s in v.shape)
        if k == "e":
            at = (ids[0, 2], 1)
        v[at] += 1e-4
        up, _ = t.gradients(ids, tags)
        v[at] -= 2e-4
        down, _ = t.gradients(ids, tags)
        v[at] += 1e-4
        assert g[k][at] == pytest.approx((up - down) / 2e-4, abs=2e-3), k


def test_paths_and_marginals():
    r = np.random.default_rng(1)
    scores, moves = r.normal(size=(3, 5, tg.TAGS)), tg.allowed()
    _, exact, _ = tg.crf_marginals(scores, moves)
    assert np.allclose(exact, tg.crf_tags(scores, moves), atol=1e-6)
    path = tg.best_path(scores, moves, np.array([5, 3, 1]))
    for n, length in enumerate((5, 3, 1)):
        total = lambda p: scores[n, range(len(p)), p].sum() + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max((total([*p]) for p in __import__("itertools").product(range(tg.TAGS), repeat=min(length, 3))), default=0) if length <= 3 else None
        if best is not None:
            assert total(path[n, :length].tolist()) == pytest.approx(best)


def test_texts_of_a_batch_become_strings_in_parts():
    """Not all of a batch at once, and null ones stay."""
    context = SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))
    docs = SimpleNamespace(columns=["doc_id", "text"], schema=None, sparkSession=SimpleNamespace(sparkContext=context), mapInArrow=lambda f, schema: f)
    text = pa.array(["x " * 250_000, None] * 32)
    run = op1.find_personal_data(docs, op1.Tagger(), redact=True)
    tracemalloc.start()
    out = [x.column(1) for x in run([pa.RecordBatch.from_arrays([pa.array(range(64)), text], ["doc_id", "text"])])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pa.chunked_array(out).combine_chunks() == text and len(out) > 1
    assert peak < 14 << 20
