import gzip
import hashlib
import random
import sys
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, by_id, frame, rows, sha

from auditlake.llm import op3_fingerprint as op3
from auditlake.llm import op4_bpe as op4
from auditlake.llm import op5_warc as op5
from auditlake.llm.common import shared_path


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(op3, "STRETCH", 7)
    data = rows()
    order = sorted([(i is not None, i or 0, t or "") for i, t, *_ in data])
    want = {}
    for k, (_, i, t) in enumerate(order):
        follow, half = order[(k + 1) % len(order)][2], len(t) // 2
        want.setdefault((i, t), []).append(t[: len(t) - half] + follow[:half])
    got = op3.fingerprints(frame(spark)).collect()
    assert len(got) == len(data)
    text_of = {i: t or "" for i, t, *_ in data}
    for r in got:
        assert r.edited in want[r.doc_id or 0, text_of[r.doc_id]]
        assert r.n_chars == len(text_of[r.doc_id])
        assert 0 <= r.near_next <= 1
        assert 0 <= r.near_edited <= 1
    prints = {}
    for r in got:
        prints.setdefault(text_of[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    assert len({next(iter(x)) for x in prints.values()}) == len(prints)


def test_fingerprint_digests_and_edges(spark):
    one = op3.fingerprints(frame(spark, [(1, "abcdef", None, None, None)]), digests=True).first()
    assert one.edited_sha256 == sha("abcabc")
    assert one.near_next == 1.0
    assert op3.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spans_and_common_extension():
    h, rnd = op3.Hasher(), random.Random(2)
    text = "".join(rnd.choice("ab\U0001f600") for _ in range(300))
    p = h.prefixes(text)
    for _ in range(200):
        a, b, n = rnd.randrange(250), rnd.randrange(250), rnd.randrange(50)
        x, y = h.spans(p, np.array([a, b]), np.array([n, n]))
        assert (x == y) == (text[a : a + n] == text[b : b + n])
    assert op3.common_prefix(h, text, text[:120] + "?" + text[121:]) == 120
    assert op3.common_prefix(h, "", text) == 0
    near = op3.likeness(h.fingerprint(text), h.fingerprint(text[:200] + "x" * 100))
    assert near > 0.5 > op3.likeness(h.fingerprint(text), h.fingerprint("z" * 300))


def brute_likeness(a, b):
    """Likeness from the texts themselves."""
    if a == b:
        return 1.0
    shortest = min(len(a), len(b))
    if not shortest:
        return 0.0
    h, p, base = op3.Hasher(), op3.PRIMES[0], op3.BASES[0]

    def cut(text):
        value = [sum((ord(c) + 1) * pow(base, j, p) for j, c in enumerate(text[i : i + op3.WINDOW])) % p for i in range(len(text) - op3.WINDOW + 1)]
        at = [0]
        for i in range(op3.REACH, len(value) - op3.REACH):
            if value[i] < min(value[i - op3.REACH : i]) and value[i] <= min(value[i + 1 : i + op3.REACH + 1]):
                at.append(i)
        return [(i, text[i:j]) for i, j in zip(at, at[1:] + [len(text)])]

    before = max((int(x) for x in op3.rungs(shortest) if a[:x] == b[:x]), default=0)
    after = max((int(x) for x in op3.rungs(shortest) if a[len(a) - x :] == b[len(b) - x :]), default=0)
    after = min(after, shortest - before)
    one, two = cut(a), cut(b)
    assert [i for i, _ in one][1:] == h.places(h.prefixes(a)).tolist()

    def covered(mine, theirs, n):
        rest, inside = [t for _, t in theirs], 0
        for i, t in mine:
            if i + len(t) > before and i < n - after and t in rest:
                rest.remove(t)
                inside += sum(before <= k < n - after for k in range(i, i + len(t)))
        return inside

    inner = min(covered(one, two, len(a)), covered(two, one, len(b)))
    return min(before + after + inner, shortest) / max(len(a), len(b))


def test_likeness_equals_brute_force():
    rnd, h = random.Random(5), op3.Hasher()
    assert h.places(h.prefixes("ab" * 5000)).size == 0
    for k in range(40):
        a = "".join(rnd.choice("abcdé ") for _ in range(rnd.choice([0, 1, 20, 300, 1500])))
        at = rnd.randint(0, len(a))
        moved = a[len(a) // 3 :] + a[: len(a) // 3]
        for b in (a, a[:at] + "X" + a[at + 1 :], a[:at], moved, a * 2, "Y" + a[1:-1] + "Z", "q" * 200):
            got = op3.likeness(h.fingerprint(a), h.fingerprint(b))
            assert got == brute_likeness(a, b) == op3.likeness(h.fingerprint(b), h.fingerprint(a)), (k, len(a), len(b))


def test_likeness_of_texts_changed_at_both_ends():
    rnd, h = random.Random(6), op3.Hasher()
    a = "".join(rnd.choice("abcdefghij ") for _ in range(20000))
    b = a[:50] + "changed" + a[55:-60] + "also changed" + a[-50:]
    assert op3.likeness(h.fingerprint(a), h.fingerprint(b)) > 0.95
    assert op3.likeness(h.fingerprint(a), h.fingerprint(a[7000:] + a[:7000])) > 0.95


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op4.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, library):
    got = by_id(op4.encode(frame(spark), digests=True, lexicon_words=50))
    for i, t, *_ in rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        for r in got[i]:
            assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
            assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
    ids = {r.doc_id: list(r.ids) for r in op4.encode(frame(spark)).collect()}
    assert ids[16] == library.encode(rows()[17][1], add_special_tokens=False).ids
    assert op4.encode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bpe_of_any_text_equals_the_library(library):
    with open(op4.default_vocabulary(), encoding="utf-8") as f:
        merger = op4.Merger(f.read())
    rnd = random.Random(1)
    letters = "aAbzZ'stré́ÉÎßΣςİı½٣中ㅎ각­\u0085\xa0 ​\x1c!?<>|endoftext_…'ll9&ΩẞÀ😀"
    for k in range(4000):
        s = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) * (40 if k % 400 == 0 else 1)
        if k % 7 == 0:
            s = s[:5] + "<|endoftext|>" + s[5:]
        got = [i for p in s.encode().split() for i in merger.encode(p.decode())]
        assert got == library.encode(s, add_special_tokens=False).ids, repr(s)


def test_bpe_merges_many_pieces_together(library, monkeypatch):
    with open(op4.default_vocabulary(), encoding="utf-8") as f:
        merger = op4.Merger(f.read())
    rnd = random.Random(2)
    # lengths about the groups' bounds, and beyond the last; letters of one and two bytes, digits, signs, other scripts
    pieces = ["".join(rnd.choice(letters) for _ in range(rnd.choice((*range(1, 15), 24, 25, 31, 32, 33, 70)))) for letters in ("etaonrish", "etaonrishÉßü1½&.", "enstdr'lvem", "ητ각😀ĕab") for _ in range(700)]
    pieces += ["a", "aaaaaaaaaaaaaaaa", "<|endoftext|>", "x<|endoftext|>'s", "it's", "\x1c", "the", "e\u0301"]
    whole = [p.encode() for p in pieces if len(p.encode().split()) == 1]
    want = {w: library.encode(w.decode(), add_special_tokens=False).ids for w in whole}
    tokens = merger.tokens()
    assert all(op4.decode(ids, tokens).decode() == library.decode(ids, skip_special_tokens=False) for ids in want.values())
    for step in (op4.STEP_BYTES, 1000, 1):
        monkeypatch.setattr(op4, "STEP_BYTES", step)
        got, parts = {}, 0
        for words, ids, ends in merger.encoded(whole):
            got |= {w: x.tolist() for w, x in zip(words, np.split(ids, ends[:-1]), strict=True)}
            parts += 1
        assert got == want
        assert parts == 2 if step > 1000 else parts > 20
    monkeypatch.undo()
    assert [*merger.encoded([])] == []
    # Python's own work does not grow with the words: none of those below is merged by itself
    monkeypatch.setattr(merger, "merge_long", None)
    monkeypatch.setattr(merger, "words", None)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    many = [f"{k:x}".translate(str.maketrans("0123456789", "ghijklmnop")).encode() for k in range(50_000)]
    sys.setprofile(count)
    try:
        ((words, ids, ends),) = merger.encoded(many)
    finally:
        sys.setprofile(None)
    assert (words, len(ends)) == (many, len(many))
    assert calls < 5000


def test_lexicon_is_minimal_and_survives_its_file(tmp_path):
    words = sorted({w.encode() for w in "walk walks walked walking talk talks talked talking a an und ü".split()})
    entries = [(w, [k, k + 1]) for k, w in enumerate(words)]
    op4.Lexicon.compile(entries).save(str(tmp_path / "l.npy"))
    lexicon = op4.Lexicon.mapped(str(tmp_path / "l.npy"))
    assert lexicon.lookup(words).tolist() == list(range(len(words)))
    assert lexicon.lookup([b"wal", b"", b"walkss", b"zz", b"und"]).tolist()[:4] == [-1] * 4
    assert [lexicon.ids[lexicon.starts[k] : lexicon.starts[k + 1]].tolist() for k in range(3)] == [[0, 1], [1, 2], [2, 3]]
    # walk and talk share all that follows
    assert len(lexicon.final) < 25
    assert op4.Lexicon.compile([]).lookup([b"x"]).tolist() == [-1]


PAGES = [(1, "http://a/", "x" * 1500), (2, "http://b/", "x" * 1500), (3, None, None), (4, "http://c/ d\r\nX: y", "short"), (5, "http://d/", "short"), (6, "u", "é" * 700), (None, "n", "x" * 1500), (7, "v", "é" * 700), (7, "v", "é" * 700), (8, "", "a\r\n\r\nWARC/1.1\r\n" * 100)]


def page_frame(spark, data):
    from pyspark.sql import functions as F

    return spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("top", F.lit(1))


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(op5, "ARCHIVE_BYTES", 600)
    folder = shared_path(spark, "test-warc")
    index = op5.write_archives(page_frame(spark, PAGES), folder)
    got = op5.read_records(index, folder, html=True).collect()
    assert len(got) == len(PAGES)
    top = {}
    for i, _, html in PAGES:
        raw = (html or "").encode()
        if len(raw) >= 1000:
            top[raw] = max(top.get(raw, -1), -1 if i is None else i)
    html_of = {i: (h or "").encode() for i, _, h in PAGES}
    for r in got:
        raw = html_of[r.page_id]
        refers = top[raw] if raw in top and top[raw] != r.page_id and sum((h or "").encode() == raw for _, _, h in PAGES) > 1 else None
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == ("revisit" if refers is not None else "response", refers)
        assert (r.html or "").encode() == (raw if refers is None else b"")
    # the index names each record's bytes, whoever reads them
    store, path = op5.open_store(folder)
    x = index.where("page_id = 8").first()
    with store.open_input_file(f"{path}/{x.archive}") as f:
        assert gzip.decompress(f.read_at(x.length, x.offset)).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    empty = shared_path(spark, "test-warc")
    assert op5.read_records(op5.write_archives(page_frame(spark, []), empty), empty).count() == 0


def test_pages_of_one_hot_payload_do_not_meet_in_one_task(spark, without_broadcast):
    from pyspark.sql import functions as F

    hot, twice = "h" * 1500, "t" * 1500
    data = [(k, "same", hot) for k in range(2000)] + [(5000 + k, f"u{k}", f"{k}" * 1200) for k in range(1200)] + [(9001, None, twice), (9002, None, twice)]
    # so few repeated payloads are all heavy; many more make the pair a light one
    data += [(20000 + k, f"v{k}", f"{k % 1500}-" * 600) for k in range(3000)]
    rows = op5.with_responses(page_frame(spark, data).repartition(4)).withColumn("task", F.spark_partition_id())
    got = {r.page_id: r for r in rows.collect()}
    assert len(got) == len(data)
    assert [got[k].refers_to for k in (0, 1998, 1999, 5000, 9001, 9002, 20000, 21500)] == [1999, 1999, None, None, 9002, None, 21500, None]
    tasks = Counter(got[k].task for k in range(2000))
    assert len(tasks) == 4
    assert max(tasks.values()) < 800
    assert len({got[k].task for k in (9001, 9002)}) == 1


def test_ranges_are_coalesced():
    got = list(op5.ranges([("a", 0, 10), ("a", 10, 10), ("a", 20 + op5.GAP_BYTES + 1, 5), ("b", 0, 3)]))
    assert [(a, s, e, len(g)) for a, s, e, g in got] == [("a", 0, 20, 2), ("a", 20 + op5.GAP_BYTES + 1, 25 + op5.GAP_BYTES + 1, 1), ("b", 0, 3, 1)]


def test_damaged_records_are_found():
    good = op5.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "2000-01-01T00:00:00Z")
    assert op5.parse(good)[1] == b"payload"
    with pytest.raises(ValueError, match="disagree"):
        op5.parse(good.replace(b"payload", b"paylord"))
