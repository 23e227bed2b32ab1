"""Personal data by patterns and by a character tagger.

Patterns give the base spans of four kinds.  A bidirectional LSTM with CRF transitions
is trained from such labelled spans in a bounded sample of windows and from written-out
variants that the patterns miss.  It reads overlapping windows around every digit, @
and written-out at (' at ', '[at]', '(at)') of a text, one of which is in all that the
last rule below accepts; places that several windows cover get the mean of their decodings, nearer
the middle counting more, and one path over the whole stretch decides; a stretch longer than
PART goes in parts that overlap by MARGIN on either side, and a span is of the part it
starts in.  Its spans are added where they touch no base span, are no part of a longer
run of letters and digits, and hold what their kind must hold.

Defined cases: null text is empty and has no spans; repeated rows each get a result;
without any base span in the table the tagger learns from the written-out variants
alone; an empty table gives an empty result; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import documents
from auditlake.llm.tagger import KINDS, TAGS, Tagger, allowed, best_path, letter_ids

#: Windows that the tagger learns from, at most: one for each slot that a hash picks.
TRAIN_SLOTS = 800
#: Windows with written-out variants that it learns from besides.
VARIANTS = 1600
WINDOW, STRIDE, AROUND = 96, 48, 40
#: Characters of a stretch that are decoded together, and how far they reach into their neighbours.
PART, MARGIN = 1024, 192
#: Windows and stretches that are computed together.
BATCH = 512


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; looking back from each @ keeps long words linear."""
    out, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            after = found.end()
        else:
            after = at + 1
        at = text.find("@", max(at + 1, after))
    return out


# possessive parts and the look-behind change no match: what they skip cannot start or end one
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MAYBE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def ip_parts_fit(text: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not MAYBE.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if ip_parts_fit(m[0])]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def fits(kind: int, text: str) -> bool:
    """What a span of the tagger must hold."""
    n = len(digits_of(text))
    if kind == 0:
        return "@" in text[1:-1] or " at " in text or "[at]" in text or "(at)" in text
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(?:[.\x20]{1,3}[0-9]{1,3}){3}", text)) and all(int(x) <= 255 for x in re.findall("[0-9]+", text))
    if kind == 2:
        return 13 <= n <= 19 and luhn(digits_of(text))
    # an unbroken row of digits is a number of any sort
    return 9 <= n <= 15 and bool(re.search(r"[0-9][\x20().-]+[0-9]", text)) and not re.search(r"[A-Za-z]", text)


def tags_of(spans: list[tuple[int, int, int]], start: int, length: int) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        if a >= start and b <= start + length and not out[a - start : b - start].any():
            out[a - start : b - start] = 2 + 2 * kind
            out[a - start] = 1 + 2 * kind
    return out


def labelled_windows(docs: DataFrame) -> list[tuple[str, list[int]]]:
    """Texts of windows around digits and @ with their tags, one for each slot, the smallest hash first."""

    def run(batches):
        for batch in batches:
            out: dict[int, tuple[int, str, list[int]]] = {}
            for text in batch.column(0).to_pylist():
                if not text or not MAYBE.search(text):
                    continue
                spans, last = base_spans(text), -1
                for m in MAYBE.finditer(text):
                    if m.start() < last:
                        continue
                    last = m.start() + WINDOW
                    start = max(0, m.start() - WINDOW // 3)
                    part = text[start : start + WINDOW]
                    rank = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little") >> 1
                    tags = tags_of(spans, start, len(part)).tolist()
                    slot = rank % (TRAIN_SLOTS // 2) * 2 + any(tags)
                    if slot not in out or rank < out[slot][0]:
                        out[slot] = (rank, part, tags)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x[0] for x in out.values()], pa.int64()), pa.array([x[1] for x in out.values()], pa.string()), pa.array([x[2] for x in out.values()], pa.list_(pa.int32()))], ["slot", "rank", "text", "tags"])

    rows = docs.select("text").mapInArrow(run, "slot int, rank long, text string, tags array<int>")
    best = rows.groupBy("slot").agg(F.min_by(F.struct("text", "tags"), "rank").alias("x"))
    return [(r["x"]["text"], r["x"]["tags"]) for r in best.orderBy("slot").collect()]  # TRAIN_SLOTS rows at most


def variants(n: int, seed: int = 3) -> list[tuple[str, list[int]]]:
    """Windows with spans written as the patterns do not expect them, and with numbers that are no personal data."""
    r = np.random.default_rng(seed)
    num = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    word = lambda: "".join("etaoinshrdlucmfwypvbgkjqxz"[x] for x in r.integers(0, 26, r.integers(2, 9)))
    octets = lambda: [str(x) for x in r.integers(1, 256, 4)]
    makers = [
        (3, lambda: f"({num(3)}) {num(3)}-{num(4)}"),
        (3, lambda: f"{num(3)}-{num(3)}-{num(4)}"),
        (3, lambda: f"{num(3)}.{num(3)}.{num(4)}"),
        (3, lambda: f"+{num(2)} {num(3)} {num(3)} {num(3)}"),
        (3, lambda: f"+1 ({num(3)}) {num(3)}-{num(4)}"),
        (0, lambda: f"{word()}.{num(2)}@{word()}.example.com"),
        (0, lambda: f"{word()} [at] {word()} [dot] com"),
        (0, lambda: f"{word()}(at){word()}.org"),
        (1, lambda: ".".join(octets())),
        (1, lambda: " . ".join(octets())),
        (2, lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}"),
        (2, lambda: f"{num(4)}-{num(4)}-{num(4)}-{num(4)}"),
        (-1, lambda: f"{r.integers(1900, 2100)}-{r.integers(10, 13)}-{r.integers(10, 31)}"),
        (-1, lambda: num(int(r.integers(1, 12)))),
        (-1, lambda: f"{num(1)}.{num(1)}.{num(2)}"),
        (-1, lambda: f"{num(2)}:{num(2)}"),
        (-1, lambda: f"${num(3)},{num(3)}.{num(2)}"),
        (-1, lambda: f"{num(3)}-{num(4)}"),
    ]
    out = []
    for k in range(n):
        kind, make = makers[k % len(makers)]
        before, after = (" ".join(word() for _ in range(r.integers(0, 7))) for _ in range(2))
        span = make()
        text = f"{before} {span}{r.choice([' ', '. ', ', ', chr(10)])}{after}"[:WINDOW]
        start = len(before) + 1
        fit = kind >= 0 and start + len(span) <= len(text)
        out.append((text, tags_of([(kind, start, start + len(span))] if fit else [], 0, len(text)).tolist()))
    return out


def train_tagger(docs: DataFrame) -> Tagger:
    rows = labelled_windows(docs) + variants(VARIANTS)
    ids, tags = np.zeros((len(rows), WINDOW), np.int64), np.zeros((len(rows), WINDOW), np.int64)
    for k, (text, t) in enumerate(rows):
        ids[k, : len(text)], tags[k, : len(text)] = letter_ids(text), t
    tagger = Tagger()
    tagger.train(ids, tags, batch=128, rate=0.03)
    return tagger


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text with a digit, @ or written-out at near, in order and apart."""
    out: list[list[int]] = []
    for m in RUN.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: One of these is in every span that fits() accepts: the forms of at for the first kind, a digit for the others.
RUN = re.compile(r"[0-9@]+|\x20at\x20|\[at\]|\(at\)")


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans of each text by the tagger alone."""
    # text, start, end, and where the spans of a part may start
    where = [(k, max(a, c - MARGIN), min(b, c + PART + MARGIN), c, min(b, c + PART)) for k, text in enumerate(texts) for a, b in stretches(text) for c in range(a, b, PART)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    letters = {k: letter_ids(texts[k]) for k in {w[0] for w in where}}
    # nearly equal lengths go together
    where.sort(key=lambda x: x[2] - x[1])
    near = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1.0
    lo = 0
    while lo < len(where):
        hi, total = lo, 0
        while hi < len(where) and (hi == lo or total + where[hi][2] - where[hi][1] <= BATCH * WINDOW):
            total += where[hi][2] - where[hi][1]
            hi += 1
        group = where[lo:hi]
        lo = hi
        length = np.array([w[2] - w[1] for w in group])
        starts = [(g, s) for g, n in enumerate(length.tolist()) for s in range(0, max(1, n - WINDOW + STRIDE), STRIDE)]
        unary = np.zeros((len(group), int(length.max()), TAGS))
        weight = np.zeros(unary.shape[:2])
        for at in range(0, len(starts), BATCH):
            part = starts[at : at + BATCH]
            ids = np.zeros((len(part), WINDOW), np.int64)
            for w, (g, s) in enumerate(part):
                k, a, b, *_ = group[g]
                piece = letters[k][a + s : min(b, a + s + WINDOW)]
                ids[w, : len(piece)] = piece
            scores = tagger.log_marginals(ids)
            for w, (g, s) in enumerate(part):
                n = min(WINDOW, length[g] - s)
                unary[g, s : s + n] += scores[w, :n] * near[:n, None]
                weight[g, s : s + n] += near[:n]
        unary /= np.maximum(weight, 1e-9)[:, :, None]
        first = unary[:, 0]
        first[:, 2::2] += allowed()[0, 2]
        path = best_path(unary, allowed(), length)
        for g, (k, a, _, low, high) in enumerate(group):
            tags = path[g, : length[g]]
            for begin in np.flatnonzero(tags % 2 == 1).tolist():
                if not low <= a + begin < high:
                    continue
                end = begin + 1
                while end < len(tags) and tags[end] == tags[begin] + 1:
                    end += 1
                out[k].append((int(tags[begin] - 1) // 2, a + begin, a + end))
    return out


def all_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    out = []
    for text, more in zip(texts, tagged_spans(tagger, texts), strict=True):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        every, k, last = list(base), 0, 0
        for kind, a, b in sorted(more, key=lambda x: x[1]):
            while a < b and text[a] in " \n\t.,":
                a += 1
            while b > a and text[b - 1] in " \n\t.,":
                b -= 1
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            inside = a and text[a - 1].isalnum() and text[a : a + 1].isalnum() or text[b - 1 : b].isalnum() and text[b : b + 1].isalnum()
            # spans of neighbouring parts may meet
            if a >= last and not inside and not any(x < b and y > a for x, y in taken[max(0, k - 1) : k + 4]) and fits(kind, text[a:b]):
                every.append((kind, a, b))
                last = b
        out.append((base, sorted(every)))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with a mark in the place of each span; of spans that overlap the first counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], x[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind]}]"]
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame, tagger: Tagger, redact: bool = False) -> DataFrame:
    """doc_id and the spans of each text, or with redact all columns of docs, the text redacted."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger.p)
    at = docs.columns.index("text")

    def load() -> Tagger:
        out = Tagger.__new__(Tagger)
        out.p = shared.value
        return out

    def texts_of(batches):
        for batch in batches:
            lo, column = 0, batch.column(at)
            # characters up to each text; only the texts of a part become strings at once
            ends = np.cumsum([0, *pc.utf8_length(column).fill_null(0).to_pylist()])
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (4 << 20), "right")) - 1)
                yield batch.slice(lo, hi - lo), [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                lo = hi

    def run(batches):
        tagger = load()
        for batch, texts in texts_of(batches):
            found = all_spans(tagger, texts)
            base = [written(b) for b, _ in found]
            count = [pa.array([sum(x[0] == k for x in b) for b, _ in found], pa.int64()) for k in range(len(KINDS))]
            sha = pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *count, sha, pa.array([written(a) for _, a in found])], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    def rewrite(batches):
        tagger = load()
        for batch, texts in texts_of(batches):
            clean = [redacted(t, every) for t, (_, every) in zip(texts, all_spans(tagger, texts), strict=True)]
            null = batch.column(at).is_null().to_pylist()
            text = pa.array([None if n else t for n, t in zip(null, clean, strict=True)], batch.column(at).type)
            columns = [text if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    if redact:
        return docs.mapInArrow(rewrite, docs.schema)
    field = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {field}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return find_personal_data(docs, train_tagger(docs))
