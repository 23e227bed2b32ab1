"""Document fingerprints from prefix polynomial hashes.

Code points are the coefficients of a polynomial; prefix arrays modulo two primes
below 2**31 answer the equality of any two spans by a subtraction and locate the
longest common extension of two texts by binary search.

A fingerprint holds the length, the hash of the whole text, and three lists of span
hashes.  Two are ladders: of prefixes and of suffixes, at lengths that grow by a fixed
ratio from one code point.  Lengths depend on nothing but the ladder, so two
fingerprints have comparable rungs, and as equal prefixes of one length imply equal
shorter ones, a binary search over the rungs finds how far two texts agree from either
end.  The third is of the pieces between places that the content chooses: where the
hash of the next WINDOW code points is least among those of REACH places on either
side.  An edit moves the places near it only, so the other pieces stay equal.

Likeness: code points that lie in an agreed end or in a piece that the other text has
as well (each of its pieces answers for one), the lesser count of the two texts, over
the longer text; 1 for equal texts.

Defined cases: null text is empty; two empty texts have likeness 1, an empty and
another 0; documents are in order of doc_id, nulls first, and of text among equal
ids; the document after the last is the first; a single document follows itself;
an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import documents, sliding

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (911_382_323, 972_663_749)
#: Each rung of the ladder is longer than the one before by this ratio.
RATIO = 1.25
#: Hexadecimal digits of a rung or a piece.
RUNG = 8
#: Code points whose hash chooses a place, and places on either side that it is compared with.
WINDOW, REACH = 16, 48
#: Documents in a stretch of ids that is put in order together, on average.
STRETCH = 2_000
#: Stretches at most; beyond, they grow.
STRETCHES = 100_000


def rungs(n: int) -> np.ndarray:
    """The ladder's lengths up to n."""
    every = ladder(n.bit_length())
    return every[: np.searchsorted(every, n, "right")]


#: The lengths below 2**bits that a task has used; a plain table, because a caching wrapper is pickled by its name.
LADDERS: dict[int, np.ndarray] = {}


def ladder(bits: int) -> np.ndarray:
    """The lengths below 2**bits."""
    if bits not in LADDERS:
        out, x = [], 1
        while x < 1 << bits:
            out.append(x)
            x = max(x + 1, int(x * RATIO))
        LADDERS[bits] = np.array(out, np.int64)
    return LADDERS[bits]


class Hasher:
    """Prefix arrays of texts; the table of powers grows on demand."""

    def __init__(self):
        self.powers = [np.ones(1, np.uint64) for _ in PRIMES]

    def table(self, which: int, n: int) -> np.ndarray:
        have, p = self.powers[which], np.uint64(PRIMES[which])
        while len(have) < n:
            step = np.uint64(pow(BASES[which], len(have), PRIMES[which]))
            have = np.concatenate([have, have * step % p])
        self.powers[which] = have
        return have

    def prefixes(self, text: str) -> list[np.ndarray]:
        """For each prime, H with H[i] = sum of (c+1) * base**j over j < i."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        out = []
        for k, p in enumerate(PRIMES):
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes * self.table(k, len(codes))[: len(codes)] % np.uint64(p), out=sums[1:])
            out.append(sums % np.uint64(p))
        return out

    def spans(self, prefixes: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """62-bit hashes of spans, independent of where they lie."""
        n, out = len(prefixes[0]), np.zeros(len(starts), np.uint64)
        for k, p in enumerate(PRIMES):
            h, p64 = prefixes[k], np.uint64(p)
            part = (h[starts + lengths] + p64 - h[starts]) % p64
            # moved to the common place n, instead of dividing by base**start
            part = part * self.table(k, n + 1)[n - starts] % p64
            part = part * np.uint64(pow(pow(BASES[k], n, p), -1, p)) % p64
            out = out << np.uint64(31) | part
        return out

    def places(self, prefixes: list[np.ndarray]) -> np.ndarray:
        """Where pieces begin, the start of the text apart; any two are more than REACH apart."""
        h, p = prefixes[0], PRIMES[0]
        n = len(h) - 1
        count = n - WINDOW + 1
        if count < 2 * REACH + 1:
            return np.zeros(0, np.int64)
        part = (h[WINDOW:] + np.uint64(p) - h[:count]) % np.uint64(p)
        part = part * self.table(0, n + 1)[n : n - count : -1] % np.uint64(p)
        part = part * np.uint64(pow(pow(BASES[0], n, p), -1, p)) % np.uint64(p)
        least = sliding(np.minimum, part, REACH)
        # strictly less than those before, so that a text that repeats itself has no place
        middle = part[REACH : count - REACH]
        return np.flatnonzero((middle < least[: len(middle)]) & (middle <= least[REACH + 1 : REACH + 1 + len(middle)])) + REACH

    def fingerprint(self, text: str) -> str:
        h, n = self.prefixes(text), len(text)
        lengths = rungs(n)
        cuts = np.concatenate([np.zeros(1 if n else 0, np.int64), self.places(h)])
        sizes = np.diff(cuts, append=n) if n else cuts
        starts = np.concatenate([np.zeros(1 + len(lengths), np.int64), n - lengths, cuts])
        hashes = self.spans(h, starts, np.concatenate([[n], lengths, lengths, sizes]))
        low = (hashes[1:] & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()
        end = len(lengths) * RUNG
        return f"{n}:{hashes[0]:016x}:{low[:end]}:{low[end : 2 * end]}:{low[2 * end :]}:{','.join(map(str, sizes.tolist()))}"


def common_prefix(hasher: Hasher, a: str, b: str) -> int:
    """Length of the longest common extension of two texts from their starts, by binary search."""
    x, y, zero = hasher.prefixes(a), hasher.prefixes(b), np.zeros(1, np.int64)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if hasher.spans(x, zero, np.array([mid]))[0] == hasher.spans(y, zero, np.array([mid]))[0]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def agreed(a: str, b: str, lengths: np.ndarray) -> int:
    """The longest rung at which two ladders of hashes are equal, by binary search."""
    lo, hi = 0, min(len(a), len(b)) // RUNG
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[(mid - 1) * RUNG : mid * RUNG] == b[(mid - 1) * RUNG : mid * RUNG]:
            lo = mid
        else:
            hi = mid - 1
    return int(lengths[lo - 1]) if lo else 0


def pieces(hashes: str, sizes: str) -> list[tuple[str, int]]:
    """(hash, length) of each piece, in order."""
    return [(hashes[k * RUNG : (k + 1) * RUNG], int(x)) for k, x in enumerate(sizes.split(","))]


def found(mine: list[tuple[str, int]], theirs: Counter, lo: int, hi: int) -> int:
    """Code points at lo..hi-1 in pieces that the other text has."""
    left, at, total = theirs.copy(), 0, 0
    for piece in mine:
        end = at + piece[1]
        if end > lo and at < hi and left[piece] > 0:
            left[piece] -= 1
            total += min(end, hi) - max(at, lo)
        at = end
    return total


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone."""
    (n, whole, start, end, inner, sizes), (m, other, start_b, end_b, inner_b, sizes_b) = a.split(":"), b.split(":")
    if (n, whole) == (m, other):
        return 1.0
    n, m = int(n), int(m)
    shortest = min(n, m)
    if not shortest:
        return 0.0
    lengths = rungs(shortest)
    before, after = agreed(start, start_b, lengths), agreed(end, end_b, lengths)
    after = min(after, shortest - before)
    mine, theirs = pieces(inner, sizes), pieces(inner_b, sizes_b)
    covered = min(found(mine, Counter(theirs), before, n - after), found(theirs, Counter(mine), before, m - after))
    return min(before + after + covered, shortest) / max(n, m)


FIRST = -(1 << 63)


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows dealt into stretches of consecutive ids, each with the first rows of the next stretch at its end.

    The limits of the stretches are approximate quantiles of doc_id, STRETCHES numbers at
    most; tasks find a row's stretch among them by binary search.  A row that starts a
    stretch is sent to two of them.
    """
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = d.select("doc_id")
    parts = min(STRETCHES, max(1, ids.count() // STRETCH))
    cuts = ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    limits = np.array(sorted({int(x) for x in cuts}), np.int64)
    part_of = lambda column: np.searchsorted(limits, column.to_numpy(), "right").astype(np.int32)

    def first_ids(batches):
        low: dict[int, int] = {}
        for batch in batches:
            part, doc_id = part_of(batch.column(0)), batch.column(0).to_numpy()
            for p in np.unique(part).tolist():
                low[p] = min(low.get(p, 1 << 63), int(doc_id[part == p].min()))
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array(list(low.values()), pa.int64())], ["part", "head"])

    heads = ids.mapInArrow(first_ids, "part int, head long").groupBy("part").agg(F.min("head").alias("head")).orderBy("part").collect()  # a row for each stretch
    filled = np.array([r["part"] for r in heads], np.int64)
    head = np.array([r["head"] for r in heads], np.int64)

    def deal(batches):
        for batch in batches:
            part, doc_id = part_of(batch.column(0)), batch.column(0).to_numpy()
            # of the stretches that hold rows, the one before; before the first comes the last
            at = np.searchsorted(filled, part)
            starts = np.flatnonzero(doc_id == head[at])
            rows = np.concatenate([np.arange(len(part)), starts])
            to = np.concatenate([part, filled[at[starts] - 1]]).astype(np.int32)
            guest = (np.arange(len(rows)) >= len(part)).astype(np.int32)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(guest), taken.column(0), taken.column(1)], ["part", "guest", "doc_id", "text"])

    return d.mapInArrow(deal, "part int, guest int, doc_id long, text string"), len(filled)


def fingerprints(docs: DataFrame, digests: bool = False) -> DataFrame:
    """Fingerprints of each text and of its edited text; with digests, the edited text as its SHA-256 only."""
    rows, parts = with_next(docs)
    last = "edited_sha256" if digests else "edited"

    def run(batches):
        hasher, held, part, prints = Hasher(), None, None, {}

        def result(row, following):
            doc_id, text = row
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            own = prints.pop(text, None) or hasher.fingerprint(text)
            prints.clear()
            prints[following] = hasher.fingerprint(following)
            changed = hasher.fingerprint(edited)
            made = hashlib.sha256(edited.encode()).hexdigest() if digests else edited
            return None if doc_id == FIRST else doc_id, len(text), made, own, changed, likeness(own, changed), likeness(own, prints[following])

        names = ["doc_id", "n_chars", last, "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                p, guest, doc_id, text = (batch.column(c)[k].as_py() for c in range(4))
                if held is not None and part == p:
                    out.append(result(held, text))
                # of several rows that start the next stretch only the first follows
                held, part = (None, None) if guest else ((doc_id, text), p)
                if len(out) >= 200:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = f"doc_id long, n_chars long, {last} string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ordered = rows.repartition(parts or 1, "part").sortWithinPartitions("part", "guest", "doc_id", "text")
    return ordered.mapInArrow(run, schema)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir, "doc_id", "text"), digests=True)
