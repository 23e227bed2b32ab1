"""What several operators share: byte-level words, 64-bit hashes and Arrow batches.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D.  These separators are
ASCII, so cutting UTF-8 bytes equals cutting the text.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.shared import HEAVY, join_counted, positions, shared_path, stored  # noqa: F401  used by the operators

U64 = np.uint64
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step takes; a longer document is one step of its own.
STEP_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
BASE2 = 0xC2B2AE3D27D4EB4F | 1
#: Bytes of the longest word that is hashed together with others.
LONG_WORD = 64
#: Bits of a sieve for each key, and the most that one has; sixty-four of them are a row that is broadcast.
SIEVE_BITS, SIEVE_MOST = 8, 1 << 24

def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def fold(column, n: int):
    """crc32 of the value as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def sieved(df: DataFrame, key: str, wanted: DataFrame, mark: str) -> DataFrame:
    """df with a boolean column mark, true for every row whose key is in wanted and for some of the others.

    Rows stay where they are, so that only marked ones need a shuffle; an exact join has to
    follow.  Each key sets one bit by its hash: with SIEVE_BITS for each, an eighth of the
    others is marked; beyond SIEVE_MOST bits more are, and what is broadcast grows no
    further.  wanted, a stored table of one column, is read twice.
    """
    word, bits, slot = (fresh(df, c) for c in ("_word", "_bits", "_slot"))
    slots = min(SIEVE_MOST, SIEVE_BITS * wanted.count() + 64)
    slot_of = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    set_bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(slot) % 64).cast("int"))
    words = wanted.select(slot_of(wanted.columns[0]).alias(slot)).groupBy(F.shiftright(slot, 6).alias(word)).agg(F.bit_or(set_bit).alias(bits))
    placed = df.withColumn(slot, slot_of(key)).withColumn(word, F.shiftright(slot, 6)).join(F.broadcast(words), word, "left")
    return placed.select(*df.columns, F.coalesce(F.getbit(bits, F.col(slot) % 64) == 1, F.lit(False)).alias(mark))


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of sequences from the hashes of their two parts, which may overlap.

    Not linear, so that no pattern of words has equal hashes for every multiplier.
    """
    return mix(a * U64(BASE) + mix(b + U64(BASE2)))


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over each run of width values, by doubling; with joined, the hash of each run."""
    if len(x) < width:
        return x[:0]
    size = 1
    while size * 2 <= width:
        x, size = op(x[:-size], x[size:]), size * 2
    rest = width - size
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of 64 bits of each stretch of bytes.

    Up to LONG_WORD bytes go in eights through mix, which is one-to-one; longer ones
    through a hash function for bytes of any length.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    length = ends - starts
    out = mix(length.astype(U64) + U64(seed))
    live = np.flatnonzero(length <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        rest = length[live] - k
        x = eight[starts[live] + k]
        short = rest < 8
        x[short] &= (U64(1) << (rest[short] * 8).astype(U64)) - U64(1)
        out[live] = mix(out[live] * U64(BASE2) + x)
        live = live[rest > 8]
        if not len(live):
            break
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little"))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


# ---------------------------------------------------------------- words of Arrow columns


class Words:
    """The words of some documents that lie one after the other in a byte buffer.

    starts, ends: places of the words; first: for each document the number of words
    before it, and their total; hash: 64 bits for each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        sep = np.zeros(256, bool)
        sep[[9, 10, 11, 12, 13, 32]] = True
        if lower:
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            data = table[data]
        n = len(data)
        inside = ~sep[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < n]] = False
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
        self.data = data
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @cached_property
    def hash(self) -> np.ndarray:
        return byte_hashes(self.data, self.starts, self.ends, 1)

    @cached_property
    def second_hash(self) -> np.ndarray:
        """Another 64 bits for each word."""
        return byte_hashes(self.data, self.starts, self.ends, 2)

    def __len__(self) -> int:
        return len(self.starts)


def text_steps(column: pa.Array, step_bytes: int = STEP_BYTES):
    """(lo, hi, data, offsets) of rows lo..hi-1 of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + step_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[ends[lo] : ends[hi]], (ends[lo : hi + 1] - ends[lo]).astype(np.int64)
        lo = hi


def binary(values: np.ndarray, width: int) -> pa.Array:
    """Rows of a contiguous 2-d array as one binary value each."""
    n = len(values)
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
