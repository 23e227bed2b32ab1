"""Substring deduplication by level-wise doubling of repeated word windows.

1. Equal word sequences become one class, represented by the smallest doc_id; a copy of
   at least one window is removed whole.
2. The first level has half the window's length.  Of every run of starts that makes up
   one window it keeps the starts with the smallest hash, so two documents that share a
   window share a kept half at the same place in it.
3. Halves that occur in two documents survive; only windows around them are extended to
   twice the length, hashed with two independent hashes of 64 bits of each word, and
   counted.  Documents without survivors send nothing further.  ``longest_repeats`` goes
   on doubling until none survives.
4. Windows whose first document is smaller than their own mark the words to remove.

Halves and windows that very many documents share are few; they are joined by broadcast,
all others by a shuffle.

Defined cases: null or empty text has no words; rows with the same doc_id do not remove
each other's words; a null doc_id counts as larger than any other; repeated rows each
get a result; an empty table gives an empty result; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import U64, Words, documents, join_counted, joined, sliding, stored, text_steps

WINDOW = 50
NULL_ID = (1 << 63) - 1
TOP = U64((1 << 64) - 1)


def window_hashes(word_hash: np.ndarray, words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that start at each word, and whether a window lies in its document."""
    out = np.zeros(len(words), U64)
    run = sliding(joined, word_hash, length)
    out[: len(run)] = run
    return out, np.arange(len(words)) + length <= np.repeat(words.first[1:], np.diff(words.first))


def kept_halves(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the half windows that are smallest in some window, and the hashes of all halves."""
    half = window // 2
    width = window - half + 1
    every, fits = window_hashes(words.hash, words, half)
    hashes = np.where(fits, every >> U64(1), TOP)
    whole = np.arange(len(words)) + window <= np.repeat(words.first[1:], np.diff(words.first))
    low = np.zeros(len(words), U64)
    run = sliding(np.minimum, hashes, width)
    low[: len(run)] = run + U64(1)
    low[~whole] = 0
    best = sliding(np.maximum, np.concatenate([np.zeros(width - 1, U64), low]), width)
    at = np.flatnonzero(fits & (best == hashes + U64(1)))
    return at, hashes[at].view(np.int64), every


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def word_digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The SHA-256 of each document's words, joined by one space."""
    raw = data.tobytes()
    return [hashlib.sha256(b" ".join(raw[a:b].split())).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def right_texts(data: np.ndarray, offsets: np.ndarray, part: pa.Array) -> np.ndarray:
    """Whether each text is of its row's class; rows of one id may hold different texts."""
    return np.array([int.from_bytes(x[:8], "big") >> 4 for x in word_digests(data, offsets)]) == part.to_numpy()


def scanned(docs: DataFrame, window: int) -> DataFrame:
    """id, sha (of all words), n_words and the kept halves of every document."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(1)):
                words = Words(data, offsets)
                at, hashes, _ = kept_halves(words, window)
                cut = np.searchsorted(at, words.first)
                halves = [np.unique(hashes[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                ends = np.cumsum([0, *map(len, halves)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(word_digests(data, offsets), pa.binary()), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(halves)))],
                    ["id", "sha", "n_words", "halves"],
                )

    return docs.mapInArrow(run, "id long, sha binary, n_words long, halves array<bigint>")


def extended(rows: DataFrame, window: int) -> DataFrame:
    """(w1, w2, id, part, start) of the windows around surviving halves; rows: id, part, text, halves.

    A window's hash joins those of its two halves, of words hashed in two ways.
    """

    def run(batches):
        half = window // 2
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(2)):
                words = Words(data, offsets)
                right = right_texts(data, offsets, batch.column(1).slice(lo, hi - lo))
                at, hashes, every = kept_halves(words, window)
                at = at[np.isin(hashes, batch.column(3).slice(lo, hi - lo).flatten().to_numpy())]
                doc = np.repeat(np.arange(hi - lo), np.diff(words.first))
                at = at[right[doc[at]]] if len(at) else at
                first = np.maximum(at - (window - half), words.first[doc[at]] if len(at) else 0)
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, first, 1)
                np.add.at(mark, at + 1, -1)
                fits = np.arange(len(words)) + window <= np.repeat(words.first[1:], np.diff(words.first))
                start = np.flatnonzero((np.cumsum(mark)[:-1] > 0) & fits)
                second = window_hashes(words.second_hash, words, half)[0] if len(start) else every
                w1, w2 = (joined(h[start], h[start + window - half]) for h in (every, second))
                ids, parts = (batch.column(k).slice(lo, hi - lo).to_numpy() for k in (0, 1))
                d = doc[start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(ids[d]), pa.array(parts[d]), pa.array((start - words.first[d]).astype(np.int32))],
                    ["w1", "w2", "id", "part", "start"],
                )

    return rows.mapInArrow(run, "w1 long, w2 long, id long, part long, start int")


def repeated(windows: DataFrame) -> DataFrame:
    """The windows that two documents have, with the first of them; windows is a stored table."""
    first = stored(windows.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last"), "firsts")
    return join_counted(windows, first, ["w1", "w2"], "n").drop("n")


def cut_out(rows: DataFrame, window: int) -> DataFrame:
    """(id, part, n_removed, cut_sha) of texts less the words covered by windows at starts; rows: id, part, text, starts."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(2)):
                right = right_texts(data, offsets, batch.column(1).slice(lo, hi - lo))
                raw, out = data.tobytes(), ([], [])
                for k in np.flatnonzero(right).tolist():
                    words = raw[offsets[k] : offsets[k + 1]].split()
                    starts = batch.column(3)[lo + k].values.to_numpy()
                    mark = np.zeros(len(words) + 1, np.int64)
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, starts + window, -1)
                    keep = np.flatnonzero(np.cumsum(mark)[:-1] == 0).tolist()
                    out[0].append(len(words) - len(keep))
                    out[1].append(hashlib.sha256(b" ".join([words[i] for i in keep])).digest())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo).filter(pa.array(right)) for c in (0, 1)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["id", "part", "n_removed", "cut_sha"])

    return rows.mapInArrow(run, "id long, part long, n_removed long, cut_sha binary")


def survivors(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What scanned() gives, the classes, and (id, part, text, halves) of the documents with repeated halves.

    A class is all rows with one sequence of words; rep is its smallest id, and part tells
    apart classes of one rep, n is the number of rows.
    """
    seen = stored(scanned(docs, window), "scanned")
    rep = F.min("id").alias("rep")
    part = F.conv(F.substring(F.hex("sha"), 1, 15), 16, 10).cast("long").alias("part")
    classes = stored(seen.groupBy("sha", "n_words").agg(rep, F.first("halves").alias("halves"), F.count(F.lit(1)).alias("n")).select("sha", "n_words", "rep", part, "halves", "n"), "classes")
    halves = stored(classes.where(F.size("halves") > 0).select(F.col("rep").alias("id"), "part", F.explode("halves").alias("half")), "halves")
    again = stored(halves.groupBy("half").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").select("half", "n"), "again")
    with_survivors = join_counted(halves, again, ["half"], "n").groupBy("id", "part").agg(F.collect_list("half").alias("halves"))
    return seen.drop("halves"), classes.drop("halves"), stored(docs.join(with_survivors, "id").select("id", "part", "text", "halves"), "survivors")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs."""
    d = keyed(docs)
    seen, classes, rows = survivors(d, window)
    windows = stored(extended(rows, window), "windows")
    marked = repeated(windows).where("id > first").groupBy("id", "part").agg(F.collect_set("start").alias("starts"))
    cut = cut_out(rows.join(marked, ["id", "part"]).select("id", "part", "text", "starts"), window).dropDuplicates(["id", "part"])
    each = stored(classes.join(cut.withColumnRenamed("id", "rep"), ["rep", "part"], "left"), "cut")
    out = join_counted(seen, each, ["sha", "n_words"], "n")
    copy = (F.col("id") > F.col("rep")) & (F.col("n_words") >= window)
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.nullif("id", F.lit(NULL_ID)).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, empty).otherwise(F.lower(F.hex(F.coalesce("cut_sha", "sha")))).alias("kept_sha256"),
    )


def longest_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, length): the longest of window, 2 * window, ... of which a document repeats a smaller one's words.

    A window of twice the length can only repeat if both its halves do.
    """
    d = keyed(docs)
    _, _, rows = survivors(d, window)
    windows, length, out = stored(extended(rows, window), "windows"), window, None
    while True:
        live = stored(repeated(windows), "live")
        if live.isEmpty():
            break
        found = live.where("id > first").select("id", F.lit(length).cast("long").alias("length")).distinct()
        out = found if out is None else out.union(found)
        # the hash of a pair of halves is as good a name for the longer window as that of its words
        right = live.select("id", "part", (F.col("start") - length).alias("start"), F.col("w1").alias("r1"), F.col("w2").alias("r2"))
        both = live.join(right, ["id", "part", "start"])
        windows = stored(both.select(F.xxhash64("w1", "w2", "r1", "r2").alias("w1"), F.xxhash64("r2", "r1", "w2", "w1").alias("w2"), "id", "part", "start"), "windows")
        length *= 2
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, length long")
    return out.groupBy("id").agg(F.max("length").alias("length")).select(F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), "length")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir, "doc_id", "text"))


#: All windows as text; doc_id is a key of the table.
ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS t
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d WHERE len(words) >= {WINDOW})),
f AS (SELECT t, min(doc_id) AS first FROM g GROUP BY t HAVING min(doc_id) < max(doc_id)),
x AS (SELECT doc_id, i FROM g JOIN f USING (t) WHERE doc_id > first),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
c AS (SELECT w.doc_id, w.i, word, coalesce(max(x.i) OVER (PARTITION BY w.doc_id ORDER BY w.i), -{WINDOW}) > w.i - {WINDOW} AS gone
      FROM w LEFT JOIN x ON w.doc_id = x.doc_id AND w.i = x.i),
k AS (SELECT doc_id, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
