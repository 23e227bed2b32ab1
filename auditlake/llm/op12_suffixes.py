"""Substring deduplication of bytes by ranks of growing prefixes, sorted by Spark.

A suffix array of all bytes would take many times the input on disk, so the positions are
thin: of every window of ``window`` bytes only the position whose first GRAM bytes have
the least hash is kept, which two equal windows have at the same place.

1. The rank of a position is first that of its GRAM bytes.  Spark sorts (rank, text)
   pairs; positions whose rank no other text has are unique and go.
2. The others grow to both sides, to all windows in which they are the kept position.
   Spark sorts them by rank again, and tasks rerank the windows, now past the threshold, by
   all their bytes: a window whose rank a smaller doc_id has too is removed.
3. Ranks of very many positions would meet in one task.  They are bounded in number and
   known after step 1; their windows are ranked one by one, at first among the texts that a
   task has at hand, and what is left by Spark, counted with a combiner and joined by
   ``join_counted``.

Texts never move.  A row's key is its file and place in the file; what Spark finds for
a text is sorted by key into blocks in the shared folder, and the next scan of the texts
reads its block.  Equal texts are one: those of a larger doc_id are removed whole.

Defined cases: a null or empty text has no bytes; rows with one doc_id do not remove each
other's bytes, and repeated rows each get a result; a null doc_id counts as larger than any
other; an empty table gives an empty result; a very long text is one step of its own;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import BASE, BASE2, STEP_BYTES, U64, join_counted, mix, shared_path, sliding, stored, text_steps
from auditlake.shared import open_store

WINDOW = 50
#: Bytes that the first rank looks at.
GRAM = 16
NULL_ID = (1 << 63) - 1
#: A key is the number of a file and, in so many bits, a row in it.
ROW_BITS = 36
#: Positions that a task holds before it sends them.
HELD = 1 << 20
#: Ranks of more positions than this, which a task holds together, and than one in so many of all, are hot; so there are at most about as many.
HOT_PLACES, HOT_RANKS = 1 << 16, 100_000
#: Bytes of text whose hot windows are ranked together.
HOT_BYTES = 2 << 20
#: Bytes of rows whose windows a task ranks at once.
RANKED = 4 << 20


# ---------------------------------------------------------------- texts in place, and what is found for them


def placed(docs: DataFrame) -> DataFrame:
    """(key, id, text) of a scan of files."""
    rows = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # the driver planned the scan from this list
    files = sorted(r.file for r in rows.select("file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "number long, file string")
    key = F.shiftleft("number", ROW_BITS) + F.col("row")
    return rows.join(F.broadcast(numbers), "file").select(key.alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def blocks(found: DataFrame, name: str, bits: int) -> str:
    """The folder with found (key, ...) in blocks of 2**bits rows of texts, sorted by key."""
    path = shared_path(found.sparkSession, name)
    dealt = found.withColumn("block", F.shiftright("key", bits))
    dealt.repartition("block").sortWithinPartitions("block", "key").write.partitionBy("block").parquet(path)
    return path


class Beside:
    """What was found for the texts that a task scans."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.block, self.table = folder, bits, None, None

    def of(self, keys: np.ndarray) -> pa.Table | None:
        """The rows found for keys, by key; keys ascend, as a scan gives them."""
        parts = []
        for block in np.unique(keys >> self.bits).tolist():
            if block != self.block:
                self.block, self.table = block, self.read(block)
            if self.table is not None:
                mine = keys[keys >> self.bits == block]
                at = self.table["key"].to_numpy()
                parts.append(self.table.slice(lo := int(np.searchsorted(at, mine[0])), int(np.searchsorted(at, mine[-1], "right")) - lo))
        return pa.concat_tables(parts) if parts else None

    def read(self, block: int) -> pa.Table | None:
        from pyarrow import fs, parquet

        store, path = open_store(f"{self.folder}/block={block}")
        names = sorted(f.path for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet"))
        tables = [parquet.ParquetFile(store.open_input_file(name)).read() for name in names]
        return pa.concat_tables(tables).sort_by("key").combine_chunks() if tables else None


# ---------------------------------------------------------------- positions


def positions_of(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(rank, first, last, text) of each kept position: the windows that start at first to last keep it."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(GRAM, np.uint8)])
    eight = np.ndarray(n + 8, "<u8", padded, strides=(1,))
    rank = mix(mix(eight[:n] * U64(BASE) + U64(BASE2)) + eight[8 : n + 8])
    size = np.diff(offsets)
    inside = np.flatnonzero(np.arange(n) + window <= np.repeat(offsets[1:], size))
    # the least hash, of equal ones the first, which depends on the window's bytes only
    least = sliding(np.minimum, (rank & ~U64(0xFFFFFFFF)) | np.arange(n, dtype=U64), window - GRAM + 1)
    kept = (least[inside] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], kept[1:] != kept[:-1]])) if len(kept) else np.zeros(0, np.int64)
    first, last = inside[new], inside[np.concatenate([new[1:], [len(kept)]]) - 1] if len(kept) else inside[new]
    return (rank[kept[new]] >> U64(1)).view(np.int64), first, last, np.searchsorted(offsets, first, "right") - 1


def ranked(texts: DataFrame, copies: str, bits: int, window: int) -> DataFrame:
    """(deal, rank, key, n, places): each position's rank and text once.

    Where a task has several texts of a rank, one row stands for all n of them and their
    positions; the others, with n = 0, are dealt by their text, for they are known to
    stay.  rank is null where it is deal, and places where it is n.
    """

    def sent(ranks: list[np.ndarray], keys: list[np.ndarray]):
        rank, key = np.concatenate(ranks), np.concatenate(keys)
        order = np.lexsort((key, rank))
        rank, key = rank[order], key[order]
        once = np.ones(len(rank), bool)
        once[1:] = (rank[1:] != rank[:-1]) | (key[1:] != key[:-1])
        rank, key = rank[once], key[once]
        head = np.ones(len(rank), bool)
        head[1:] = rank[1:] != rank[:-1]
        n, places = np.zeros(len(rank), np.int32), np.zeros(len(rank), np.int64)
        n[head] = np.diff(np.concatenate([np.flatnonzero(head), [len(rank)]]))
        places[head] = np.diff(np.concatenate([np.flatnonzero(once)[head], [len(order)]]))
        deal = np.where(head, rank, (mix(key.view(U64)) >> U64(1)).view(np.int64))
        for k in range(0, len(rank), 1 << 17):
            part = slice(k, k + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(deal[part]), pa.array(rank[part], mask=head[part]), pa.array(key[part]), pa.array(n[part]), pa.array(places[part], mask=places[part] == n[part])], ["deal", "rank", "key", "n", "places"])

    def run(batches):
        skip, ranks, keys, held = Beside(copies, bits), [], [], 0
        for batch in batches:
            key = batch.column(0).to_numpy()
            gone = skip.of(key)
            for lo, hi, data, offsets in text_steps(batch.column(1)):
                rank, _, _, text = positions_of(data, offsets, window)
                own = key[lo:hi][text]
                if gone is not None:
                    stay = ~np.isin(own, gone["key"].to_numpy())
                    rank, own = rank[stay], own[stay]
                ranks.append(rank), keys.append(own)
                held += len(rank)
                if held > HELD:
                    yield from sent(ranks, keys)
                    ranks, keys, held = [], [], 0
        if held:
            yield from sent(ranks, keys)

    return texts.select("key", "text").mapInArrow(run, "deal long, rank long, key long, n int, places long")


def whole_groups(batches, column: str):
    """Tables of whole groups of equal values of a column, from batches sorted by it."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
        values = rest[column].to_numpy()
        cut = int(np.searchsorted(values, values[-1])) if len(values) else 0
        if cut:
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None and len(rest):
        yield rest


def repeated(pairs: DataFrame, hot: int) -> DataFrame:
    """(key, rank, hot) of the positions whose rank several texts have; hot is set in a row at least of each hot rank."""

    def run(batches):
        for table in whole_groups(batches, "deal"):
            deal, n = table["deal"].to_numpy(), table["n"].to_numpy()
            start = np.flatnonzero(np.concatenate([[True], deal[1:] != deal[:-1]]))
            size = np.diff(np.concatenate([start, [len(deal)]]))
            places = pc.coalesce(table["places"], table["n"].cast(pa.int64())).to_numpy()
            texts, places = (np.repeat(np.add.reduceat(x.astype(np.int64), start), size) for x in (n, places))
            stay = (n == 0) | (texts > 1)
            rank = pc.coalesce(table["rank"], table["deal"]).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(table["key"].to_numpy()[stay]), pa.array(rank[stay]), pa.array(((places > hot) & (n > 0))[stay])], ["key", "rank", "hot"])

    return pairs.repartition("deal").sortWithinPartitions("deal").mapInArrow(run, "key long, rank long, hot boolean")


# ---------------------------------------------------------------- windows


def window_ranks(data: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 64 bits of the window at each start."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    one, two = np.full(len(start), BASE, U64), np.full(len(start), BASE2, U64)
    # the last eight bytes may overlap those before
    for k in [*range(0, window - 8, 8), window - 8]:
        x = eight[start + k]
        one, two = mix(one * U64(BASE) + x), mix((two ^ x) * U64(BASE2))
    return one.view(np.int64), two.view(np.int64)


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values first..last of each row."""
    size = last - first + 1
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + first[row]


def stretches(text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows at which stretches of neighbouring ones begin, and at which they end."""
    new = np.ones(len(start), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
    return np.flatnonzero(new), np.flatnonzero(np.roll(new, -1))


def least_ids(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each window, the least id among equal ones."""
    order = np.lexsort((ids, one))
    o, t, i = one[order], two[order], ids[order]
    head = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])])) if len(o) else np.zeros(0, np.int64)
    out = np.empty(len(o), np.int64)
    out[order] = np.repeat(i[head], np.diff(np.concatenate([head, [len(o)]])))
    return out


def with_positions(texts: DataFrame, found: str, bits: int, window: int, hot: np.ndarray, of_hot: bool, emit, schema: str, step: int) -> DataFrame:
    """What emit gives of the repeated positions of each step, of ranks that are hot or of the others."""

    def run(batches):
        beside = Beside(found, bits)
        for batch in batches:
            table = beside.of(batch.column(0).to_numpy())
            if table is None:
                continue
            mine, ranks = table["key"].to_numpy(), table["rank"].to_numpy()
            wanted = np.isin(ranks, hot) == of_hot
            mine, ranks = mine[wanted], ranks[wanted]
            known = np.unique((mine.view(U64) * U64(BASE)) ^ ranks.view(U64))
            batch = batch.filter(pa.array(np.isin(batch.column(0).to_numpy(), mine)))
            key, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offsets in text_steps(batch.column(2), step):
                rank, first, last, text = positions_of(data, offsets, window)
                pair = (key[lo:hi][text].view(U64) * U64(BASE)) ^ rank.view(U64)
                stay = known[np.minimum(np.searchsorted(known, pair), len(known) - 1)] == pair
                yield from emit(data, offsets, key[lo:hi], ids[lo:hi], rank[stay], first[stay], last[stay], text[stay])

    return texts.mapInArrow(run, schema)


def grown(texts: DataFrame, found: str, bits: int, window: int, hot: np.ndarray) -> DataFrame:
    """(rank, id, key, start, bytes): the windows of repeated positions whose ranks are not hot."""

    def emit(data, offsets, key, ids, rank, first, last, text):
        ends = np.concatenate([[0], np.cumsum(last + window - first)])
        _, at = spread(first, last + window - 1)
        raw = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[at])])
        yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(ids[text]), pa.array(key[text]), pa.array(first - offsets[text]), raw], ["rank", "id", "key", "start", "bytes"])

    return with_positions(texts, found, bits, window, hot, False, emit, "rank long, id long, key long, start long, bytes binary", STEP_BYTES)


def hot_windows(texts: DataFrame, found: str, bits: int, window: int, hot: np.ndarray) -> DataFrame:
    """(w1, w2, id, key, first, last): windows of hot ranks.

    Those that a smaller doc_id of the same step has too are stretches without ranks; of the
    others, every one has a row.
    """

    def emit(data, offsets, key, ids, rank, first, last, text):
        row, start = spread(first, last)
        one, two = window_ranks(data, start, window)
        text = text[row]
        own, start = ids[text], start - offsets[text]
        gone = own > least_ids(one, two, own)
        a, b = stretches(text[gone], start[gone])
        keys, none = key[text[gone]][a], pa.nulls(len(a), pa.int64())
        names = ["w1", "w2", "id", "key", "first", "last"]
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(keys), pa.array(start[gone][a]), pa.array(start[gone][b])], names)
        yield pa.RecordBatch.from_arrays([pa.array(x[~gone]) for x in (one, two, own, key[text], start, start)], names)

    return with_positions(texts, found, bits, window, hot, True, emit, "w1 long, w2 long, id long, key long, first long, last long", HOT_BYTES)


def reranked(rows: DataFrame, window: int) -> DataFrame:
    """(key, first, last): stretches of windows that a smaller doc_id has too; rows as grown() gives plain ones."""

    def resolved(table: pa.Table) -> pa.RecordBatch:
        raw = table["bytes"].combine_chunks().cast(pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8)
        row, at = spread(ends[:-1], ends[1:] - window)
        one, two = window_ranks(data, at, window)
        ids = table["id"].to_numpy()[row]
        marked = np.flatnonzero(ids > least_ids(one, two, ids))
        row, start = row[marked], (table["start"].to_numpy() - ends[:-1])[row[marked]] + at[marked]
        a, b = stretches(row, start)
        return pa.RecordBatch.from_arrays([pa.array(table["key"].to_numpy()[row][a]), pa.array(start[a]), pa.array(start[b])], ["key", "first", "last"])

    def run(batches):
        held, size = [], 0
        for table in whole_groups(batches, "rank"):
            held.append(table)
            size += table.nbytes
            if size > RANKED:
                yield resolved(pa.concat_tables(held).combine_chunks())
                held, size = [], 0
        if held:
            yield resolved(pa.concat_tables(held).combine_chunks())

    return rows.repartition("rank").sortWithinPartitions("rank").mapInArrow(run, "key long, first long, last long")


def hot_spans(windows: DataFrame) -> DataFrame:
    """(key, first, last) of windows that a smaller doc_id has too; windows is a stored table of hot_windows()."""
    single = windows.where(F.col("w1").isNotNull())
    least = single.groupBy("w1", "w2").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").drop("most")
    found = join_counted(single, stored(least, "least"), ["w1", "w2"], "n").where("id > least")
    return found.select("key", "first", "last").unionByName(windows.where(F.col("w1").isNull()).select("key", "first", "last"))


def cut_out(texts: DataFrame, spans: str, bits: int, window: int) -> DataFrame:
    """The result for every text, less the bytes of its spans."""
    empty = np.zeros(0, np.int64)

    def run(batches):
        beside = Beside(spans, bits)
        for batch in batches:
            key = batch.column(0).to_numpy()
            table = beside.of(key)
            marks = [empty] * 3 if table is None else [table[c].to_numpy() for c in ("key", "first", "last")]
            for lo, hi, data, offsets in text_steps(batch.column(2)):
                a, b = np.searchsorted(marks[0], key[lo]), np.searchsorted(marks[0], key[hi - 1], "right")
                text = np.searchsorted(key[lo:hi], marks[0][a:b])
                depth = np.zeros(len(data) + 1, np.int64)
                np.add.at(depth, offsets[text] + marks[1][a:b], 1)
                np.add.at(depth, offsets[text] + marks[2][a:b] + window, -1)
                gone = np.cumsum(depth)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                inner = offsets[:-1][offsets[:-1] < len(data)]
                edge[inner] = gone[inner]
                runs = np.concatenate([[0], np.cumsum(edge)])
                kept, ends = data[~gone].tobytes(), offsets - total[offsets]
                shas = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.diff(runs[offsets])), pa.array(shas, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = texts.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def suffix_dedup(docs: DataFrame, window: int = WINDOW, in_place: bool = False, hot_places: int = HOT_PLACES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs.

    in_place: docs is a scan of Parquet files and no more; otherwise it is written to the shared folder.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text") if not in_place else docs
    texts = placed(docs if in_place else stored(docs, "texts"))
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    seen = stored(texts.select("key", "id", sha.alias("sha"), F.octet_length("text").cast("long").alias("size")), "seen")
    rows, size = seen.agg(F.count(F.lit(1)), F.sum("size")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(10, math.ceil(math.log2(max(1, rows / (4 * parts)))))
    hot = max(hot_places, math.ceil((size or 0) * 2 / (window - GRAM + 2) / HOT_RANKS))
    classes = stored(seen.where(F.col("size") >= window).groupBy("sha").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "classes")
    copies = stored(join_counted(seen, classes, ["sha"], "n").where("id > least").select("key", F.lit(0).cast("long").alias("first"), (F.col("size") - window).alias("last")), "copies")
    pairs = ranked(texts, blocks(copies.select("key"), "copied", bits), bits, window)
    found = blocks(repeated(pairs, hot), "found", bits)
    schema = "key long, rank long, hot boolean, block long"
    hot_ranks = np.array([r.rank for r in spark.read.schema(schema).parquet(found).where("hot").select("rank").distinct().collect()], np.int64)
    spans = reranked(grown(texts, found, bits, window, hot_ranks), window).unionByName(copies)
    if len(hot_ranks):
        spans = spans.unionByName(hot_spans(stored(hot_windows(texts, found, bits, window, hot_ranks), "hot")))
    return cut_out(texts, blocks(spans, "spans", bits), bits, window)


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), in_place=True)


#: All windows as hexadecimal text, taken from pieces of 256 bytes; doc_id is a key of the table.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, s, substr(h, 2 * s + 1, {2 * (256 + WINDOW)}) AS h FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) // 2 AS BIGINT), 256)) AS s FROM d)),
g AS (SELECT doc_id, s + j AS i, substr(h, 2 * j + 1, {2 * WINDOW}) AS t FROM (SELECT *, unnest(range(0, 256)) AS j FROM q) WHERE len(h) >= 2 * (j + {WINDOW})),
f AS (SELECT t, min(doc_id) AS first FROM g GROUP BY t HAVING min(doc_id) < max(doc_id)),
x AS (SELECT doc_id, i FROM g JOIN f USING (t) WHERE doc_id > first),
b AS (SELECT doc_id, s + j AS i, substr(h, 2 * j + 1, 2) AS byte FROM (SELECT *, unnest(range(0, 256)) AS j FROM q) WHERE len(h) > 2 * j),
c AS (SELECT b.doc_id, b.i, byte, coalesce(max(x.i) OVER (PARTITION BY b.doc_id ORDER BY b.i), -{WINDOW}) > b.i - {WINDOW} AS gone
      FROM b LEFT JOIN x ON b.doc_id = x.doc_id AND b.i = x.i),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS edge FROM c),
k AS (SELECT doc_id, count(*) FILTER (gone) AS removed, count(*) FILTER (edge) AS spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
