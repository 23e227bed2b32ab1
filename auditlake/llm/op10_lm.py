"""Language model scores by deleted interpolation.

A token's probability is a mixture of the maximum-likelihood estimates of its bigram
and of its word and of a uniform share.  The weights depend on a bucket of how often
the context word occurs and are learned by expectation-maximisation on all tokens of a
fold of the training documents, at any size; for each document its own counts, and
no others, are deleted from the corpus counts first.  If that fold is empty, all
training documents are learned from.  Tasks sum the expectations of a round, so that
the driver gets a row for each bucket.

Counts cover every training document and stay distributed.  Neighbouring rows of a
file with texts of like length form blocks of bounded bytes; a block asks once for each
of its distinct n-grams, bringing its own counts along.  Requests meet by part of the key
space, so many parts that one is small at any size, are added up there, and go back to
the folders of their blocks, where the tasks that read those rows again look them up.  An
n-gram that one training document alone has once needs no answer.  Both ways the keys
that go together travel packed, as differences of sorted numbers.

Defined cases: null or empty text is one end token; repeated rows are separate
documents; without training documents every count is 0 and the base score of a token is
log10(1) = 0; an empty table gives an empty result; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import BASE, BASE2, U64, Words, fold, mix, shared_path, stored, text_steps
from auditlake.llm.op5_warc import open_store

#: Bytes of text in a block, at most; short texts have up to so many bytes, and each class after them STEP times as many.
BLOCK_BYTES, SHORT, STEP = 256 << 20, 32 << 10, 16
#: A bucket for each power of two of 64 bits.
BUCKETS, ROUNDS, SETTLED, FLOOR = 64, 30, 5e-4, 1e-6
DEFAULT = (0.4, 0.4, 0.2)
#: The hash of the end token, which is no word's, and of the start of a text as a context.
END, START = U64(0x1F83D9ABFB41BD6B), U64(0x5BE0CD19137E2179)
#: The block and bucket of rows that hold sums over the corpus.
SUMS = -1
#: N-grams that a task holds before it adds up equal ones, and then at most; and that it keeps of read answers.
HELD_KEYS, KEPT_KEYS, LOADED_KEYS = 4_000_000, 2_500_000, 4_000_000
#: Bytes of text for each part of the key space, whose n-grams one task adds up, and for each folder of answers.
PART_BYTES, BUCKET_BYTES = 8 << 20, 256 << 20
#: Bytes of answers that are read together.
GROUP_BYTES = 2 << 20


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the block of each row."""
    at = lambda d: d.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    try:
        rows = at(docs)
    except AnalysisException:  # not rows of files
        rows = at(stored(docs.select("doc_id", "text"), "documents"))
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    # texts of up to SHORT, STEP * SHORT, STEP**2 * SHORT ... bytes
    tier = F.greatest(F.lit(0), F.ceil(F.log2((F.octet_length("text") + 1) / SHORT) / math.log2(STEP))).cast("int")
    rows = rows.withColumn("tier", tier)
    run = F.greatest(F.lit(1.0), F.lit(float(BLOCK_BYTES // SHORT)) / F.pow(F.lit(float(STEP)), "tier"))
    block = F.shiftrightunsigned(F.xxhash64("file", "tier", F.floor(F.col("place") / run)), 1)
    return rows.select("doc_id", "text", block.alias("block"))


def ngrams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the unigrams, contexts and bigrams of all tokens, and token offsets of the documents.

    The last bit tells unigrams from bigrams; the start as a context has the end's key,
    as it occurs as often.
    """
    docs = len(words.first) - 1
    first = words.first + np.arange(docs + 1)
    token = np.full(first[-1], END, U64)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    token[inside] = words.hash
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[first[:-1]] = START
    bigram = mix(context * U64(BASE) + mix(token + U64(BASE2))) & ~U64(1)
    context[first[:-1]] = END
    return token | U64(1), context | U64(1), bigram, first


def planes(*columns: np.ndarray) -> bytes:
    """Whole numbers from 0: each byte of a number with its like, without bytes that are 0 throughout, compressed."""
    out = [len(columns[0]).to_bytes(8, "little")]
    for x in columns:
        rows = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
        used = rows.any(axis=1)
        out += [np.packbits(used).tobytes(), rows[used].tobytes()]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def numbers(packed: bytes, columns: int) -> list[np.ndarray]:
    """Unsigned columns of planes."""
    raw = pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for _ in range(columns):
        used = np.unpackbits(np.frombuffer(raw, np.uint8, 1, at)).astype(bool)
        rows = np.zeros((8, n), np.uint8)
        rows[used] = np.frombuffer(raw, np.uint8, int(used.sum()) * n, at + 1).reshape(-1, n)
        at += 1 + int(used.sum()) * n
        out.append(np.ascontiguousarray(rows.T).view("<u8").reshape(n))
    return out


def pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys, as their differences, with whole numbers."""
    return planes(np.diff(keys, prepend=U64(0)), values)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, values = numbers(packed, 2)
    return np.cumsum(keys, dtype=U64), values


def requests(rows: DataFrame, parts: int) -> DataFrame:
    """(part, block, packed): a block's keys in one part of the key space, counts in its training documents
    times two, plus one if a document outside training has the key."""

    def run(batches):
        held: dict[int, list] = {}

        def added_up(block):
            key, n, asks = (np.concatenate(x) for x in zip(*held[block], strict=True))
            order = np.argsort(key)
            key = key[order]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            held[block] = [(key[at], np.add.reduceat(n[order], at).astype(np.int32), np.maximum.reduceat(asks[order], at))]

        def counted(block):
            added_up(block)
            ((key, n, asks),) = held.pop(block)
            cut = np.searchsorted(key, (np.arange(parts + 1).astype(object) * (1 << 64) // parts).clip(0, (1 << 64) - 1).astype(U64))
            cut[-1] = len(key)
            both = n.astype(U64) * U64(2) + asks.astype(U64)
            full = np.flatnonzero(np.diff(cut)).tolist()
            for lo in range(0, len(full), 64):
                part = full[lo : lo + 64]
                packed = [pack(key[cut[p] : cut[p + 1]], both[cut[p] : cut[p + 1]]) for p in part]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([block] * len(part), pa.int64()), pa.array(packed, pa.binary())], ["part", "block", "packed"])

        def size():
            return sum(len(x[0]) for pieces in held.values() for x in pieces)

        for batch in batches:
            blocks, role = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lo, hi, data, offsets in text_steps(batch.column(0)):
                one, _, two, first = ngrams(Words(data, offsets, lower=True))
                for block, mine, at in by_block(blocks[lo:hi], first):
                    train = np.repeat((role[lo:hi][mine] > 0).astype(np.int8), np.diff(first)[mine])
                    held[block] = held.pop(block, []) + [(keys[at], train.astype(np.int32), 1 - train) for keys in (one, two)]
                if size() > HELD_KEYS:
                    for block in held:
                        added_up(block)
                    # the blocks that have gone longest without a row leave first
                    while held and size() > KEPT_KEYS:
                        yield from counted(next(iter(held)))
        for block in list(held):
            yield from counted(block)

    return rows.select("text", "block", "role").mapInArrow(run, "part int, block long, packed binary")


def by_block(blocks: np.ndarray, first: np.ndarray):
    """(block, its documents, places of their tokens); first: token offsets of the documents."""
    for block in np.unique(blocks).tolist():
        mine = np.flatnonzero(blocks == block)
        if len(mine) == len(blocks):
            yield block, mine, np.arange(first[-1])
        else:
            yield block, mine, np.concatenate([np.arange(first[k], first[k + 1]) for k in mine.tolist()])


def answers(asked: DataFrame) -> DataFrame:
    """(block, packed): corpus counts of the n-grams that a block needs; and the corpus sums, as tokens and words of block SUMS.

    asked comes with the rows of a part together.
    """
    kinds = pa.schema([("block", pa.int64()), ("packed", pa.binary()), ("tokens", pa.int64()), ("words", pa.int64())])

    def run(batches):
        sums = np.zeros(2, np.int64)

        def answered(pieces):
            """pieces: (block, packed) of one part of the key space."""
            keys, both = zip(*(unpack(raw) for _, raw in pieces), strict=True)
            every, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, place, np.concatenate(both).view(np.int64) >> 1)
            words = (every & U64(1)) == 1
            sums[:] += total[words].sum(), (total[words] > 0).sum()
            of: dict[int, list] = {}
            at = 0
            for (block, _), key, x in zip(pieces, keys, both, strict=True):
                n = total[place[at : at + len(key)]]
                at += len(key)
                need = (n > 1) | ((n == 1) & ((x & U64(1)) == 1))
                of.setdefault(block, []).append((key[need], n[need].view(U64)))
            rows = []
            for block, found in of.items():
                key, n = found[0]
                if len(found) > 1:  # a block that several tasks read asks more than once
                    key, first = np.unique(np.concatenate([k for k, _ in found]), return_index=True)
                    n = np.concatenate([x for _, x in found])[first]
                if len(key):
                    rows.append({"block": block, "packed": pack(key, n)})
            return pa.RecordBatch.from_pylist(rows, schema=kinds)

        part, pieces = None, []
        for batch in batches:
            for p, block, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if p != part and pieces:
                    yield answered(pieces)
                    pieces = []
                part = p
                pieces.append((block, raw))
        if pieces:
            yield answered(pieces)
        yield pa.RecordBatch.from_pylist([{"block": SUMS, "packed": None, "tokens": int(sums[0]), "words": int(sums[1])}], schema=kinds)

    return asked.mapInArrow(run, "block long, packed binary, tokens long, words long")


class Answers:
    """Sorted keys and counts of blocks, read from their folder; some are kept."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets, self.kept = folder, buckets, {}

    def of(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        if block in self.kept:
            self.kept[block] = self.kept.pop(block)
            return self.kept[block]
        while self.kept and sum(len(k) for k, _ in self.kept.values()) > LOADED_KEYS:
            del self.kept[next(iter(self.kept))]
        self.kept[block] = self.load(block)
        return self.kept[block]

    def load(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = open_store(f"{self.folder}/bucket={block % self.buckets}")
        rows = []
        for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if not f.path.endswith(".parquet"):
                continue
            with store.open_input_file(f.path) as opened:
                file = pq.ParquetFile(opened)
                for k in range(file.num_row_groups):
                    limits = file.metadata.row_group(k).column(0).statistics
                    if limits is None or limits.min <= block <= limits.max:
                        table = file.read_row_group(k, columns=["block", "packed"])
                        rows += [raw for raw, b in zip(table.column(1), table.column(0).to_pylist(), strict=True) if b == block]
        # each row is of one part of the key space
        found = sorted((unpack(raw.as_py()) for raw in rows), key=lambda x: int(x[0][0]))
        if not found:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        key, n = (np.concatenate(x) for x in zip(*found, strict=True))
        return key, n.view(np.int64)


def find(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: np.ndarray) -> np.ndarray:
    have, n = known
    if not len(have):
        return missing.copy()
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return np.where(have[at] == keys, n[at], missing)


def counts(known: Answers, blocks: np.ndarray, grams: tuple, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corpus counts of the context, word and bigram of each token; without an answer, missing."""
    one, context, two, first = grams
    c1, c2, c0 = missing.copy(), missing.copy(), np.empty_like(missing)
    head = np.zeros(len(one), bool)
    head[first[:-1]] = True
    for block, mine, at in by_block(blocks, first):
        have = known.of(block)
        c1[at], c2[at] = find(have, one[at], missing[at]), find(have, two[at], missing[at])
        start = first[:-1][mine]
        c0[start] = find(have, context[start], missing[start])
    c0[1:][~head[1:]] = c1[:-1][~head[1:]]
    return c0, c1, c2


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one for each power of two."""
    return np.where(context > 0, 1 + np.log2(np.maximum(context, 1)).astype(np.int64), 0)


def estimates(one, context, two, total, words: int) -> np.ndarray:
    """Bigram, word and uniform estimate of each token."""
    return np.stack([two / np.maximum(context, 1), one / np.maximum(total, 1), np.full(len(one), 1 / (words + 1))], axis=1)


def maximised(expect) -> np.ndarray:
    """Weights of each bucket; expect(weights) has each bucket's tokens and the sums of their shares by estimate."""
    weights = np.tile(np.array(DEFAULT), (BUCKETS, 1))
    weights[0] = (0, 0.7, 0.3)
    for _ in range(ROUNDS):
        seen, shares = expect(weights)
        # rounded, as sums of tasks come in any order
        better = np.where(seen[:, None] > 0, np.round(shares / np.maximum(seen, 1)[:, None], 12), weights)
        moved, weights = (np.abs(better - weights).max(axis=1) * seen).sum(), better
        if moved <= SETTLED * seen.sum():
            break
    weights = np.maximum(weights, FLOOR)
    weights[0, 0] = 0
    return weights / weights.sum(axis=1, keepdims=True)


def expected(parts: np.ndarray, at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's tokens and the sums of their shares, from tokens with estimates parts in buckets at."""
    share = parts * weights[at]
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
    return np.bincount(at, minlength=BUCKETS), np.stack([np.bincount(at, share[:, c], BUCKETS) for c in range(parts.shape[1])], axis=1)


def expectation_maximisation(parts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weights of each bucket, from tokens with estimates parts in buckets at."""
    return maximised(lambda weights: expected(parts, at, weights))


def own_counts(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often the document of each key has it."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    at = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])))
    size = np.diff(np.append(at, len(k)))
    out = np.empty(len(k), np.int64)
    out[order] = np.repeat(size, size)
    return out


def left_out(rows: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Counts of context, word, bigram and tokens of the document, packed, for each token of training documents;
    the first three without the document's own."""

    def run(batches):
        known = Answers(folder, buckets)
        for batch in batches:
            blocks = batch.column(1).to_numpy()
            for lo, hi, data, offsets in text_steps(batch.column(0)):
                grams = one, context, two, first = ngrams(Words(data, offsets, lower=True))
                size = np.diff(first)
                doc = np.repeat(np.arange(len(size)), size)
                # without an answer an n-gram of a training document is its own only one
                c0, c1, c2 = counts(known, blocks[lo:hi], grams, np.ones(len(one), np.int64))
                own = own_counts(one, doc)
                before = np.ones_like(own)  # the start of the document itself
                before[1:] = own[:-1]
                before[first[:-1]] = 1
                yield pa.RecordBatch.from_arrays([pa.array([planes(c0 - before, c1 - own, c2 - own_counts(two, doc), size[doc])], pa.binary())], ["packed"])

    return rows.select("text", "block").mapInArrow(run, "packed binary")


def learned_weights(rows: DataFrame, folder: str, buckets: int, total: int, words: int) -> np.ndarray:
    """The mixture weights, from all rows of role 2."""
    tokens = stored(left_out(rows.where("role = 2"), folder, buckets), "left-out")

    def expect(weights):
        def run(batches):
            seen, sums = np.zeros(BUCKETS, np.int64), np.zeros((BUCKETS, 3))
            for batch in batches:
                for raw in batch.column(0):
                    c0, c1, c2, size = (x.view(np.int64) for x in numbers(raw.as_py(), 4))
                    more = expected(estimates(c1, c0, c2, total - size, words), bucket(c0), weights)
                    seen, sums = seen + more[0], sums + more[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(seen), *(pa.array(x) for x in sums.T)], ["bucket", "seen", "s2", "s1", "s0"])

        found = tokens.mapInArrow(run, "bucket long, seen long, s2 double, s1 double, s0 double")
        seen, sums = np.zeros(BUCKETS, np.int64), np.zeros((BUCKETS, 3))
        for r in found.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("seen", "s2", "s1", "s0")]).collect():  # a row for each bucket
            seen[r["bucket"]], sums[r["bucket"]] = r["seen"], (r["s2"], r["s1"], r["s0"])
        return seen, sums

    return maximised(expect)


def scores(docs: DataFrame, folds: int = 7, out: int = 2) -> DataFrame:
    """op10's columns for each row of docs; documents in fold `out` are not learned from."""
    spark = docs.sparkSession
    rows = placed(docs)
    held_out = fold("doc_id", folds) == out
    weighed = fold("doc_id", folds) == (out + 1) % folds
    have = docs.agg(F.sum(F.octet_length("text")), F.count_if(weighed)).first()
    if not have[1]:
        weighed = F.lit(True)
    # 0: not learned from, 1: learned from, 2: learned from, and the weights are learned on it
    rows = rows.withColumn("role", F.when(held_out, 0).when(weighed, 2).otherwise(1).cast("int"))
    folder = shared_path(spark, "answers")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(partitions, (have[0] or 0) // PART_BYTES)
    buckets = max(partitions, (have[0] or 0) // BUCKET_BYTES)
    asked = requests(rows, parts).repartition(parts, "part").sortWithinPartitions("part")
    nothing = spark.sql(f"SELECT CAST({SUMS} AS LONG) AS block, CAST(NULL AS BINARY) AS packed, 0L AS tokens, 0L AS words")
    placed_answers = answers(asked).unionByName(nothing).withColumn("bucket", F.when(F.col("block") == SUMS, SUMS).otherwise(F.col("block") % buckets))
    placed_answers.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").write.option("parquet.block.size", GROUP_BYTES).partitionBy("bucket").parquet(folder)
    sums = spark.read.schema("tokens long, words long").parquet(f"{folder}/bucket={SUMS}").agg(F.sum("tokens"), F.sum("words")).first()
    total, words = sums[0] or 0, sums[1] or 0
    weights = learned_weights(rows, folder, buckets, total, words)
    field = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known = Answers(folder, buckets)
        for batch in batches:
            blocks, role = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for lo, hi, data, offsets in text_steps(batch.column(1)):
                grams = one, _, _, first = ngrams(Words(data, offsets, lower=True))
                # without an answer an n-gram of a training document is its own only one
                missing = np.repeat((role[lo:hi] > 0).astype(np.int64), np.diff(first))
                c0, c1, c2 = counts(known, blocks[lo:hi], grams, missing)
                p = (estimates(c1, c0, c2, total, words) * weights[bucket(c0)]).sum(axis=1)
                base = np.log10((c1 + 1) / (total + words + 1))
                at = first[:-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(role[lo:hi] == 0), pa.array(np.diff(first)), pa.array(np.add.reduceat((c1 > 0).astype(np.int64), at)), pa.array(np.full(hi - lo, total)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = f"doc_id {field}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.select("doc_id", "text", "block", "role").mapInArrow(run, schema)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
