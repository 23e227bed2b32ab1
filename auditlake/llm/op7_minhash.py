"""MinHash near-duplicates by an inverted join on signature coordinates.

1. A document's set of word shingles becomes a signature; equal sets become one class,
   represented by their smallest doc_id.
2. A class is posted under its coordinate-value pairs.  Long lists are counted, and a
   class posts only under its rarest pairs: if two classes must agree in t of n
   coordinates, they share a list among the n - t + 1 rarest of each.
3. Every list has a pivot, the member that stands in the longest lists.  Members whose
   coordinates agree with the pivot's often enough are compared with it on full sets;
   one row per member and pivot, however long the list.
4. Links found so far give components.  Members of a pivot's lists that lie in another
   component than the pivot are compared with its other members, in blocks: first
   coordinates are counted, then full sets intersected; a block returns only the links
   that join components.
5. The links of both steps give the final components.

The threshold t is the largest for which a pair at the least similarity falls below it
with a probability of at most 1e-9; every link is confirmed on full sets of 64-bit
shingle hashes.

Defined cases: no words or null text means an empty set, linked with nothing and kept;
fewer words than a shingle has are one shingle; rows that share a doc_id are one node
of the links; a null doc_id counts as larger than any other and its component_id is
null if nothing smaller is reachable; an empty table gives an empty result; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import BASE, U64, Words, documents, join_counted, joined, mix, sieved, sliding, stored, text_steps
from auditlake.llm.components import components

SHINGLE_WORDS, PERCENT = 3, 85
COORDINATES = 48
MISS = 1e-9
#: Lists with more members are counted when a class picks its rarest pairs.
LONG = 16
#: Members in a block, and bytes of their texts.
BLOCK, BLOCK_BYTES = 256, 16 << 20
NULL_ID = (1 << 63) - 1


def matches_needed(percent: int, n: int = COORDINATES) -> int:
    """The largest t for which a pair of that similarity agrees in fewer than t coordinates with probability up to MISS."""
    p, tail = percent / 100, 0.0
    for t in range(n + 1):
        tail += math.comb(n, t) * p**t * (1 - p) ** (n - t)
        if tail > MISS:
            return max(1, t)
    return n


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    every, out = sliding(joined, words.hash, width), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        else:
            out.append(sliding(joined, words.hash[a:b], b - a) if b > a else every[:0])
    return out


def sets_of(column: pa.Array, width: int) -> list[np.ndarray]:
    return [s for _, _, data, offsets in text_steps(column) for s in shingle_sets(Words(data, offsets, lower=True), width)]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """id, n (set size), k1 and k2 (hash of the set), posts (a key for each coordinate-value pair)."""

    def run(batches):
        k = np.arange(1, COORDINATES + 1, dtype=U64)
        up, add = mix(k * U64(BASE)) | U64(1), mix(k)
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(1)):
                sets = shingle_sets(Words(data, offsets, lower=True), width)
                size = np.array([len(x) for x in sets])
                full = np.flatnonzero(size)
                key, low = np.zeros((2, hi - lo), U64), np.zeros((hi - lo, COORDINATES), U64)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    at = np.cumsum(size[full]) - size[full]
                    for c in range(2):
                        key[c, full] = np.add.reduceat(mix(every ^ add[c]), at)
                    for c in range(COORDINATES):
                        low[full, c] = np.minimum.reduceat(every * up[c] + add[c], at)
                posts = mix(low ^ up)  # the multipliers tell the coordinates apart
                ends = pa.array(np.arange(hi - lo + 1) * COORDINATES, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), *(pa.array(x.view(np.int64)) for x in key), pa.ListArray.from_arrays(ends, pa.array(posts.view(np.int64).ravel()))],
                    ["id", "n", "k1", "k2", "posts"],
                )

    return docs.mapInArrow(run, "id long, n long, k1 long, k2 long, posts array<bigint>")


def rarest_posts(classes: DataFrame, t: int) -> DataFrame:
    """rep, weight (how long its lists are) and a row for each of its n - t + 1 rarest keys; classes is a stored table."""
    every = classes.select("rep", "k1", F.explode("posts").alias("key"))
    long = stored(every.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > LONG), "long-lists")
    own = join_counted(every, long, ["key"], "c").groupBy("rep", "k1").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("long"))  # up to COORDINATES for each class
    rows = classes.select("rep", "k1", "posts").join(own, ["rep", "k1"], "left")
    common = F.coalesce(F.transform("long", lambda x: x["key"]), F.array().cast("array<bigint>"))
    weight = F.coalesce(F.aggregate("long", F.lit(0).cast("long"), lambda a, x: a + x["c"]), F.lit(0))
    order = F.concat(F.sort_array(F.array_except("posts", common)), common)
    return rows.select("rep", weight.cast("long").alias("weight"), F.explode(F.slice(order, 1, COORDINATES - t + 1)).alias("key"))


def pivot_members(posts: DataFrame) -> DataFrame:
    """(pivot, rep) once for each pivot of the lists that a class stands in; posts is a stored table."""
    top = F.max(F.struct("weight", (-F.col("rep")).alias("r"))).alias("top")
    lists = stored(posts.groupBy("key").agg(top, F.count(F.lit(1)).alias("c")).where("c > 1").select("key", (-F.col("top.r")).alias("pivot"), "c"), "lists")
    return join_counted(posts.select("key", "rep"), lists, ["key"], "c").select("pivot", "rep").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; pairs is a stored table."""

    def run(batches):
        for batch in batches:
            step = 256
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x, y = (sets_of(part.column(k), width) for k in (2, 3))
                same = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)])
                whole = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)]) - same
                yield part.select([0, 1]).filter(pa.array(100 * same >= percent * whole))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts = sieved(texts, "id", ends, "_mark").where("_mark")
    a, b = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def blocks(members: DataFrame, least: int) -> DataFrame:
    """Rows of (pivot, rep, component, out, ...) dealt into blocks; out: in another component than the pivot.

    Blocks of outside members meet each other and the blocks of the pivot's own
    component, whose members are linked already.  A pivot without outside members, or with
    fewer than `least` in all, has none.  A block has about BLOCK members, and fewer if
    they have more than BLOCK_BYTES by a column bytes.  members is a stored table.
    """
    size_of = F.col("bytes") if "bytes" in members.columns else F.lit(0)
    parts = [f(c).alias(k + n) for n, c in (("out", F.col("out")), ("in", ~F.col("out"))) for k, f in (("n_", F.count_if), ("bytes_", lambda c: F.sum(F.when(c, size_of).otherwise(0))))]
    size = members.groupBy("pivot").agg(*parts).where(f"n_out > 0 and n_out + n_in >= {least}")
    size = stored(size.withColumn("n", F.col("n_out") + F.col("n_in")), "sizes")
    rows = join_counted(members, size, ["pivot"], "n")
    n_out, n_in = (F.ceil(F.greatest(F.col(f"n_{c}") / BLOCK, F.col(f"bytes_{c}") / BLOCK_BYTES)).cast("int") for c in ("out", "in"))
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.when(F.col("out"), n_out).otherwise(n_in)).cast("int")
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    outside = F.transform(F.sequence(F.lit(0), n_out - 1), lambda j: cell("out", F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
    across = F.transform(F.sequence(F.lit(0), n_in - 1), lambda i: cell("in", i, F.col("own")))
    inside = F.transform(F.sequence(F.lit(0), n_out - 1), lambda j: cell("in", F.col("own"), j))
    return rows.withColumn("own", own).select(*members.columns, F.explode(F.when(F.col("out"), F.concat(outside, across)).otherwise(inside)).alias("cell")).select(*members.columns, "cell.*")


def agreeing(rows: DataFrame, t: int) -> DataFrame:
    """(pivot, rep) of the block members with a partner in another component that agrees in t coordinates."""

    def run(table: pa.Table) -> pa.Table:
        component = table.column("component").to_numpy()
        posts = table.column("posts").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        out = np.flatnonzero(table.column("out").to_numpy(zero_copy_only=False))
        hit = np.zeros(len(component), bool)
        for i in out.tolist():
            near = ((posts == posts[i]).sum(axis=1) >= t) & (component != component[i])
            hit |= near
            hit[i] |= near.any()
        return table.select(["pivot", "rep"]).filter(pa.array(hit))

    # one row per member of a block at most
    return rows.groupBy("pivot", "kind", "i", "j").applyInArrow(run, "pivot long, rep long").distinct()


def joining_links(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between members of a block in different components, confirmed on full sets: a forest of each block."""

    def run(table: pa.Table) -> pa.Table:
        component, out = table.column("component").to_numpy(), table.column("out").to_numpy(zero_copy_only=False)
        rep = table.column("rep").to_numpy()
        sets = sets_of(table.column("text"), width)
        size = np.array([len(s) for s in sets])
        values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        shared = count[column] > 1  # no other shingle is in two sets
        order = np.flatnonzero(shared)[np.argsort(column[shared], kind="stable")]
        row, column = row[order], np.unique(column[order], return_inverse=True)[1]
        x = np.flatnonzero(out)
        same = np.zeros((len(x), len(sets)), np.float32)
        total, step = int(column.max(initial=-1)) + 1, 4096
        for lo in range(0, total, step):
            a, b = np.searchsorted(column, (lo, lo + step))
            part = np.zeros((len(sets), step), np.float32)
            part[row[a:b], column[a:b] - lo] = 1
            same += part[x] @ part.T
        near = (100 * same >= percent * (size[x][:, None] + size[None] - same)) & (component[x][:, None] != component[None])
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c] = root.get(root[c], root[c])
            return c

        links = []
        for i, j in zip(*np.nonzero(near), strict=True):
            p, q = top(int(component[x[i]])), top(int(component[j]))
            if p != q:
                root[p] = q
                links.append((int(rep[x[i]]), int(rep[j])))
        return pa.table({"a": pa.array([p for p, _ in links], pa.int64()), "b": pa.array([q for _, q in links], pa.int64())})

    return rows.groupBy("pivot", "kind", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    t = matches_needed(percent)
    d = docs.select("doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    signs = stored(signatures(d, width), "signatures")
    same = ["n", "k1", "k2"]
    classes = stored(signs.where("n > 0").groupBy(*same).agg(F.min("id").alias("rep"), F.first("posts").alias("posts")), "classes")
    members = stored(pivot_members(stored(rarest_posts(classes, t), "posts")), "members")
    sign = lambda c: classes.select(F.col("rep").alias(c), F.col("posts").alias(f"posts_{c}"), F.col("n").alias(f"n_{c}"))
    pairs = members.where("pivot <> rep").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).join(sign("a"), "a").join(sign("b"), "b")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = stored(pairs.where(fits & (F.size(F.array_intersect("posts_a", "posts_b")) >= t)).select("a", "b").distinct(), "pairs")
    links = stored(confirmed(pairs, d, width, percent), "links")
    found = components(links)
    # classes in another component than their pivot
    label = F.coalesce("component", "rep")
    tagged = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("pivot", "rep", label.alias("component"))
    pivots = tagged.where("pivot = rep").select("pivot", F.col("component").alias("pivot_component"))
    tagged = stored(tagged.join(pivots, "pivot").select("pivot", "rep", "component", (F.col("component") != F.col("pivot_component")).alias("out")), "tagged")
    # a member alone with its pivot has been compared already
    active = stored(agreeing(blocks(tagged, least=3).join(classes.select("rep", "posts"), "rep"), t), "active")
    texts = d.withColumnRenamed("id", "rep")
    size = texts.select("rep", F.octet_length("text").alias("bytes"))
    rest = stored(tagged.join(active, ["pivot", "rep"]).join(size, "rep"), "rest")
    texts = sieved(texts, "rep", rest.select("rep"), "_mark").where("_mark").drop("_mark")
    more = stored(joining_links(blocks(rest, least=2).join(texts, "rep"), width, percent), "more-links")
    final = components(links.union(more))
    of = signs.select("id", *same).join(classes.select(*same, "rep"), same, "left").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    null_id = F.lit(NULL_ID)
    return of.select(F.nullif("id", null_id).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(component, null_id).alias("component_id"), (F.col("id") == component).alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


#: All pairs of classes that share a shingle; doc_id is a key of the table.
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {SHINGLE_WORDS} THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - {SHINGLE_WORDS - 2}), lambda i: array_to_string(words[i:i + {SHINGLE_WORDS - 1}], ' ')) END)) AS shingles FROM w),
c AS (SELECT doc_id, len(shingles) AS n, CASE WHEN len(shingles) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY shingles) END AS rep, shingles FROM g),
s AS MATERIALIZED (SELECT rep, n, unnest(shingles) AS shingle FROM c WHERE doc_id = rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.rep < b.rep
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT node, min(other) AS component FROM r GROUP BY node)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component, rep) AS component_id, doc_id = coalesce(component, rep) AS kept
FROM c LEFT JOIN m ON rep = node
"""
