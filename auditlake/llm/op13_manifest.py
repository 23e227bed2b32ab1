"""A Merkle manifest of a dataset: leaves of rows, a tree for each language, one root.

Leaves are placed by a sort over ranges.  A task then takes one aligned block of
2**BLOCK_BITS nodes and walks its subtree recursively in postorder: each call returns the
digest of its subtree and, while unwinding, appends each half's digest as a sibling to the
leaves of the other half.  The roots of the blocks are the nodes of the next traversal, up
to one node for each language; the languages' nodes form the last tree in the same way.
Siblings of a block's root are then appended to those of its nodes on the way down.

Defined cases: a null lang is a tree of its own, before all others; a null doc_id comes
before any other; rows with equal lang and doc_id are ordered by leaf, equal rows have equal
leaves in neighbouring places; a null doc_id or n_chars is not tampered with; an empty table
gives an empty result; a very long text is hashed where it is read; columns other than
doc_id, source, lang, n_chars and text are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import documents, positions, stored

#: Levels that one task walks, of one block of nodes.
BLOCK_BITS = 10
#: One document in so many is tampered with, by its id's checksum.
TAMPERED = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def framed(values: list[Column]) -> Column:
    """The SHA-256 of the values, each with its length in bytes; null is a dash."""
    text = [v.cast("string") for v in values]
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in text]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, changed): changed is the leaf of a row tampered with, or leaf again."""
    value = {c: F.col(c) for c in FIELDS}
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    # no language sorts before every language
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    leaf = framed(list(value.values()))
    return docs.select(tree.alias("tree"), "doc_id", leaf.alias("leaf"), F.when(hit, framed(list((value | {"n_chars": more}).values()))).otherwise(leaf).alias("changed"))


def walked(nodes: list[str], height: int) -> tuple[str, list[list[str]], list[list[str]]]:
    """The root of a block of nodes, and of each node its siblings with their sides, from below."""
    siblings: list[list[str]] = [[] for _ in nodes]
    sides: list[list[str]] = [[] for _ in nodes]

    def visit(start: int, end: int, level: int) -> str:
        if level == 0:
            return nodes[start]
        middle = start + (1 << (level - 1))
        left = visit(start, min(middle, end), level - 1)
        if middle >= end:  # the last run has one node
            for k in range(start, end):
                sides[k].append("-")
            return digest(left)
        right = visit(middle, end, level - 1)
        for k in range(start, middle):
            siblings[k].append(right)
            sides[k].append("r")
        for k in range(middle, end):
            siblings[k].append(left)
            sides[k].append("l")
        return digest(left + right)

    return visit(0, len(nodes), height), siblings, sides


def traversed(nodes: DataFrame, bits: int) -> DataFrame:
    """nodes (tree, at, n, digest, ...) with block, and siblings, sides and top within the block."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        height = min(bits, (block["n"][0].as_py() - 1).bit_length())
        top, siblings, sides = walked(block["digest"].to_pylist(), height)
        block = block.append_column("siblings", pa.array([bytes.fromhex("".join(s)) for s in siblings], pa.binary()))
        block = block.append_column("sides", pa.array(["".join(s) for s in sides], pa.string()))
        return block.append_column("top", pa.array([top] * len(block), pa.string()))

    rows = nodes.withColumn("block", F.shiftright("at", bits))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return stored(rows.groupBy("tree", "block").applyInArrow(run, f"{schema}, siblings binary, sides string, top string"), "traversed")


def climbed(nodes: DataFrame, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The traversals from the nodes up, and (tree, digest) of the roots."""
    levels = []
    while True:
        level = traversed(nodes, bits)
        levels.append(level)
        # the first node of each block stands for it
        nodes = level.where(F.col("at") % (1 << bits) == 0).select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / F.lit(1 << bits)).cast("long").alias("n"), F.col("top").alias("digest"))
        if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
            return levels, nodes.select("tree", "digest")


def descended(levels: list[DataFrame], upper: DataFrame) -> DataFrame:
    """The lowest level's nodes with all their siblings; upper: tree, siblings and sides of the roots, and what to carry."""
    carried = [c for c in upper.columns if c not in ("tree", "siblings", "sides")]
    upper = upper.withColumn("at", F.lit(0).cast("long"))
    for level in reversed(levels):
        above = upper.select("tree", F.col("at").alias("block"), F.col("siblings").alias("_siblings"), F.col("sides").alias("_sides"), *carried)
        joined = level.drop("n", "digest", "top").join(above, ["tree", "block"])
        upper = joined.select(*[c for c in level.columns if c not in ("n", "digest", "top", "siblings", "sides", "block")], F.concat("siblings", "_siblings").alias("siblings"), F.concat("sides", "_sides").alias("sides"), *carried)
    return upper


def folded(node: str, siblings: bytes, sides: str) -> str:
    """The root that a node and its siblings lead to."""
    hexed, at = siblings.hex(), 0
    for side in sides:
        if side == "-":
            node = digest(node)
            continue
        sibling = hexed[at : at + 64]
        node, at = digest(node + sibling if side == "r" else sibling + node), at + 64
    return node


def manifest(docs: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs."""
    rows = stored(leaves(docs.select(*FIELDS)), "leaves")
    placed = positions(rows, ["tree"], [F.col("doc_id").asc_nulls_first(), "leaf"])
    levels, subroots = climbed(placed.withColumn("digest", F.col("leaf")), bits)
    trees = stored(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("own"), "digest"), "subroots")
    upper_levels, roots = climbed(positions(trees, ["tree"], ["own"]).withColumn("subroot", F.col("digest")), bits)
    top = roots.select("tree", F.unhex(F.lit("")).alias("siblings"), F.lit("").alias("sides"), F.col("digest").alias("root"))
    above = descended(upper_levels, top).select(F.col("own").alias("tree"), "siblings", "sides", "subroot", "root")
    proofs = descended(levels, above)

    def check(batches):
        for b in batches:
            node, siblings, sides = (b.column(k).to_pylist() for k in ("changed", "siblings", "sides"))
            proof = [digest(s.hex()) for s in siblings]
            found = [folded(*x) for x in zip(node, siblings, sides, strict=True)]
            same = [x == y for x, y in zip(found, b.column("root").to_pylist(), strict=True)]
            columns = [b.column(k) for k in ("doc_id", "leaf", "subroot", "root")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(proof, pa.string()), pa.array(found, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = proofs.select("doc_id", "leaf", "changed", "siblings", "sides", "subroot", "root")
    return columns.mapInArrow(check, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir, *FIELDS))


FRAMED = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END".format
LEAF = lambda n_chars: "sha256(" + " || ".join(FRAMED(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"
#: The reflected polynomial 0xEDB88320, bit by bit.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"
#: doc_id is a key of the table.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, k, leaf, changed, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n
  FROM (SELECT doc_id, coalesce('=' || lang, '') AS k, {LEAF('n_chars')} AS leaf, CASE WHEN {CRC} % {TAMPERED} = 0 AND n_chars IS NOT NULL THEN {LEAF('(n_chars::HUGEINT + 1)')} ELSE {LEAF('n_chars')} END AS changed FROM documents)),
t AS (SELECT k, 0 AS l, i, n, leaf AS h FROM d
  UNION ALL SELECT k, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY k, l, i // 2, n),
s AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS l, i, n, h FROM s UNION ALL SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY l, i // 2, n),
sib AS (SELECT d.doc_id, 0 AS part, t.l, t.h FROM d JOIN t ON t.k = d.k AND t.n > 1 AND t.i = xor(d.i >> t.l, 1)
  UNION ALL SELECT d.doc_id, 1, u.l, u.h FROM d JOIN s USING (k) JOIN u ON u.n > 1 AND u.i = xor(s.i >> u.l, 1)),
p AS (SELECT doc_id, string_agg(h, '' ORDER BY part, l) AS proof FROM sib GROUP BY doc_id),
f AS (SELECT doc_id, k, 0 AS l, i, n, changed AS h FROM d
  UNION ALL SELECT f.doc_id, f.k, f.l + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN t.h IS NULL THEN f.h WHEN f.i % 2 = 1 THEN t.h || f.h ELSE f.h || t.h END)
  FROM f LEFT JOIN t ON t.k = f.k AND t.l = f.l AND t.i = xor(f.i, 1) WHERE f.n > 1),
g AS (SELECT f.doc_id, 0 AS l, s.i, s.n, f.h FROM f JOIN s USING (k) WHERE f.n = 1
  UNION ALL SELECT g.doc_id, g.l + 1, g.i // 2, (g.n + 1) // 2, sha256(CASE WHEN u.h IS NULL THEN g.h WHEN g.i % 2 = 1 THEN u.h || g.h ELSE g.h || u.h END)
  FROM g LEFT JOIN u ON u.l = g.l AND u.i = xor(g.i, 1) WHERE g.n > 1)
SELECT d.doc_id, d.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, g.h AS folded_root, g.h = r.h AS verified
FROM d JOIN s USING (k) CROSS JOIN (SELECT h FROM u WHERE n = 1) r LEFT JOIN p USING (doc_id) JOIN g ON g.doc_id = d.doc_id AND g.n = 1
"""
