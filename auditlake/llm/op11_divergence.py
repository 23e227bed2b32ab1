"""Divergence of sources within a language: ranked terms of each source, and its distance to the others.

Terms are counted in tasks, by batches, then added up by Spark.  A language keeps the
terms that enough of its documents hold.  Probabilities are whole numbers, 1 to about
10^9; a term that a source lacks still has the source's baseline probability.

* The most telling terms of a group are found by radix selection: histograms over the
  next digits of (value descending, UTF-8 bytes) find the bin in which each group's kth
  row lies, and only rows of that bin go on, until the bin ends with the kth row.  Values
  come first, so ties alone are refined by bytes.
* The distance of two sources sums over all kept terms.  Each pair starts from the sum
  for two empty sources; a source's own terms correct that by a histogram of their
  counts, and only terms that both hold correct it pair by pair, added up in tasks.

Defined cases: null text, lang and source are empty texts, so a null source and an empty one
are one; every (lang, source) has rows for the other sources even without terms; a
language without kept terms has distances 0; repeated rows count each; an empty table
gives an empty result; a very long text is one step of its own; columns other than text,
lang and source are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import Words, documents, join_counted, positions, stored, text_steps

MIN_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
#: Bytes of text counted together, and rows of counts kept before they are sent.
STEP_BYTES, HELD_ROWS = 2 << 20, 1 << 18
#: Hexadecimal digits of one round of the selection.
DIGITS = 3
#: Sources of a language go in blocks of 2**BLOCK_BITS; so many pairs are worked on at once.
BLOCK_BITS, PAIRS = 8, 1 << 20
GROUP = ["lang", "source"]


def named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def step_counts(group: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, count, documents) of the documents of one step."""
    to = np.full(256, 32, np.uint8)
    to[128:] = np.arange(128, 256)
    to[97:123] = to[65:91] = np.arange(97, 123)
    words = Words(to[data], offsets)
    ends = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    terms = pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(words.data[words.data != 32])])
    coded = terms.dictionary_encode()
    size = len(coded.dictionary)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    pair, n = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)
    key, at = np.unique(group[pair // size] * size + pair % size, return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, at, n)
    return key // size, coded.dictionary.take(pa.array(key % size)).cast(pa.string()), count, np.bincount(at, minlength=len(key))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""
    def added(tables: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(tables).group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return out.select(["group", "term", "n_sum", "docs_sum"]).rename_columns(["group", "term", "n", "docs"])

    def run(batches):
        code: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []

        def sent(table: pa.Table):
            names = [pa.array([x[k] for x in code], pa.string()) for k in (0, 1)]
            for b in table.to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([*(x.take(b.column(0)) for x in names), *b.columns[1:]], [*GROUP, "term", "n", "docs"])

        for batch in batches:
            group = np.array([code.setdefault(x, len(code)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            for lo, hi, data, offsets in text_steps(batch.column(2), STEP_BYTES):
                g, term, n, docs = step_counts(group[lo:hi], data, offsets)
                held.append(pa.table({"group": pa.array(g.astype(np.int32)), "term": term, "n": pa.array(n), "docs": pa.array(docs)}))
                if len(held) > 1 and sum(map(len, held)) > HELD_ROWS:
                    held = [added(held)]
                    if len(held[0]) > HELD_ROWS // 2:
                        yield from sent(held.pop())
        if held:
            yield from sent(added(held))

    counted = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exactly."""
    return F.expr(f"1 + (CAST({count} + 2 AS DECIMAL(20,0)) * CAST({UNIT} AS DECIMAL(10,0))) div CAST({total} + 2 * {terms} AS DECIMAL(20,0))")


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of whole numbers."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def counted_groups(names: DataFrame, rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (lang, source) with total and held, of the source, and terms and lang_total, of the language."""
    own = rows.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    groups = stored(names.join(own, GROUP, "left").na.fill(0, ["total", "held"]), "groups")
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("_sources")).join(whole, "lang", "left").na.fill(0, ["terms", "lang_total"])
    return stored(join_counted(groups, stored(langs, "langs"), ["lang"], "_sources").drop("_sources"), "groups")


# ---------------------------------------------------------------- the first rows of each group


def selected(rows: DataFrame, k: int) -> DataFrame:
    """The k smallest keys (texts of hexadecimal digits, distinct in a group) of each (lang, source), or all if fewer.

    rows is a stored table with lang, source and key.
    """
    live, cuts, done = rows.select(*GROUP, "key"), None, 0
    state = None
    while True:
        done += DIGITS
        bins = live.groupBy(*GROUP, F.rpad("key", done, "0").alias("cut")).agg(F.count(F.lit(1)).alias("tied"))
        if state is not None:
            bins = bins.join(state, GROUP)
        else:
            bins = bins.withColumn("need", F.lit(k).cast("long"))
        group = Window.partitionBy(*GROUP)
        upto = F.sum("tied").over(group.orderBy("cut"))
        bins = bins.select(*GROUP, "cut", "tied", "need", upto.alias("upto"), F.sum("tied").over(group).alias("rows"))
        # the bin of the kth row; of groups with fewer rows the last bin
        at = bins.where((F.col("upto") >= F.least("need", "rows")) & (F.col("upto") - F.col("tied") < F.least("need", "rows")))
        at = stored(at.select(*GROUP, "cut", "tied", (F.least("need", "rows") - F.col("upto") + F.col("tied")).alias("need"), "rows"), "cuts")
        cuts = at if cuts is None else cuts.union(at)
        open_ = at.where("need < tied")
        if open_.isEmpty():
            break
        live = stored(join_counted(live, open_.select(*GROUP, "cut", "rows"), GROUP, "rows").where(F.rpad("key", done, "0") == F.col("cut")).select(*GROUP, "key"), "live")
        state = open_.select(*GROUP, "need")
    last = cuts.groupBy(*GROUP).agg(F.max_by("cut", F.length("cut")).alias("cut"), F.max("rows").alias("rows"))
    return join_counted(rows, stored(last, "cuts"), GROUP, "rows").where(F.rpad("key", F.length("cut"), F.lit("0")) <= F.col("cut")).drop("cut", "rows")


def telling_terms(rows: DataFrame, k: int) -> DataFrame:
    """The k terms of each source that most exceed the language's; rows: lang, source, term, p, q."""
    value = distance(F.col("p"), F.col("q"))
    key = F.concat(F.lpad(F.lower(F.hex(F.lit((1 << 32) - 1) - F.col("value"))), 8, "0"), F.lower(F.hex(F.encode("item", "utf-8"))))
    found = rows.where("p > q").select(*GROUP, F.col("term").alias("item"), "q", value.alias("value")).withColumn("key", key)
    top = selected(stored(found, "terms"), k)
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy("key"))  # at most k rows
    return top.select(*GROUP, F.lit("term").alias("part"), "item", "q", "value", rank.alias("rank"))


# ---------------------------------------------------------------- pairs of sources


def shared_terms(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value): of sources at a < b, what terms that both hold add to their distance.

    rows: lang, term, at, n_sources, p and base of each held term.  Sources of a language go
    in blocks; each pair of blocks gets the rows of both, dealt by term, and sums in tasks.
    """
    blocks = F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n_sources") - 1, BLOCK_BITS))
    own = F.shiftright("at", BLOCK_BITS)
    dealt = rows.select("lang", "term", "at", "p", "base", F.explode(F.transform(blocks, lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))).alias("x"))
    dealt = dealt.select("lang", "x.i", "x.j", F.xxhash64("term").alias("bucket"), "term", "at", "p", "base")
    dealt = dealt.repartition("lang", "i", "j", "bucket").sortWithinPartitions("lang", "i", "j", "term", "at").drop("bucket")
    side = 1 << BLOCK_BITS

    def added(total: np.ndarray, i: int, j: int, sizes: np.ndarray, at: np.ndarray, p: np.ndarray, base: np.ndarray) -> None:
        """Adds up all pairs of the entries of each of some terms that lie side by side."""
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(np.arange(len(at)), np.repeat(sizes, sizes))
        within = np.arange(len(left)) - np.repeat(np.cumsum(np.repeat(sizes, sizes)) - np.repeat(sizes, sizes), np.repeat(sizes, sizes))
        right = first[left] + within
        fits = (at[left] >> BLOCK_BITS == i) & (at[right] >> BLOCK_BITS == j) & (at[left] < at[right])
        left, right = left[fits], right[fits]
        f = lambda x, y: (x - y) ** 2 // (x + y)
        more = f(p[left], p[right]) - f(p[left], base[right]) - f(base[left], p[right]) + f(base[left], base[right])
        np.add.at(total, (at[left] - i * side, at[right] - j * side), more)

    def sums(key, total):
        lang, i, j = key
        a, b = np.nonzero(total)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a + i * side, pa.int64()), pa.array(b + j * side, pa.int64()), pa.array(total[a, b])], ["lang", "a", "b", "value"])

    def run(batches):
        key, total, rest = None, None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            # a term whose entries may go on in the next batch waits
            key, total, rest, out = advanced(key, total, rest, False)
            yield from out
        if rest is not None:
            key, total, rest, out = advanced(key, total, rest, True)
            yield from out
        if total is not None:
            yield sums(key, total)

    def advanced(key, total, rest, end):
        out = []
        columns = {c: rest[c].combine_chunks() for c in rest.column_names}
        names = list(zip(columns["lang"].to_pylist(), columns["i"].to_pylist(), columns["j"].to_pylist(), columns["term"].to_pylist(), strict=True))
        starts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
        ends = [*starts[1:], len(names)]
        if not end:
            starts, ends = starts[:-1], ends[:-1]
        at, p, base = (columns[c].to_numpy() for c in ("at", "p", "base"))
        k = 0
        while k < len(starts):
            if names[starts[k]][:3] != key:
                if total is not None:
                    out.append(sums(key, total))
                key, total = names[starts[k]][:3], np.zeros((side, side), np.int64)
            m, pairs = k, 0
            while m < len(starts) and names[starts[m]][:3] == key and (m == k or pairs + (ends[m] - starts[m]) ** 2 <= PAIRS):
                pairs += (ends[m] - starts[m]) ** 2
                m += 1
            lo, hi = starts[k], ends[m - 1]
            added(total, key[1], key[2], np.array(ends[k:m]) - np.array(starts[k:m]), at[lo:hi], p[lo:hi], base[lo:hi])
            k = m
        return key, total, rest.slice(ends[-1] if ends else 0), out

    return dealt.mapInArrow(run, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_distances(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Every pair of sources of a language, ranked; groups: lang, source, total, terms, held; rows: lang, source, term, n."""
    base = F.when(F.col("terms") > 0, probability("0", "total", "if(terms > 0, terms, 1)")).otherwise(F.lit(1)).cast("long")
    placed = stored(positions(groups, ["lang"], ["source"]).withColumnRenamed("n", "n_sources").withColumn("base", base), "sources")
    held = stored(join_counted(rows, placed.where("held > 0").select(*GROUP, "at", "n_sources", "total", "terms", "base", "held"), GROUP, "held").withColumn("p", probability("n", "total", "terms")).drop("held", "total", "terms"), "held")
    # a source has few different counts, at most about the root of twice its total
    bars = held.groupBy(*GROUP, "p").agg(F.count(F.lit(1)).alias("m")).groupBy(*GROUP).agg(F.collect_list(F.struct("p", "m")).alias("bars"))
    one = placed.select(*GROUP, "at", "n_sources", "terms", "base").join(bars, GROUP, "left")
    # each language's pairs are dealt by blocks of the second source
    a = one.select("lang", *[F.col(c).alias(f"a_{c}") for c in ("source", "at", "base", "bars")], "terms", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n_sources") - 1, BLOCK_BITS))).alias("block"))
    b = one.select("lang", *[F.col(c).alias(f"b_{c}") for c in ("source", "at", "base", "bars")], F.shiftright("at", BLOCK_BITS).alias("block"))
    pairs = a.join(b, ["lang", "block"]).where("a_at < b_at")
    empty = distance(F.col("a_base"), F.col("b_base"))
    alone = lambda bars, other: F.coalesce(F.aggregate(bars, F.lit(0).cast("long"), lambda x, y: x + y["m"] * (distance(y["p"], other) - empty)), F.lit(0))
    pairs = pairs.withColumn("sparse", F.col("terms") * empty + alone(F.col("a_bars"), F.col("b_base")) + alone(F.col("b_bars"), F.col("a_base")))
    both = shared_terms(held.select("lang", "term", "at", "n_sources", "p", "base"))
    pairs = pairs.select("lang", F.col("a_at").alias("a"), F.col("b_at").alias("b"), "a_source", "b_source", "sparse").join(both, ["lang", "a", "b"], "left")
    value = (F.col("sparse") + F.coalesce("value", F.lit(0))).alias("value")
    ways = F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item"))))
    out = stored(pairs.select("lang", value, ways.alias("x")).select("lang", "x.source", "x.item", "value"), "distances")
    return positions(out, GROUP, [F.col("value").desc(), "item"]).select(*GROUP, F.lit("pair").alias("part"), "item", "value", (F.col("at") + 1).cast("int").alias("rank"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank of every source's distances and telling terms."""
    d = named(docs)
    counts = stored(term_counts(d), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("_held")).where(F.col("docs") >= min_docs)
    kept = stored(kept.drop("docs"), "kept")
    rows = stored(join_counted(counts.drop("docs"), kept, ["lang", "term"], "_held").drop("_held"), "rows")
    groups = counted_groups(d.select(*GROUP).distinct(), rows, kept)
    known = join_counted(rows, groups.where("held > 0"), GROUP, "held")
    known = known.select(*GROUP, "term", probability("n", "total", "terms").alias("p"), probability("lang_n", "lang_total", "terms").alias("q"))
    return telling_terms(known, top).drop("q").unionByName(source_distances(groups, rows.select(*GROUP, "term", "n")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir, "text", "lang", "source"))


P = "1 + {0} * ({{0}}::HUGEINT + 2) // ({{1}} + 2 * v)".format(UNIT).format
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
n AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(c) AS n FROM kept GROUP BY lang),
s AS (SELECT DISTINCT lang, source FROM d),
g AS (SELECT s.lang, s.source, coalesce(sum(c), 0) AS n FROM s LEFT JOIN n ON n.lang = s.lang AND n.source = s.source GROUP BY s.lang, s.source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n.c, 0) AS c, {P('coalesce(n.c, 0)', 'g.n')} AS p, {P('kept.c', 'l.n')} AS q
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
t AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((pa.p - pb.p) * (pa.p - pb.p) // (pa.p + pb.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p pa ON pa.lang = a.lang AND pa.source = a.source
  LEFT JOIN p pb ON pb.lang = b.lang AND pb.source = b.source AND pb.term = pa.term GROUP BY a.lang, a.source, b.source)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM t UNION ALL FROM x)) WHERE part = 'pair' OR rank <= {TOP}
"""
