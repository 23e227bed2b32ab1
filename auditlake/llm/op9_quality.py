"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules judge a document alone (word count, words in repeated 8-word windows).
The method then hashes every normalised line, counts the distinct documents of each
host that hold it, removes lines above the host's limit and rejects documents of
which too little is left.  A document's host is its ``source``.  Lines and hosts that very
many rows have are joined where these lie.

Defined cases: null or empty text has no words and fails the base rules; a null
source is a host of its own; repeated rows each get their own result, and equal
texts count once, as "documents" of a line and of a host, so that copies of a good
page neither turn its own lines into boilerplate nor hide a host's boilerplate; an
empty table gives an empty result; columns other than doc_id, text and source are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import SEPARATORS, documents, join_counted, stored

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A line is boilerplate if more than this share of the host's documents hold it, and at least so many.
LINE_SHARE, LINE_DOCS = 0.02, 10
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Computes the columns once; without this, projections that use them are merged and compute them again."""
    at = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return df.select("*", at.alias("_held")).select(*df.columns, *[F.col(f"_held.{k}").alias(k) for k in columns])


def repeated_words(grams: Column, places: Column) -> Column:
    """places: (hash, place) sorted.  Words covered by windows whose hash has a neighbour."""
    again = F.filter(places, lambda x, k: ((k > 0) & (F.get(places, k - 1)["h"] == x["h"])) | (F.coalesce(F.get(places, k + 1)["h"] == x["h"], F.lit(False))))
    return F.sort_array(F.transform(again, lambda x: x["i"]))


def features(docs: DataFrame) -> DataFrame:
    """One row per document: the base figures, and its lines as (hash, words)."""
    d = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    d = held(d, words=words_of(F.col("text")), lines=F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("words")
    grams = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    plain = F.transform("lines", lambda x: F.struct(F.lower(F.trim(F.regexp_replace(x, SEPARATORS, " "))).alias("t")))
    d = held(d, grams=grams, plain=plain)
    again = F.size(F.array_distinct("grams")) < F.size("grams")
    d = held(d, places=F.when(again, F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = held(d, at=repeated_words(F.col("grams"), F.col("places")))
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    hashed = F.transform("plain", lambda x: F.struct(F.xxhash64(x["t"]).alias("h"), F.size(F.split(x["t"], " ")).alias("w")))
    return d.select(
        "doc_id",
        "host",
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.xxhash64("text").alias("content"),
        hashed.alias("hashed"),
        F.monotonically_increasing_id().alias("row"),
    )


def boilerplate(rows: DataFrame) -> DataFrame:
    """(host, h) of the lines above their host's limit, and how often they occur; rows is the stored table of features()."""
    lines = rows.select("host", "content", F.explode(F.transform("hashed", lambda x: x["h"])).alias("h"))
    # equal texts first become one; both steps combine before their shuffle, so a common line is no hot key
    counted = lines.groupBy("host", "content", "h").agg(F.count(F.lit(1)).alias("uses")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("uses").alias("uses"))
    counted = stored(counted.where(F.col("n") >= LINE_DOCS), "lines")
    per_host = rows.groupBy("host").agg(F.count_distinct("content").alias("docs")).join(counted.groupBy("host").agg(F.count(F.lit(1)).alias("lines")), "host")
    above = join_counted(counted, stored(per_host, "hosts"), ["host"], "lines")
    return above.where(F.col("n") > F.col("docs") * F.lit(LINE_SHARE)).select("host", "h", "uses")


def removed_lines(rows: DataFrame) -> DataFrame:
    """(row, w), the row and words of every line that is boilerplate; rows is the stored table of features()."""
    lines = rows.select("row", "host", F.explode("hashed").alias("x")).select("row", "host", "x.h", "x.w")
    return join_counted(lines, stored(boilerplate(rows), "boilerplate"), ["host", "h"], "uses").select("row", "w")


def quality(docs: DataFrame) -> DataFrame:
    rows = stored(features(docs), "quality")
    removed = removed_lines(rows).groupBy("row").agg(F.sum("w").alias("removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    return rows.join(removed, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (left >= F.col("n_words") * F.lit(LEFT_SHARE))).alias("kept"),
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed_words"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir, "doc_id", "text", "source"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, 'null') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS t
      FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) > {WINDOW})),
again AS (SELECT r, i, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {WINDOW}) AS gap
          FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, sum(least({WINDOW}, gap)) AS n FROM again GROUP BY r),
l AS (SELECT r, host, text, t, len(string_split(t, ' ')) AS k
      FROM (SELECT r, host, text, lower(trim(regexp_replace(unnest(lines), '[ \t-\r]+', ' ', 'g'))) AS t FROM w)),
per AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
b AS (SELECT host, t FROM (SELECT host, t, count(DISTINCT text) AS n FROM l GROUP BY host, t)
      JOIN per USING (host) WHERE n >= {LINE_DOCS} AND n > docs * CAST({LINE_SHARE} AS DOUBLE)),
x AS (SELECT r, sum(k) AS n FROM l JOIN b USING (host, t) GROUP BY r),
f AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ \t-\r]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN rep USING (r) LEFT JOIN x USING (r)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_removed_words >= n_words * CAST({LEFT_SHARE} AS DOUBLE) AS kept, n_removed_words
FROM v
"""
