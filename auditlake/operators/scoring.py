"""From findings to document scores, and from those to the report of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.rounding import round_exact
from auditlake.functions.sums import mean_and_deviation, pieces
from auditlake.schemas import FAIL, PASS, PASS_FROM, REVIEW, REVIEW_FROM, SINGLE_MARGIN, Z_95


def document_scores(findings: DataFrame, key: str = "doc_key") -> DataFrame:
    """Findings (key, rule_id, mandatory, complies) to passed and score, all rules of equal weight."""
    return findings.groupBy(key).agg(
        F.bool_and(F.col("complies") | ~F.col("mandatory")).alias("passed"),
        (F.count_if("complies").cast("double") * 100 / F.count(F.lit(1)).cast("double")).alias("score"),
    )


def applicable(findings: DataFrame) -> DataFrame:
    """Findings of the rules that apply to their document."""
    return findings.where("applies").drop("applies")


def both_verdicts(results: DataFrame, items: DataFrame, rules: DataFrame, key: str = "doc_key") -> DataFrame:
    """results with passed as reported, and passed_computed: no failed item is of a mandatory rule.

    Rules that the checklist does not know count as mandatory; so does a result that could
    not be read, which has not passed.  A checklist is a page of text, so it is broadcast.
    """
    known = F.broadcast(rules.groupBy("rule_id").agg(F.min_by("mandatory", "ord").alias("must")))
    failed = items.select(key, "rule_id").join(known, "rule_id", "left").where(F.coalesce("must", F.lit(True))).select(key).distinct().withColumn("_failed", F.lit(True))
    computed = F.col("_failed").isNull() & (F.col("status") == "ok")
    return results.join(failed, key, "left").withColumn("passed_computed", computed).drop("_failed")


def classified(mean: Column) -> Column:
    """By the mean before it is rounded."""
    return F.when(mean >= PASS_FROM, PASS).when(mean >= REVIEW_FROM, REVIEW).otherwise(FAIL)


def report(results: DataFrame, title: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each value of `by`): counts, overall score, result, interval and summary.

    results: passed, score; rows with a null score only keep an empty run in a grouping.
    The order of the rows has no part in it, unless a score is not from 0 to 100.
    """
    n = F.count("score")
    parts = ("_a", "_b", "_c")
    mean, deviation = mean_and_deviation(*map(F.col, parts))
    plain = F.count("_a") == n
    cut = results.select(*by, "passed", "score", *[p.alias(c) for p, c in zip(pieces(F.col("score")), parts, strict=True)])
    got = cut.groupBy(*by).agg(
        n.alias("documents_processed"),
        F.count_if(F.col("passed") & F.col("score").isNotNull()).alias("documents_passed"),
        F.when(plain, mean).otherwise(F.avg("score")).alias("_mean"),
        F.when(plain, deviation).otherwise(F.stddev_samp("score")).alias("_deviation"),
    )
    return summarised(got, title, by)


def moments(results: DataFrame, by: tuple[str, ...], sign: Column) -> DataFrame:
    """Count, passed, mean and squared deviation of results that come (sign 1) or go (-1), by run and sign."""
    return results.groupBy(*by, sign.alias("sign")).agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("ok"), F.avg("score").alias("mean"), (F.var_pop("score") * F.count(F.lit(1))).alias("m2"))


def merged(parts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The moments of all parts together, less those with sign -1."""
    n = F.sum(F.col("sign") * F.col("n"))
    total = F.sum(F.col("sign") * F.col("n") * F.col("mean"))
    squares = F.sum(F.col("sign") * (F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")))
    mean = F.when(n > 0, total / n).otherwise(0.0)
    return parts.groupBy(*by).agg(F.lit(1).alias("sign"), n.alias("n"), F.sum(F.col("sign") * F.col("ok")).alias("ok"), mean.alias("mean"), F.greatest(F.lit(0.0), squares - n * mean * mean).alias("m2"))


def report_of_moments(kept: DataFrame, title: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The report that the results behind the moments have."""
    n = F.col("n")
    deviation = F.when(n > 1, F.sqrt(F.col("m2") / (n - 1)))
    return summarised(kept.select(*by, n.alias("documents_processed"), F.col("ok").alias("documents_passed"), F.when(n > 0, F.col("mean")).alias("_mean"), deviation.alias("_deviation")), title, by)


def summarised(got: DataFrame, title: str | None, by: tuple[str, ...]) -> DataFrame:
    """The report from counts, mean and deviation."""
    mean = F.coalesce("_mean", F.lit(100.0))
    count = F.col("documents_processed")
    margin = F.when(count == 0, 0.0).when(count == 1, SINGLE_MARGIN).otherwise(F.lit(Z_95) * F.col("_deviation") / F.sqrt(count.cast("double")))
    got = got.withColumns({"documents_failed": count - F.col("documents_passed"), "overall_score": round_exact(mean, 2), "overall_result": classified(mean), "_margin": margin})
    name = F.coalesce(F.nullif(F.lit(title).cast("string"), F.lit("")), F.lit("Untitled Audit"))
    summary = F.concat(count.cast("string"), F.lit(" documents checked, "), F.col("documents_passed").cast("string"), F.lit(" passed, result "), F.col("overall_result"), F.lit("."))
    return got.select(
        *by, name.alias("audit_title"), "documents_processed", "documents_passed", "documents_failed", "overall_score", "overall_result",
        round_exact(F.greatest(F.lit(0.0), F.col("overall_score") - F.col("_margin")), 2).alias("lower"),
        round_exact(F.least(F.lit(100.0), F.col("overall_score") + F.col("_margin")), 2).alias("upper"),
        summary.alias("summary"),
    )
