"""Rows of a written report, and the report as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.rounding import shown
from auditlake.shared import positions, stored

LABELS = {"PASS": "PASSED", "FAIL": "FAILED"}


def with_page(evidence: Column, page: Column) -> Column:
    return F.when(page.isNull(), evidence).otherwise(F.concat(evidence, F.lit(" (p. "), page.cast("string"), F.lit(")")))


def result_label(result: Column) -> Column:
    out = result
    for value, label in LABELS.items():
        out = F.when(result == value, label).otherwise(out)
    return out


def numbered(results: DataFrame, run: str = "run_id", by: str = "doc_key") -> DataFrame:
    """Documents of each run numbered from 1 in order of their path; a null run is one of its own.

    Places come from a sort over ranges, so a run may be of any size.
    """
    rows = stored(results.withColumn("_run", F.coalesce(F.concat(F.lit("="), F.col(run).cast("string")), F.lit(""))), "numbered")
    return positions(rows, ["_run"], [by]).withColumn("no", (F.col("at") + 1).cast("int")).select(*results.columns, "no")


def report_rows(items: DataFrame) -> DataFrame:
    """One row per failed item (doc_key, pos, rule_id, rule_title, severity, evidence, page_number), as written."""
    return items.select("doc_key", "pos", F.concat_ws(": ", "rule_id", "rule_title").alias("rule"), F.upper("severity").alias("severity"), with_page(F.col("evidence"), F.col("page_number")).alias("evidence"))


def as_json(report: DataFrame, results: DataFrame) -> DataFrame:
    """(json) of a report of one row with its documents, for a run that fits in a row; json_lines has no such bound."""
    docs = results.agg(F.sort_array(F.collect_list(F.struct("document_name", "passed", "score", *[c for c in ("failed_rules", "remarks") if c in results.columns]))).alias("document_results"))
    return report.crossJoin(docs).select(F.to_json(response(report, F.col("document_results"))).alias("json"))


def response(report: DataFrame, documents: Column | None = None) -> Column:
    """The report's columns as the fields of a response."""
    inside = [c for c in report.columns if c not in ("lower", "upper", "elapsed_seconds")]
    more = [F.col("elapsed_seconds")] if "elapsed_seconds" in report.columns else []
    docs = [documents.alias("document_results")] if documents is not None else []
    return F.struct(F.struct(*inside, *docs).alias("report"), F.struct("lower", "upper").alias("prediction_interval"), *more)


def json_lines(report: DataFrame, results: DataFrame, by: str = "doc_key") -> DataFrame:
    """(line, value): the lines of one JSON response, a line for each document in order of its path.

    report has one row.  write_json puts them in files that, one after the other, are the response.
    """
    shown = [c for c in ("document_name", "passed", "score", "failed_rules", "remarks", "preview_base64") if c in results.columns]
    docs = numbered(results.select(F.lit("run").alias("run_id"), by, F.to_json(F.struct(*shown)).alias("value")), "run_id", by)
    lines = docs.select(F.col("no").cast("long").alias("line"), F.concat(F.when(F.col("no") > 1, ",").otherwise(""), F.col("value")).alias("value"))
    whole = F.to_json(response(report, F.array().cast("array<string>")))
    cut = F.lit('"document_results":[')
    ends = report.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("line"), F.concat(F.substring_index(whole, '"document_results":[', 1), cut).alias("value")), F.struct(F.lit((1 << 62)).alias("line"), F.substring_index(whole, '"document_results":[', -1).alias("value")))).alias("x"))
    return lines.unionByName(ends.select("x.line", "x.value"))


def write_json(lines: DataFrame, folder: str) -> None:
    """Text files whose names are in the order of the lines."""
    stored(lines, "json").repartitionByRange("line").sortWithinPartitions("line").select("value").write.text(folder)


def label_agreement(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How often the verdict (doc_id, complies) goes with a quality label."""
    return docs.join(labels, "doc_id").groupBy("quality", "complies").agg(F.count(F.lit(1)).alias("documents"))


def displayed(reports: DataFrame) -> DataFrame:
    """What a reader sees of each report: label, score and interval to one decimal, counts in words."""
    n = F.col("documents_processed")
    counted = F.concat(n.cast("string"), F.when(n == 1, " document").otherwise(" documents"))
    one = lambda c: shown(F.col(c), 1)
    return reports.withColumns({"label": result_label(F.col("overall_result")), "shown_score": one("overall_score"), "shown_interval": F.concat(one("lower"), F.lit(" - "), one("upper")), "counted": counted})


def trace(items: DataFrame, length: int = 120) -> DataFrame:
    """Log lines of failed items; long evidence is cut."""
    return items.select("doc_key", "pos", F.concat(F.lit("["), F.col("rule_id"), F.lit("] "), F.substring("evidence", 1, length)).alias("line"))
