"""A Markdown checklist as rows of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.schemas import SEVERITIES


def strip(c: Column) -> Column:
    """Trims any white space, not spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def field(text: Column, name: str, pattern: str = r"([^\n]+)") -> Column:
    """What follows a bold label, null if there is none."""
    return F.nullif(strip(F.regexp_extract(text, rf"(?s)\*\*{name}:\*\*\s*{pattern}", 1)), F.lit(""))


def parse_checklist(texts: DataFrame) -> DataFrame:
    """One row per rule of each text (columns: checklist, text), in file order.

    Blocks without a rule id are skipped; a severity outside the vocabulary is kept as
    read and marked in `valid` instead of ending the run.
    """
    t = texts.withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))
    head = t.select(
        "checklist",
        F.coalesce(field(F.col("text"), "Audit Name"), F.lit("Untitled Checklist")).alias("audit_name"),
        F.coalesce(field(F.col("text"), "Version"), F.lit("1.0")).alias("version"),
        F.posexplode(F.split("text", r"\n###\s+")).alias("ord", "block"),
    ).where("ord > 0")
    block = F.col("block")
    rule = F.regexp_extract(strip(block), r"^(R\d+):\s*([^\n]+)", 1)
    title = strip(F.regexp_extract(strip(block), r"^(R\d+):\s*([^\n]+)", 2))
    severity = F.lower(F.coalesce(field(block, "Severity", r"(\S+)"), F.lit("medium")))
    mandatory = F.coalesce(F.lower(field(block, "Mandatory", r"(\S+)")) == "true", F.lit(False))
    rows = head.select("checklist", "audit_name", "version", "ord", rule.alias("rule_id"), title.alias("title"), F.coalesce(field(block, "Description", "(.+)"), F.lit("")).alias("description"), severity.alias("severity"), mandatory.alias("mandatory"))
    return rows.where("rule_id <> ''").withColumn("valid", F.col("severity").isin(*SEVERITIES))


def checklist_heads(texts: DataFrame) -> DataFrame:
    """(checklist, audit_name, version) of each text, whether it has rules or not."""
    t = texts.withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))
    return t.select("checklist", F.coalesce(field(F.col("text"), "Audit Name"), F.lit("Untitled Checklist")).alias("audit_name"), F.coalesce(field(F.col("text"), "Version"), F.lit("1.0")).alias("version"))


def first_rules(rules: DataFrame) -> DataFrame:
    """One row per rule id: the first in file order."""
    best = F.min_by(F.struct("title", "description", "severity", "mandatory"), "ord")
    return rules.groupBy("rule_id").agg(best.alias("r")).select("rule_id", "r.*")


def with_rule(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Reported items (rule_id, evidence, page_number, ...) with title, description and severity of the checklist.

    A checklist is a page of text, so its rules are broadcast.
    """
    known = F.broadcast(first_rules(rules).select(F.col("rule_id").alias("_id"), F.col("title").alias("_title"), F.col("description").alias("_description"), F.col("severity").alias("_severity")))
    rule_id = F.coalesce("rule_id", F.lit("unknown"))
    joined = items.withColumn("rule_id", rule_id).join(known, F.col("rule_id") == F.col("_id"), "left")
    severity = F.when(F.col("_severity").isin(*SEVERITIES), F.col("_severity")).otherwise("medium")
    return joined.withColumns({"rule_title": F.coalesce("_title", "rule_id"), "description": F.coalesce("_description", F.lit("")), "severity": severity}).drop("_id", "_title", "_description", "_severity")


def severity_rank(c: Column) -> Column:
    """1 for the most severe; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), c), F.lit(0)), F.lit(len(SEVERITIES) + 1))


def by_severity(items: Column) -> Column:
    """An array of failed items in order of severity, keeping the order of equals."""
    keyed = F.transform(items, lambda x, i: F.struct(severity_rank(x["severity"]).alias("rank"), i.alias("at"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def rule_lines(rules: DataFrame) -> DataFrame:
    """(checklist, rules): the rules of each checklist as lines for a model, in file order; a checklist is a page of text."""
    line = F.format_string("- [%s] %s (%s, %s): %s", "rule_id", "title", "severity", F.when(F.col("mandatory"), "mandatory").otherwise("optional"), "description")
    lines = F.sort_array(F.collect_list(F.struct("ord", line.alias("line"))))
    return rules.groupBy("checklist").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("rules"))
