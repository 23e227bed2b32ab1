"""Decoding of model replies: fenced JSON text into typed columns with a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW = "passed string, score string, failed_rules array<string>, remarks string, error string, _bad string"
ITEM = "rule_id string, evidence string, page_number string"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def unfenced(reply: Column) -> Column:
    """The reply without a fence of back-ticks and the word json after it."""
    text = strip(F.coalesce(reply, F.lit("")))
    inner = strip(F.regexp_replace(text, "^`+|`+$", ""))
    return F.when(text.startswith("```"), F.when(inner.startswith("json"), strip(F.substring(inner, 5, 1 << 30))).otherwise(inner)).otherwise(text)


def one_object(text: Column) -> Column:
    """Whether a text is one JSON object and no more; from_json itself ignores what follows a closed object."""
    items = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    return text.startswith("{") & text.endswith("}") & (F.coalesce(F.size(items), F.lit(0)) == 1)


def decode_replies(replies: DataFrame, strict: bool = False) -> DataFrame:
    """Adds status, passed, score, remarks and failed_rules to rows with a reply.

    Nothing ends the run: what cannot be read gets its default and a status.  With
    strict, truth is that of any non-empty value and null remarks read "None".
    """
    d = replies.withColumn("_text", unfenced(F.col("reply")))
    d = d.withColumn("_raw", F.from_json("_text", RAW, {"columnNameOfCorruptRecord": "_bad"}))
    # of texts with NaN, which only from_json reads, the keys are looked for in the text
    has = lambda key: F.coalesce(F.array_contains(F.json_object_keys("_text"), key), F.col("_text").rlike(f'"{key}"\\s*:'), F.lit(False))
    whole = one_object(F.col("_text"))
    null_rules = has("failed_rules") & F.get_json_object("_text", "$.failed_rules").isNull()
    readable = whole & F.col("_raw").isNotNull() & F.col("_raw._bad").isNull() & ~null_rules
    ok = lambda c: F.when(readable, F.col(f"_raw.{c}"))
    score = F.expr("try_cast(_raw.score AS double)")
    good_score = F.coalesce(~F.isnan(score) & score.between(0, 100), F.lit(False)) | ~has("score")
    items = F.transform(F.filter(ok("failed_rules"), lambda x: x.startswith("{")), lambda x: F.from_json(x, ITEM))
    page = lambda x: F.when(F.lower(x) == "true", F.lit(1.0)).otherwise(x.try_cast("double"))
    good_page = lambda x: x.isNull() | F.coalesce(page(x) == F.floor(page(x)), F.lit(False))
    pages_fit = F.coalesce(F.forall(items, lambda x: good_page(x["page_number"])), F.lit(True))
    status = (
        F.when(~readable, "parse_error")
        .when(F.col("_raw.error").isNotNull(), "api_error")
        .when(~good_score, "invalid_score")
        .when(~pages_fit, "invalid_page")
        .otherwise("ok")
    )
    passed = F.when(ok("passed").isNull(), False)
    passed = passed.otherwise(~ok("passed").isin("", "false", "0", "0.0", "[]", "{}")) if strict else passed.otherwise(F.lower(ok("passed")).isin("true", "1"))
    if strict:
        passed = F.when(ok("passed") == "false", F.col("_text").rlike(r'"passed"\s*:\s*"')).otherwise(passed)
    none = F.when(readable & has("remarks") & F.col("_raw.remarks").isNull(), "None").otherwise("") if strict else F.lit("")
    typed = F.transform(
        items,
        lambda x: F.struct(F.coalesce(x["rule_id"], F.lit("unknown")).alias("rule_id"), F.coalesce(x["evidence"], F.lit("")).alias("evidence"), F.when(good_page(x["page_number"]), page(x["page_number"]).cast("int")).alias("page_number")),
    )
    empty = F.array().cast("array<struct<rule_id:string,evidence:string,page_number:int>>")
    return d.withColumns(
        {
            "status": status,
            "passed": passed,
            "score": F.when(readable & good_score, F.coalesce(score, F.lit(0.0))).otherwise(0.0),
            "remarks": F.coalesce(ok("remarks"), none),
            "failed_rules": F.coalesce(typed, empty),
        }
    ).drop("_text", "_raw")


SUMMARY_RAW = "document_type string, summary string, language string, key_fields map<string,string>, error string, _bad string"


def decode_summaries(replies: DataFrame) -> DataFrame:
    """Rows (path, media_type, reply) to document summaries: type, summary, language and metadata.

    metadata holds path and media type, then every key field of the reply that is not
    null, which may replace them; an unreadable reply leaves the defaults.
    """
    d = replies.withColumn("_text", unfenced(F.col("reply")))
    d = d.withColumn("_raw", F.from_json("_text", SUMMARY_RAW, {"columnNameOfCorruptRecord": "_bad"}))
    readable = one_object(F.col("_text")) & F.col("_raw").isNotNull() & F.col("_raw._bad").isNull()
    ok = lambda c: F.when(readable, F.col(f"_raw.{c}"))
    file = F.array(F.struct(F.lit("path").alias("key"), F.col("path").alias("value")), F.struct(F.lit("mime_type").alias("key"), F.col("media_type").alias("value")))
    fields = F.coalesce(F.filter(F.map_entries(ok("key_fields")), lambda e: e["value"].isNotNull()), F.array().cast("array<struct<key:string,value:string>>"))
    kept = F.filter(file, lambda e: ~F.exists(fields, lambda f: f["key"] == e["key"]))
    return d.withColumns(
        {
            "document_type": F.coalesce(ok("document_type"), F.lit("unknown")),
            "summary": F.coalesce(ok("summary"), F.lit("")),
            "language": F.coalesce(ok("language"), F.lit("unknown")),
            "metadata": F.map_from_entries(F.concat(kept, fields)),
            "status": F.when(~readable, "parse_error").when(F.col("_raw.error").isNotNull(), "api_error").otherwise("ok"),
        }
    ).drop("_text", "_raw")


def with_summaries(documents: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every document (doc_key) with its summary (doc_key, document_type, summary), paired by path; a stub where there is none."""
    s = summaries.select("doc_key", F.col("document_type").alias("_type"), F.col("summary").alias("_summary"))
    return documents.join(s, "doc_key", "left").select(*documents.columns, F.coalesce("_type", F.lit("unknown")).alias("document_type"), F.coalesce("_summary", F.lit("")).alias("summary"))
