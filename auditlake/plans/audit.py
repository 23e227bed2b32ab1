"""Whole audits: a folder with a reader, and the business tables as invoices."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.images import thumbnail
from auditlake.functions.names import base_name
from auditlake.functions.pdf import page_count
from auditlake.functions.replies import decode_replies, decode_summaries
from auditlake.operators.checklist import checklist_heads, parse_checklist, rule_lines, with_rule
from auditlake.operators.extract import Calls, answered, measured
from auditlake.operators.rules import invoice_findings, text_audit
from auditlake.operators.scoring import applicable, both_verdicts, document_scores, report
from auditlake.shared import shared_path
from auditlake.sources.files import checklist_text, or_empty, require_folder, scan_folder, with_content

Reader = Callable[..., str]
#: What the summary of a file without content is.
NO_SUMMARY = '{"error": "unable to load content", "summary": "Unsupported or empty document.", "key_fields": {"error": "unable to load content"}}'
#: A result is that of a file as it was, under a checklist as it was.
KEYS = ("doc_key", "length", "modified", "digest")


class Audit(NamedTuple):
    report: DataFrame
    documents: DataFrame
    failed: DataFrame


class Checklist(NamedTuple):
    """A checklist file, which is a page of text: its name and version, its rules, and these as lines for a reader."""

    name: str
    version: str
    rules: DataFrame
    lines: str
    digest: str


def load_checklist(spark: SparkSession, path: str) -> Checklist:
    """No file is a checklist "Default", 1.0, without rules."""
    text = checklist_text(spark, path)
    texts = spark.createDataFrame([("file", text or "")], "checklist string, text string")
    rules = parse_checklist(texts)
    head = checklist_heads(texts).first()
    lines = rule_lines(rules).first()
    name, version = ("Default", "1.0") if text is None else (head.audit_name, head.version)
    return Checklist(name, version, rules, lines.rules if lines else "", hashlib.sha256((text or "").encode()).hexdigest())


def remembered(files: DataFrame, work: Callable[[DataFrame], DataFrame], store: str, digest: str) -> DataFrame:
    """The results of listed files; work is done on those that are new, changed or under another checklist.

    store is a folder that outlives a run.  Results are added to it; those of the same key are the same.
    """
    spark = files.sparkSession
    listed = files.withColumns({"doc_key": F.col("path"), "modified": F.col("modificationTime"), "digest": F.lit(digest)})
    known = or_empty(spark, lambda: spark.read.parquet(store), "doc_key string, length long, modified timestamp, digest string")
    work(listed.join(known.select(*KEYS), list(KEYS), "left_anti")).write.mode("append").parquet(store)
    return listed.select(*KEYS, "document_name", "media_type").join(spark.read.parquet(store).dropDuplicates(list(KEYS)), list(KEYS))


def run_audit(
    spark: SparkSession, folder: str, checklist: str, read: Reader, title: str | None = None, strict: bool = False, summarize: Reader | None = None,
    count_pages: Callable[[str, bytes | None], int] = page_count, picture: Callable[[bytes | None], str] = thumbnail, store: str | None = None, calls: Calls = Calls(), must_exist: bool = False,
) -> Audit:
    """Lists the folder, has every file counted, pictured, summarised and judged, decodes the replies, looks the failed rules up and reports.

    A file is opened once.  A reader with three places gets the checklist's rules as lines and the file's summary
    (extract.Brief).  Replies are kept in store, by default a new folder in the shared one; with a store that is
    given again, only new and changed files are read.  The verdict is the reader's own, with the one that its
    failed rules give beside it; what could not be read counts with score 0 and has a status.  Files that are
    empty or whose names start with a dot or an underscore are in strict runs only; empty ones are never read and
    have the status empty_content.  A folder that is not there is an empty run, or with must_exist an error.
    """
    if must_exist:
        require_folder(folder)
    rules = load_checklist(spark, checklist)

    def work(files: DataFrame) -> DataFrame:
        d = measured(with_content(files), count_pages, picture)
        more = []
        if summarize is not None:
            d = decode_summaries(answered(d, summarize, calls=calls, empty=NO_SUMMARY))
            d = d.withColumn("summary_status", F.when(F.col("length") == 0, "empty_content").otherwise(F.col("status"))).drop("status", "reply")
            more = ["document_type", "summary", "language", "metadata", "summary_status"]
        d = answered(d, read, calls=calls, rules=rules.lines, empty='{"error": "empty_content"}')
        return d.select(*KEYS, "reply", "page_count", "preview_base64", *more)

    files = scan_folder(spark, folder, strict, content=False)
    kept = remembered(files, work, store or shared_path(spark, "results"), rules.digest)
    results = decode_replies(kept, strict)
    results = results.withColumn("status", F.when(F.col("length") == 0, "empty_content").otherwise(F.col("status")))
    items = results.select("doc_key", F.posexplode("failed_rules").alias("pos", "x")).select("doc_key", "pos", "x.*")
    head = report(results, title).withColumns({"checklist_name": F.lit(rules.name), "checklist_version": F.lit(rules.version)})
    return Audit(head, both_verdicts(results, items, rules.rules), with_rule(items, rules.rules))


def timed_audit(spark: SparkSession, *args, **kwargs) -> tuple[Audit, DataFrame]:
    """An audit, and its response: the report's row with elapsed_seconds of reading the documents."""
    start = time.monotonic()
    audit = run_audit(spark, *args, **kwargs)
    return audit, audit.report.withColumn("elapsed_seconds", F.lit(round(time.monotonic() - start, 2)))


def invoice_audit(orders: DataFrame, lineitem: DataFrame, title: str | None = None) -> DataFrame:
    """The report of all orders as invoices."""
    return report(document_scores(invoice_findings(orders, lineitem)), title)


def whole_audit(docs: DataFrame, orders: DataFrame, lineitem: DataFrame, as_of: str, title: str | None = None) -> DataFrame:
    """The report of documents (doc_id, document_type, document_number, text) under all twelve rules.

    R003 is judged where doc_id is the key of an order with lines; each document is scored
    by the rules that apply to it.
    """
    amounts = invoice_findings(orders, lineitem).where("rule_id = 'R003'").join(docs.select(F.col("doc_id").alias("doc_key")).distinct(), "doc_key", "left_semi")
    return report(document_scores(applicable(text_audit(docs, as_of)).unionByName(amounts)), title)
