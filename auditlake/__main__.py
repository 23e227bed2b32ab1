"""python -m auditlake FOLDER --rules FILE --reader module:function: audits a folder and prints the report as JSON."""

from __future__ import annotations

import argparse
import json
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from auditlake.operators.report import as_json, json_lines, write_json
from auditlake.plans.audit import timed_audit
from auditlake.sources.docx import report_parts, write_reports


def named(where: str):
    """The function at module:name; a reader is what a run cannot do without."""
    module, _, name = where.partition(":")
    if not name:
        raise SystemExit(f"{where!r} is not a module:function")
    return getattr(import_module(module), name)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="auditlake", description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("--rules", required=True, help="the checklist, a Markdown file")
    parser.add_argument("--reader", required=True, help="module:function from (path, content) or (path, content, brief) to a reply")
    parser.add_argument("--summarizer", help="module:function from (path, content) to a summary")
    parser.add_argument("--title")
    parser.add_argument("--store", help="a folder that keeps results, so that only new and changed files are read")
    parser.add_argument("--docx", help="a folder for the written report")
    parser.add_argument("--json", help="a folder for the whole response as lines")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("auditlake").getOrCreate()
    audit, response = timed_audit(spark, given.folder, given.rules, named(given.reader), given.title, summarize=named(given.summarizer) if given.summarizer else None, store=given.store, must_exist=True)
    if given.docx:
        run = F.lit("report").alias("run_id")
        write_reports(report_parts(response.select(run, "*"), audit.documents.select(run, "*"), audit.failed.select(run, "*")), given.docx)
    if given.json:
        write_json(json_lines(response, audit.documents), given.json)
    print(json.dumps(json.loads(as_json(audit.report, audit.documents).first().json)["report"], indent=2))


if __name__ == "__main__":
    main()
