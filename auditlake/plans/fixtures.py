"""Awkward cases that the registered queries spread over the given tables, and the same for their SQL.

A case is a template: row k of a table takes case k modulo their number, and @ in its texts is k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECKLISTS = [
    ("normal-@", "# X\n\n**Audit Name:** Small audit @\n**Version:** 2.1\n\n### R001: First @\n\n**Severity:** HIGH\n**Mandatory:** true\n**Description:** One.\n- sub\n\n### R002: Second\n**Description:** Two.\n\n---\n"),
    ("plain-@", "intro\n### X1: bad\n**Severity:** low\n### R003: Third\n**Severity:** urgent\n**Mandatory:** yes\n#### R004: x\n"),
    ("twice-@", "\n### R001: a\n**Severity:** low\n**Mandatory:** True\n**Description:** x\n### R001: b\n**Severity:** critical\n"),
    ("empty-@", ""),
]

REPLIES = [
    ("plain-@", '{"passed": true, "score": 90, "failed_rules": [], "remarks": "fine @"}'),
    ("fenced-@", '```json\n{"passed": false, "score": 40.5, "failed_rules": [{"rule_id": "R001", "evidence": "e @", "page_number": 2}], "remarks": "r"}\n```'),
    ("shouted-@", '```JSON\n{"passed": true}\n```'),
    ("after-@", '{"passed": true} trailing'),
    ("before-@", 'well {"passed": true}'),
    ("list-@", "[1]"),
    ("nothing-@", ""),
    ("error-@", '{"error": "no answer"}'),
    ("text_false-@", '{"passed": "false", "score": "85"}'),
    ("percent-@", '{"passed": true, "score": "85%"}'),
    ("high-@", '{"passed": true, "score": 1@20}'),
    ("low-@", '{"passed": true, "score": -1@}'),
    ("mixed-@", '{"passed": false, "score": 10, "failed_rules": [{"rule_id": "R002"}, "str", null]}'),
    ("pages-@", '{"score": 1, "failed_rules": [{"rule_id": "R003", "page_number": "3"}, {"evidence": "x", "page_number": 3.0}]}'),
    ("bad_page-@", '{"score": 1, "failed_rules": [{"rule_id": "R003", "page_number": "p3"}]}'),
    ("two_objects-@", '{"passed": true, "score": 90} {"x": 1}'),
    ("listed-@", '{"passed": true, "score": 90}, {"x": 1}'),
    ("nested_score-@", '{"passed": true, "failed_rules": [{"rule_id": "R001", "score": 300}]}'),
    ("looks_like_a_key-@", '{"passed": true, "remarks": "\\"score\\": none, \\"failed_rules\\": null"}'),
    ("no_remarks-@", '{"passed": true, "score": 100, "remarks": null}'),
]

SUMMARIES = [
    ("/in/a@.pdf", "application/pdf", '{"document_type": "invoice", "summary": "s @", "language": "en", "key_fields": {"document_number": "@", "total_amount": 12.5, "date": null}}'),
    ("/in/b@.png", "image/png", '```json\n{"document_type": null, "key_fields": {"path": "other"}}\n```'),
    ("/in/c@.png", "image/png", "no idea"),
    ("/in/d@.png", "image/png", '{"error": "x"}'),
]

#: SQL that both dialects run: rules of nations, items of customers, batches of customers' orders.  Scores are sums of
#: powers of two, so that their mean does not depend on the order of the rows.
RULES = """SELECT CAST(n_nationkey AS INT) AS ord, concat('R00', CAST(n_nationkey % 9 AS STRING)) AS rule_id, n_name AS title, concat('all of ', n_name) AS description,
 CASE n_nationkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'urgent' END AS severity, n_regionkey % 2 = 0 AS mandatory FROM nation"""
ITEMS = """SELECT CAST(c_nationkey AS STRING) AS doc_key, CAST(c_custkey AS INT) AS pos, CASE WHEN c_custkey % 7 = 0 THEN CAST(NULL AS STRING) ELSE concat('R00', CAST(c_custkey % 10 AS STRING)) END AS rule_id,
 CASE WHEN c_custkey % 4 = 0 THEN repeat(c_name, 9) ELSE c_name END AS evidence, CASE WHEN c_custkey % 3 = 0 THEN CAST(NULL AS INT) ELSE CAST(c_custkey % 12 AS INT) END AS page_number FROM customer"""
BATCHES = """SELECT CAST(c_custkey AS STRING) AS batch, o_orderkey % 10 > 2 AS passed, CASE o_orderkey % 48 WHEN 0 THEN CAST(79.99609375 AS DOUBLE) WHEN 8 THEN CAST(80 AS DOUBLE) WHEN 16 THEN CAST(50 AS DOUBLE) WHEN 24 THEN CAST(49.9990234375 AS DOUBLE)
 ELSE CAST(o_orderkey % 401 AS DOUBLE) / 4 END AS score FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderkey % 8 = 0"""

PATHS = [("/in/b@.pdf",), ("/in/a@.PDF",), ("/in/Z@.jpg",), ("/in/x@.tif",), ("/in/e@.tar.bmp",), ("/in/c@.webp",), ("/in/d@.txt",), ("/in/@/.pdf",), ("/in/.hid@.pdf",), ("/in/_und@.png",), ("/in/q@.tiff",), ("/in/noext@",)]


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def spread(rows: DataFrame, key: str, cases: list[tuple], schema: str) -> DataFrame:
    """The cases spread over the rows by a whole-numbered key."""
    k = F.col(key)

    def column(at: int, name: str) -> Column:
        case = F.element_at(F.array(*[F.lit(c[at]) for c in cases]), (k % len(cases) + 1).cast("int"))
        return F.replace(case, F.lit("@"), k.cast("string")).alias(name)

    return rows.select(*[column(i, c.split(" ")[0]) for i, c in enumerate(schema.split(", "))])


def spread_sql(source: str, key: str, cases: list[tuple], schema: str) -> str:
    """The same rows for DuckDB."""
    columns = [f"replace(([{', '.join(literal(c[i]) for c in cases)}])[{key} % {len(cases)} + 1], '@', CAST({key} AS VARCHAR)) AS {c.split(' ')[0]}" for i, c in enumerate(schema.split(", "))]
    return f"(SELECT {', '.join(columns)} FROM {source})"
