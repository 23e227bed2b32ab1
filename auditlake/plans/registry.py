"""The registered audit queries and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.names import base_name, file_media_type, page_media_type, suffix
from auditlake.functions.replies import decode_replies, decode_summaries, with_summaries
from auditlake.operators import checklist, rules, scoring
from auditlake.operators import report as reports
from auditlake.operators.fields import REQUIRED, field_findings, header_fields
from auditlake.plans import filing  # noqa: F401  registers its queries
from auditlake.plans import fixtures as fx
from auditlake.plans.audit import invoice_audit, whole_audit
from auditlake.plans.catalog import ORACLE_SQL, QUERIES, query, table  # noqa: F401
from auditlake.schemas import SUFFIXES
from auditlake.shared import dealt

MONEY = "CAST({} AS DECIMAL(12,2))".format
GROSS = f"{MONEY('l_extendedprice')} * (1 - {MONEY('l_discount')}) * (1 + {MONEY('l_tax')})"
FACTS = f"(SELECT l_orderkey, count(*) AS lines, sum({GROSS}) AS gross, min(l_shipdate) AS first_ship, count(*) FILTER (l_tax = 0) AS untaxed, count(*) - count(DISTINCT l_linenumber) AS repeated FROM lineitem GROUP BY l_orderkey)"
FINDINGS = f"""(SELECT o_orderkey AS doc_key, rule_id, mandatory, complies FROM (
 SELECT o_orderkey, unnest([
  {{'rule_id': 'R002', 'mandatory': true, 'complies': lines IS NOT NULL}},
  {{'rule_id': 'R003', 'mandatory': true, 'complies': lines IS NULL OR abs({MONEY('o_totalprice')} - gross) <= 0.01}},
  {{'rule_id': 'R005', 'mandatory': false, 'complies': lines IS NULL OR first_ship >= o_orderdate}},
  {{'rule_id': 'R008', 'mandatory': false, 'complies': lines IS NULL OR repeated = 0}},
  {{'rule_id': 'R010', 'mandatory': true, 'complies': lines IS NULL OR untaxed = 0}}], recursive := true)
 FROM orders LEFT JOIN {FACTS} ON o_orderkey = l_orderkey))"""
SCORES = f"(SELECT doc_key, bool_and(complies OR NOT mandatory) AS passed, CAST(count(*) FILTER (complies) AS DOUBLE) * 100 / CAST(count(*) AS DOUBLE) AS score FROM {FINDINGS} GROUP BY doc_key)"


def report_sql(results: str, title: str, by: str = "") -> str:
    """results: passed, score and the grouping column."""
    group, head = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"""
WITH g AS (SELECT {head}count(score) AS n, count(*) FILTER (passed AND score IS NOT NULL) AS ok, coalesce(avg(score), 100.0) AS mean, stddev_samp(score) AS s FROM {results} {group}),
h AS (SELECT *, CAST(printf('%.2f', mean) AS DOUBLE) AS overall, CASE WHEN mean >= 80 THEN 'PASS' WHEN mean >= 50 THEN 'REVIEW REQUIRED' ELSE 'FAIL' END AS result,
  CASE WHEN n = 0 THEN 0.0 WHEN n = 1 THEN 12.5 ELSE 1.96 * s / sqrt(CAST(n AS DOUBLE)) END AS margin FROM g)
SELECT {head}'{title}' AS audit_title, n AS documents_processed, ok AS documents_passed, n - ok AS documents_failed, overall AS overall_score, result AS overall_result,
  CAST(printf('%.2f', greatest(0.0, overall - margin)) AS DOUBLE) AS lower, CAST(printf('%.2f', least(100.0, overall + margin)) AS DOUBLE) AS upper,
  n || ' documents checked, ' || ok || ' passed, result ' || result || '.' AS summary FROM h"""


@query(report_sql(SCORES, "Orders as invoices"))
def overall_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoice_audit(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "Orders as invoices")


flagship = overall_scoring


@query(f"SELECT * FROM {FINDINGS}")
def doc_rule_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.invoice_findings(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


@query(f"SELECT * FROM {SCORES}")
def doc_passed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.document_scores(doc_rule_matrix(spark, sf_dir))


@query(f"""SELECT coalesce(severity, 'all') AS severity, coalesce(rule_id, 'all') AS rule_id, count(*) AS failures
FROM {FINDINGS} f JOIN (VALUES ('R002','critical'),('R003','critical'),('R005','medium'),('R008','medium'),('R010','critical')) s(r, severity) ON rule_id = r WHERE NOT complies GROUP BY ROLLUP (severity, rule_id)""")
def failures_by_rule_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditlake.sources.files import own_rules

    known = checklist.parse_checklist(spark.createDataFrame([("own", own_rules())], "checklist string, text string")).select("rule_id", "severity")
    failed = doc_rule_matrix(spark, sf_dir).where(~F.col("complies")).join(F.broadcast(known), "rule_id")
    return failed.rollup("severity", "rule_id").agg(F.count(F.lit(1)).alias("failures")).select(F.coalesce("severity", F.lit("all")).alias("severity"), F.coalesce("rule_id", F.lit("all")).alias("rule_id"), "failures")


# ---------------------------------------------------------------- scoring


def shared_sql(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """SQL that both dialects run, over given tables."""
    for name in names:
        sql = re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names})


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each customer, of none, one or more of the customer's orders."""
    return shared_sql(spark, sf_dir, fx.BATCHES, "customer", "orders")


@query(report_sql(f"({fx.BATCHES})", "Untitled Audit", "batch"))
def classify_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.report(batches(spark, sf_dir), "", ("batch",))


def batches_of(name: str, size: str):
    def interval(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scoring.report(batches(spark, sf_dir), "", ("batch",)).where(f"documents_processed {size}").select("batch", "documents_processed", "overall_score", "lower", "upper")

    interval.__name__ = name
    query(f"SELECT batch, documents_processed, overall_score, lower, upper FROM ({report_sql(f'({fx.BATCHES})', '', 'batch')}) WHERE documents_processed {size}")(interval)


for _name, _size in (("interval_n0", "= 0"), ("interval_n1", "= 1"), ("interval_n2", "= 2"), ("interval_n3", ">= 3")):
    batches_of(_name, _size)


# ---------------------------------------------------------------- checklist, lookup, replies

CHECKLIST_SCHEMA = "checklist string, text string"


@query(rf"""
WITH t AS (SELECT checklist, text, string_split_regex(text, '\n###\s+') AS p FROM {fx.spread_sql('supplier', 's_suppkey', fx.CHECKLISTS, CHECKLIST_SCHEMA)}),
b AS (SELECT checklist, coalesce(nullif(regexp_extract(text, '\*\*Audit Name:\*\*\s*([^\n]+)', 1), ''), 'Untitled Checklist') AS audit_name,
  coalesce(nullif(regexp_extract(text, '\*\*Version:\*\*\s*([^\n]+)', 1), ''), '1.0') AS version, unnest(range(1, len(p))) AS ord, p FROM t),
r AS (SELECT *, p[ord + 1] AS block FROM b),
f AS (SELECT checklist, audit_name, version, CAST(ord AS INTEGER) AS ord, regexp_extract(block, '^(R\d+):\s*([^\n]+)', 1) AS rule_id, trim(regexp_extract(block, '^(R\d+):\s*([^\n]+)', 2)) AS title,
  regexp_replace(regexp_extract(block, '(?s)\*\*Description:\*\*\s*(.+)', 1), '^\s+|\s+$', '', 'g') AS description,
  lower(coalesce(nullif(regexp_extract(block, '\*\*Severity:\*\*\s*(\S+)', 1), ''), 'medium')) AS severity,
  lower(regexp_extract(block, '\*\*Mandatory:\*\*\s*(\S+)', 1)) = 'true' AS mandatory FROM r)
SELECT *, severity IN ('critical', 'high', 'medium', 'low') AS valid FROM f WHERE rule_id <> ''""")
def checklist_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checklist.parse_checklist(fx.spread(table(spark, sf_dir, "supplier"), "s_suppkey", fx.CHECKLISTS, CHECKLIST_SCHEMA))


LOOKUP = f"""(WITH r AS (SELECT rule_id AS id, title, description AS d, severity AS s FROM ({fx.RULES}) QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY ord) = 1)
SELECT doc_key, pos, coalesce(rule_id, 'unknown') AS rule_id, evidence, page_number, coalesce(title, rule_id, 'unknown') AS rule_title, coalesce(d, '') AS description,
 CASE WHEN s IN ('critical', 'high', 'medium', 'low') THEN s ELSE 'medium' END AS severity FROM ({fx.ITEMS}) i LEFT JOIN r ON coalesce(i.rule_id, 'unknown') = r.id)"""


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as failed items, nations as rules."""
    return checklist.with_rule(shared_sql(spark, sf_dir, fx.ITEMS, "customer"), shared_sql(spark, sf_dir, fx.RULES, "nation"))


@query(f"SELECT * FROM {LOOKUP}")
def rule_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looked_up(spark, sf_dir)


@query(f"""SELECT doc_key, string_agg(rule_id || ':' || severity, ',' ORDER BY list_position(['critical', 'high', 'medium', 'low'], severity), pos) AS failures FROM {LOOKUP} GROUP BY doc_key""")
def severity_sorted_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a document's failed rules are as many as the checklist has
    per = looked_up(spark, sf_dir).groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct("pos", "rule_id", "severity"))).alias("items"))
    return per.select("doc_key", F.array_join(F.transform(checklist.by_severity(F.col("items")), lambda x: F.concat_ws(":", x["rule_id"], x["severity"])), ",").alias("failures"))


@query(f"""SELECT doc_key, pos, rule_id || ': ' || rule_title AS rule, upper(severity) AS severity, evidence || CASE WHEN page_number IS NULL THEN '' ELSE ' (p. ' || page_number || ')' END AS evidence FROM {LOOKUP}""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_rows(looked_up(spark, sf_dir))


REPLY_SCHEMA = "reply_id string, reply string"


@query(f"""
WITH t AS (SELECT reply_id, regexp_replace(reply, '^\\s+|\\s+$', '', 'g') AS x FROM {fx.spread_sql('orders', 'o_orderkey', fx.REPLIES, REPLY_SCHEMA)}),
u AS (SELECT reply_id, CASE WHEN starts_with(x, '```') THEN regexp_replace(regexp_replace(regexp_replace(x, '^`+|`+$', '', 'g'), '^\\s+|\\s+$', '', 'g'), '^json\\s*', '') ELSE x END AS x FROM t),
j AS (SELECT reply_id, CASE WHEN json_valid(x) AND json_type(x) = 'OBJECT' THEN CAST(x AS JSON) END AS j FROM u),
f AS (SELECT reply_id, j, j->>'$.passed' AS passed, j->>'$.score' AS raw, TRY_CAST(j->>'$.score' AS DOUBLE) AS score, coalesce(j->>'$.remarks', '') AS remarks,
  list_filter(CAST(coalesce(j->'$.failed_rules', '[]') AS JSON[]), lambda e: json_type(e) = 'OBJECT') AS items FROM j),
g AS (SELECT *, raw IS NULL OR coalesce(score BETWEEN 0 AND 100, false) AS score_ok,
  len(list_filter(items, lambda e: (e->>'$.page_number') IS NOT NULL AND TRY_CAST(e->>'$.page_number' AS DOUBLE) IS NULL)) = 0 AS pages_ok FROM f)
SELECT reply_id, CASE WHEN j IS NULL THEN 'parse_error' WHEN j->>'$.error' IS NOT NULL THEN 'api_error' WHEN NOT score_ok THEN 'invalid_score' WHEN NOT pages_ok THEN 'invalid_page' ELSE 'ok' END AS status,
  coalesce(lower(passed) IN ('true', '1'), false) AS passed, CASE WHEN j IS NOT NULL AND score_ok THEN coalesce(score, 0.0) ELSE 0.0 END AS score, remarks, CAST(len(items) AS INTEGER) AS n_failed,
  array_to_string(list_transform(items, lambda e: coalesce(e->>'$.rule_id', 'unknown') || '/' || coalesce(e->>'$.evidence', '') || '/' || coalesce(CAST(CAST(TRY_CAST(e->>'$.page_number' AS DOUBLE) AS INTEGER) AS VARCHAR), '-')), ',') AS failed
FROM g""")
def decode_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decode_replies(fx.spread(table(spark, sf_dir, "orders"), "o_orderkey", fx.REPLIES, REPLY_SCHEMA))
    shown = F.transform("failed_rules", lambda x: F.concat_ws("/", x["rule_id"], x["evidence"], F.coalesce(x["page_number"].cast("string"), F.lit("-"))))
    return d.select("reply_id", "status", "passed", "score", "remarks", F.size("failed_rules").alias("n_failed"), F.array_join(shown, ",").alias("failed"))


SUMMARY_SCHEMA = "path string, media_type string, reply string"
SUMMARY_SQL = f"""(WITH t AS (SELECT path, media_type, regexp_replace(regexp_replace(reply, '^`+(json)?|`+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS x FROM {fx.spread_sql('pages', 'page_id', fx.SUMMARIES, SUMMARY_SCHEMA)}),
j AS (SELECT path, media_type, CASE WHEN json_valid(x) THEN CAST(x AS JSON) END AS j FROM t),
k AS (SELECT path, unnest(json_keys(j, '$.key_fields')) AS key, j FROM j),
f AS (SELECT path, key, j->'$.key_fields'->>key AS value FROM k WHERE (j->'$.key_fields'->>key) IS NOT NULL),
m AS (SELECT path, 'path' AS key, path AS value FROM j UNION ALL SELECT path, 'mime_type', media_type FROM j),
e AS (SELECT * FROM f UNION ALL SELECT * FROM m WHERE (path, key) NOT IN (SELECT path, key FROM f)),
g AS (SELECT path, string_agg(key || '=' || value, ';' ORDER BY key) AS metadata FROM e GROUP BY path)
SELECT path, coalesce(j->>'$.document_type', 'unknown') AS document_type, coalesce(j->>'$.summary', '') AS summary, coalesce(j->>'$.language', 'unknown') AS language, metadata,
 CASE WHEN j IS NULL THEN 'parse_error' WHEN j->>'$.error' IS NOT NULL THEN 'api_error' ELSE 'ok' END AS status FROM j JOIN g USING (path))"""


@query(f"SELECT * FROM {SUMMARY_SQL}")
def decode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decode_summaries(fx.spread(table(spark, sf_dir, "pages"), "page_id", fx.SUMMARIES, SUMMARY_SCHEMA))
    shown = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return d.select("path", "document_type", "summary", "language", F.array_join(shown, ";").alias("metadata"), "status")


#: Files of which every third has no summary.
PAIRED = [(p if k % 3 else "/in/other@",) for k, (p, *_) in enumerate(fx.SUMMARIES)]


@query(f"SELECT p.path AS doc_key, coalesce(document_type, 'unknown') AS document_type, coalesce(summary, '') AS summary FROM {fx.spread_sql('pages', 'page_id', PAIRED, 'path string')} p LEFT JOIN {SUMMARY_SQL} s ON p.path = s.path")
def paired_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    summaries = decode_summaries(fx.spread(pages, "page_id", fx.SUMMARIES, SUMMARY_SCHEMA)).withColumnRenamed("path", "doc_key")
    return with_summaries(fx.spread(pages, "page_id", PAIRED, "doc_key string"), summaries)


@query(f"""SELECT 'c' AS checklist, string_agg('- [' || rule_id || '] ' || title || ' (' || severity || ', ' || CASE WHEN mandatory THEN 'mandatory' ELSE 'optional' END || '): ' || description, chr(10) ORDER BY ord) AS rules FROM ({fx.RULES})""")
def rule_prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checklist.rule_lines(shared_sql(spark, sf_dir, fx.RULES, "nation").withColumn("checklist", F.lit("c")))


@query(f"""SELECT batch, CASE overall_result WHEN 'PASS' THEN 'PASSED' WHEN 'FAIL' THEN 'FAILED' ELSE overall_result END AS label, printf('%.1f', overall_score) AS shown_score,
 printf('%.1f', lower) || ' - ' || printf('%.1f', upper) AS shown_interval, documents_processed || CASE WHEN documents_processed = 1 THEN ' document' ELSE ' documents' END AS counted FROM ({report_sql(f"({fx.BATCHES})", "Untitled Audit", "batch")})""")
def displayed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.displayed(classify_boundaries(spark, sf_dir)).select("batch", "label", "shown_score", "shown_interval", "counted")


@query(f"SELECT doc_key, pos, '[' || rule_id || '] ' || substr(evidence, 1, 120) AS line FROM {LOOKUP}")
def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.trace(looked_up(spark, sf_dir))


@query(rf"""
WITH p AS (SELECT path, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^\.*[^.].*?(\.[^.]*)$', 1)) AS ext FROM {fx.spread_sql('pages', 'page_id', fx.PATHS, 'path string')})
SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, ext, ext IN {SUFFIXES} AS discovered,
 CASE WHEN ext = '.pdf' THEN 'image/jpeg' WHEN ext = '.jpg' THEN 'image/jpeg' WHEN ext IN ('.tif', '.tiff') THEN 'image/tiff' WHEN ext IN ('.png', '.jpeg', '.bmp', '.webp') THEN 'image/' || substr(ext, 2) END AS page_media_type,
 CASE WHEN ext = '.pdf' THEN 'application/pdf' WHEN ext IN ('.png', '.jpg', '.jpeg', '.tiff', '.tif', '.bmp', '.webp') THEN 'image/' || substr(ext, 2) ELSE 'application/octet-stream' END AS media_type FROM p""")
def mime_and_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.spread(table(spark, sf_dir, "pages"), "page_id", fx.PATHS, "path string").withColumns({"name": base_name(F.col("path")), "ext": suffix(F.col("path"))})
    return d.withColumns({"discovered": F.col("ext").isin(*SUFFIXES), "page_media_type": page_media_type(F.col("ext")), "media_type": file_media_type(F.col("ext"))})


# ---------------------------------------------------------------- rules on the business tables


@query(r"""SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) AS BIGINT) AS junk,
 length(text) >= 50 AND CAST(length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) AS DOUBLE) / length(text) <= 0.1 AS complies FROM documents""")
def r001_legibility_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.legibility(table(spark, sf_dir, "documents"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def r002_missing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.missing_lines(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


@query(f"""SELECT l_orderkey, count(*) AS lines, count(*) FILTER (off <> 0) AS wrong_lines, CAST(sum(off) AS DOUBLE) AS overstated FROM
 (SELECT l_orderkey, {MONEY('l_extendedprice')} - {MONEY('l_quantity')} * {MONEY('p_retailprice')} AS off FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_orderkey""")
def r003_line_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.line_amounts(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))


@query(f"SELECT o_orderkey, CAST(gross AS DOUBLE) AS gross, CAST({MONEY('o_totalprice')} - gross AS DOUBLE) AS overstated, abs({MONEY('o_totalprice')} - gross) <= 0.01 AS complies FROM orders JOIN {FACTS} ON o_orderkey = l_orderkey")
def r003_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rollup_amounts(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


#: Orders as invoices with stated figures, some of them wrong; money is in cents until it is compared.
STATED_LINES = """SELECT l_orderkey AS doc_id, CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_partkey % 977 AS DECIMAL(18,2)) / 4 AS unit_price,
 l_orderkey % 5 = 0 AND l_linenumber = 1 AS off, l_linenumber FROM lineitem"""
LINES = f"""SELECT doc_id, quantity, CAST(unit_price AS DECIMAL(18,2)) AS unit_price, CAST(quantity * CAST(unit_price AS DECIMAL(18,2)) + CASE WHEN off THEN 0.5 ELSE 0 END AS DECIMAL(18,2)) AS line_total FROM ({STATED_LINES})"""
SUMS = f"SELECT doc_id, CAST(sum(quantity * unit_price) + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS subtotal FROM ({LINES}) GROUP BY doc_id"
TAXED = f"SELECT doc_id, subtotal, CAST(floor(subtotal * 10) / 100 + CASE doc_id % 13 WHEN 0 THEN 0.02 WHEN 1 THEN 0.01 ELSE 0 END AS DECIMAL(18,2)) AS tax, CAST(doc_id % 3 AS DECIMAL(18,2)) AS discount FROM ({SUMS})"
HEADS = f"SELECT *, CAST(subtotal + tax - discount + CASE WHEN doc_id % 17 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(18,2)) AS grand FROM ({TAXED})"


@query(f"""
WITH l AS (SELECT doc_id, count(*) FILTER (line_total <> quantity * unit_price) AS wrong_lines, sum(quantity * unit_price) AS expected FROM ({LINES}) GROUP BY doc_id),
c AS (SELECT doc_id, wrong_lines, subtotal = expected AS subtotal_ok, abs(tax * 10 - subtotal) <= 0.1 AS tax_ok, grand = subtotal + tax - discount AS grand_ok FROM ({HEADS}) JOIN l USING (doc_id))
SELECT *, wrong_lines = 0 AND subtotal_ok AND tax_ok AND grand_ok AS complies FROM c""")
def r003_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = shared_sql(spark, sf_dir, HEADS, "lineitem").withColumn("rate", F.lit(10))
    return rules.invoice_arithmetic(shared_sql(spark, sf_dir, LINES, "lineitem"), heads)


@query("""SELECT o_orderkey, count(*) AS early_lines, CAST(max(date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))) AS BIGINT) AS most_days
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate GROUP BY o_orderkey""")
def r005_date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.date_order(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1990-01-01' AND o_orderdate < TIMESTAMP '2001-01-01')")
def r005_audit_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.outside_period(table(spark, sf_dir, "orders"), "1990-01-01", "2001-01-01")


@query("""SELECT doc_id, array_to_string(signs, '') AS signs, len(signs) = 1 OR regexp_matches(text, '(?i)(conversion|exchange) rate') AS complies FROM
 (SELECT doc_id, text, list_sort(list_distinct(regexp_extract_all(text, '[$€£¥₹]'))) AS signs FROM documents) WHERE len(signs) > 0""")
def r006_currency_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.currencies(table(spark, sf_dir, "documents"))


@query("""SELECT coalesce(r_name, '?') AS region, count(*) AS invoices, count(*) FILTER (coalesce(c_name <> '', false) AND n_name IS NOT NULL AND r_name IS NOT NULL) AS complete
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def r007_party_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.parties(*(table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region")))


@query("SELECT l_orderkey, l_linenumber, count(*) AS uses FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def r008_duplicate_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.repeated_numbers(table(spark, sf_dir, "lineitem"))


@query("SELECT DISTINCT l_orderkey AS after FROM lineitem WHERE l_orderkey + 1 NOT IN (SELECT l_orderkey FROM lineitem) AND l_orderkey < (SELECT max(l_orderkey) FROM lineitem)")
def r008_sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.number_gaps(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("number")))


@query(f"""SELECT l_tax, count(*) AS lines, CAST(sum(net) AS DOUBLE) AS net, CAST(sum(net * {MONEY('l_tax')}) AS DOUBLE) AS tax, l_tax > 0 AS taxed
 FROM (SELECT l_tax, {MONEY('l_extendedprice')} * (1 - {MONEY('l_discount')}) AS net FROM lineitem) GROUP BY l_tax""")
def r010_tax_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.tax_breakdown(table(spark, sf_dir, "lineitem"))


#: Orders written out as documents of six types, with what the rules look for now there and now not.
PARTS = [
    ("true", "Date {d}, {k} "),
    ("o_custkey % 5 <> 0", "seller and vendor and supplier: Works; buyer and receiver: {c}; "),
    ("o_custkey % 3 <> 0", "12 Mill Road, Tax ID 77; "),
    ("o_custkey % 7 <> 0", "quantity 4, subtotal, VAT 7 %, total $10; "),
    ("o_custkey % 11 = 0", "or €9; "),
    ("o_custkey % 22 = 0", "exchange rate 1.1; "),
    ("o_custkey % 4 <> 0", "delivery date, effective date, net 30; "),
    ("o_custkey % 6 <> 0", "parties, term, scope, price, issued by and issued to; "),
    ("o_custkey % 9 <> 0", "Signed by A. Clerk; "),
    ("o_custkey % 13 = 0", "miscellaneous; "),
    ("o_custkey % 8 = 0", "attached DOC-{a}; "),
    ("o_custkey % 2 = 0", "valid until {d}"),
    ("o_custkey % 17 = 0", " #### **** //// ==== ---- ++++ #### **** //// ==== ----"),
]
KINDS = ("invoice", "receipt", "purchase_order", "delivery_challan", "contract", "certificate")
AS_OF = "1996-01-01"


def written_out(day: str, array_at: str) -> str:
    """SQL of the columns doc_id, document_type, document_number and text; the two dialects differ in two functions."""
    values = {"d": day, "k": array_at, "c": "CAST(o_custkey AS STRING)", "a": "CAST(o_orderkey + o_custkey % 3 - 1 AS STRING)"}

    def text(part: str) -> str:
        for name, value in values.items():
            part = part.replace("{" + name + "}", f"', {value}, '")
        return f"concat('{part}')"

    parts = ", ".join(f"CASE WHEN {when} THEN {text(part)} ELSE '' END" for when, part in PARTS)
    number = "CASE WHEN o_custkey % 19 = 0 THEN CAST(NULL AS STRING) WHEN o_custkey % 23 = 0 THEN 'no number' WHEN o_custkey % 29 = 0 THEN 'DOC-0' ELSE concat('DOC-', CAST(o_orderkey AS STRING)) END"
    return f"SELECT o_orderkey AS doc_id, {array_at} AS document_type, {number} AS document_number, concat({parts}) AS text FROM orders"


def order_documents(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Orders written out as documents; spread, over all cores for what takes long on each."""
    orders = table(spark, sf_dir, "orders")
    kinds = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + f"), CAST(o_orderkey % {len(KINDS)} AS INT) + 1)"
    return spark.sql(written_out("date_format(o_orderdate, 'yyyy-MM-dd')", kinds).replace("FROM orders", "FROM {orders}"), orders=dealt(orders, "o_orderkey") if spread else orders)


DOCS_SQL = written_out("strftime(o_orderdate, '%Y-%m-%d')", f"({list(KINDS)})[o_orderkey % {len(KINDS)} + 1]")
FIELDS_SQL = " ".join(f"WHEN '{kind}' THEN " + " AND ".join(f"regexp_matches(t, '{x}')" for x in fields) for kind, fields in rules.FIELDS.items())
KINDS_IN = ", ".join(f"'{k}'" for k in KINDS)
BILLING_SQL, SIGNED_SQL = "kind IN ('invoice', 'purchase_order')", "kind IN ('contract', 'certificate', 'delivery_challan')"
AUDIT_SQL = rf"""(WITH d AS ({DOCS_SQL}),
lacking AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'attached ([A-Z]+-[0-9]+)', 1)) AS wanted FROM d) WHERE wanted NOT IN (SELECT document_number FROM d WHERE document_number IS NOT NULL)),
f AS (SELECT doc_id, document_type AS kind, document_number AS number, text, lower(text) AS t, count(*) OVER (PARTITION BY document_number) AS uses, doc_id IN (SELECT doc_id FROM lacking) AS lacks,
  len(list_distinct(regexp_extract_all(text, '[$€£¥₹]'))) AS signs, regexp_extract(lower(text), '{rules.VALID_UNTIL}', 1) AS expiry FROM d)
SELECT doc_id AS doc_key, rule_id, mandatory, applies, complies FROM (SELECT doc_id, unnest([
 {{'rule_id': 'R001', 'mandatory': true, 'applies': true, 'complies': length(text) >= 50 AND length(regexp_replace(text, '[\p{{L}}\p{{N}}\s]', '', 'g')) <= 0.1 * length(text)}},
 {{'rule_id': 'R002', 'mandatory': true, 'applies': kind IN ({KINDS_IN}), 'complies': CASE kind {FIELDS_SQL} ELSE true END}},
 {{'rule_id': 'R004', 'mandatory': true, 'applies': {SIGNED_SQL}, 'complies': regexp_matches(t, 'signed by|signature:')}},
 {{'rule_id': 'R005', 'mandatory': false, 'applies': kind = 'certificate', 'complies': expiry = '' OR expiry >= '{AS_OF}'}},
 {{'rule_id': 'R006', 'mandatory': true, 'applies': signs > 0, 'complies': signs = 1 OR regexp_matches(t, '(conversion|exchange) rate')}},
 {{'rule_id': 'R007', 'mandatory': true, 'applies': {BILLING_SQL}, 'complies': regexp_matches(t, '[0-9]+ [a-z]+ (street|road|avenue)') AND regexp_matches(t, 'tax id')}},
 {{'rule_id': 'R008', 'mandatory': false, 'applies': true, 'complies': coalesce(regexp_matches(number, '^[A-Z]+-[0-9]+$') AND uses = 1, false)}},
 {{'rule_id': 'R009', 'mandatory': true, 'applies': {BILLING_SQL}, 'complies': regexp_matches(t, 'net [0-9]+|due (on|by|date)')}},
 {{'rule_id': 'R010', 'mandatory': true, 'applies': {BILLING_SQL} OR kind = 'receipt', 'complies': (regexp_matches(t, 'gst|vat|sales tax') AND regexp_matches(t, '[0-9]+ ?%') AND regexp_matches(t, 'tax id')) OR regexp_matches(t, '{rules.EXEMPTION}')}},
 {{'rule_id': 'R011', 'mandatory': false, 'applies': true, 'complies': NOT regexp_matches(t, '(miscellaneous|various items|sundries)')}},
 {{'rule_id': 'R012', 'mandatory': false, 'applies': contains(t, 'attached '), 'complies': NOT lacks}}], recursive := true) FROM f))"""


@query(f"SELECT * FROM {AUDIT_SQL}")
def document_rule_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven rules on every order written out as a document, with what applies to its type."""
    return rules.text_audit(order_documents(spark, sf_dir), AS_OF)


ALL_SQL = f"(SELECT doc_key, rule_id, mandatory, complies FROM {AUDIT_SQL} WHERE applies UNION ALL SELECT * FROM {FINDINGS} WHERE rule_id = 'R003')"


@query(report_sql(f"(SELECT doc_key, bool_and(complies OR NOT mandatory) AS passed, CAST(count(*) FILTER (complies) AS DOUBLE) * 100 / CAST(count(*) AS DOUBLE) AS score FROM {ALL_SQL} GROUP BY doc_key)", "Orders as documents"))
def twelve_rule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_audit(order_documents(spark, sf_dir), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), AS_OF, "Orders as documents")


@query(f"""SELECT o_orderkey, 'stated total ' || CAST(CAST(abs(total) AS DECIMAL(18,2)) AS VARCHAR) || ', sum of lines ' || CAST(gross AS VARCHAR) || CASE WHEN total > gross THEN ', overstated by ' ELSE ', understated by ' END || CAST(abs(total - gross) AS VARCHAR) AS evidence
 FROM (SELECT o_orderkey, CAST({MONEY('o_totalprice')} AS DECIMAL(18,2)) AS total, CAST(gross AS DECIMAL(18,2)) AS gross FROM orders JOIN {FACTS} ON o_orderkey = l_orderkey) WHERE abs(total - gross) > 0.01""")
def r003_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.arithmetic_evidence(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


TEXT_SQL = f"""(SELECT doc_id, rule_id, complies FROM (SELECT doc_id, unnest([
 {{'rule_id': 'R004', 'complies': document_type NOT IN ('contract', 'certificate', 'delivery_challan') OR regexp_matches(t, 'signed by|signature:')}},
 {{'rule_id': 'R006', 'complies': len(list_distinct(regexp_extract_all(text, '[$€£¥₹]'))) <= 1 OR regexp_matches(t, '(conversion|exchange) rate')}},
 {{'rule_id': 'R007', 'complies': document_type NOT IN ('invoice', 'purchase_order') OR (regexp_matches(t, '[0-9]+ [a-z]+ (street|road|avenue)') AND regexp_matches(t, 'tax id'))}},
 {{'rule_id': 'R009', 'complies': document_type NOT IN ('invoice', 'purchase_order') OR regexp_matches(t, 'net [0-9]+|due (on|by|date)')}},
 {{'rule_id': 'R011', 'complies': NOT regexp_matches(t, '(miscellaneous|various items|sundries)')}}], recursive := true)
 FROM (SELECT *, lower(text) AS t FROM ({DOCS_SQL}))))"""


def text_rule(name: str, *ids: str):
    def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rules.text_findings(order_documents(spark, sf_dir)).where(F.col("rule_id").isin(*ids))

    findings.__name__ = name
    query(f"SELECT * FROM {TEXT_SQL} WHERE rule_id IN ({', '.join(map(fx.literal, ids))})")(findings)


for _name, _id in (("r004_text", "R004"), ("r006_text", "R006"), ("r007_text", "R007"), ("r009_text", "R009"), ("r011_text", "R011")):
    text_rule(_name, _id)


@query(f"""WITH d AS ({DOCS_SQL}), w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, 'attached ([A-Z]+-[0-9]+)', 1))) AS wanted FROM d)
SELECT doc_id, wanted FROM w WHERE wanted NOT IN (SELECT document_number FROM d WHERE document_number IS NOT NULL)""")
def r012_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.missing_attachments(order_documents(spark, sf_dir))


@query(f"SELECT document_number, count(*) AS uses FROM ({DOCS_SQL}) WHERE document_number IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def r008_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_documents(spark, sf_dir).where("document_number IS NOT NULL").groupBy("document_number").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")


@query(r"""SELECT quality, complies, count(*) AS documents FROM (SELECT doc_id, length(text) >= 50 AND CAST(length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) AS DOUBLE) / length(text) <= 0.1 AS complies FROM documents) JOIN labels USING (doc_id) GROUP BY 1, 2""")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.label_agreement(rules.legibility(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


@query(f"""SELECT run_id, doc_key, CAST(row_number() OVER (PARTITION BY run_id ORDER BY doc_key) AS INTEGER) AS no FROM (SELECT 'batch' AS run_id, path AS doc_key FROM {fx.spread_sql('pages', 'page_id', fx.PATHS, 'path string')})""")
def numbered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.numbered(fx.spread(table(spark, sf_dir, "pages"), "page_id", fx.PATHS, "path string").select(F.lit("batch").alias("run_id"), F.col("path").alias("doc_key")))


def said_sql(pattern: str) -> str:
    return f"nullif(regexp_extract(text, '{pattern}'), '')"


#: The fields of orders written out as documents, by patterns that fit these texts only.
SAID = {"signature": said_sql("Signed by A. Clerk"), "address": said_sql("[0-9]+ Mill Road"), "tax_id": said_sql("Tax ID [0-9]+"), "term": said_sql("net [0-9]+"), "vague": said_sql("miscellaneous")}
FIELD_SQL = " UNION ALL ".join(
    f"SELECT doc_id AS doc_key, '{rule}' AS rule_id, {mandatory} AS mandatory, {applies} AS applies, NOT {applies} OR ({' AND '.join(f'{SAID[k]} IS NOT NULL' for k in kinds)}) AS complies, CASE WHEN {applies} THEN "
    + " || '; ' || ".join(f"coalesce('{k}: ' || {SAID[k]}, 'no {k}')" for k in kinds)
    + " ELSE '' END AS evidence FROM d"
    for rule, mandatory, applies, kinds in (("R004", "true", SIGNED_SQL, ("signature",)), ("R007", "true", BILLING_SQL, ("address", "tax_id")), ("R009", "true", BILLING_SQL, ("term",)))
)


@query(f"""WITH d AS (SELECT *, document_type AS kind FROM ({DOCS_SQL})) {FIELD_SQL}
 UNION ALL SELECT doc_id, 'R011', false, true, {SAID['vague']} IS NULL, coalesce('vague: ' || {SAID['vague']}, '') FROM d""")
def field_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R004, R007, R009 and R011 by typed fields, with the words that were found."""
    return field_findings(order_documents(spark, sf_dir, spread=True)).where("rule_id IN ('R004', 'R007', 'R009', 'R011')")


DATED_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {value} AS value, CAST(strpos(text, {words}) - 1 AS INTEGER) AS start, {words} AS evidence FROM d WHERE contains(text, {words})"
    for kind, words, value in (
        ("total", "'total $10'", "'10'"), ("amount", "'€9'", "'9'"), ("rate", "'7 %'", "'7'"), ("address", "'12 Mill Road'", "'12 Mill Road'"), ("tax_id", "'Tax ID 77'", "'77'"), ("term", "'net 30'", "'net 30'"), ("signature", "'Signed by A. Clerk'", "'Signed by A. Clerk'"), ("vague", "'miscellaneous'", "'miscellaneous'"),
        ("seller", "'supplier: Works'", "'Works'"), ("quantity", "'quantity 4'", "'4'"), ("date", "substr(text, 6, 10)", "substr(text, 6, 10)"), ("expiry", "('valid until ' || substr(text, 6, 10))", "substr(text, 6, 10)"),
    )
)


@query(f"WITH d AS ({DOCS_SQL}) {DATED_SQL}")
def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed field of every order written out as a document, with its place and words."""
    return header_fields(order_documents(spark, sf_dir, spread=True)).select("doc_id", "kind", "value", "start", "evidence")


#: Fields that are planted in other documents of the orders, when, and how they are written.
PLANTED = [
    (("date",), "true", "Date {d}. "),
    (("seller",), "o_custkey % 5 <> 0", "Seller: Works Hill. "),
    (("buyer",), "o_custkey % 3 <> 0", "Buyer: Anna Lee. "),
    (("address",), "o_custkey % 4 <> 0", "12 Mill Road. "),
    (("tax_id",), "o_custkey % 6 <> 0", "VAT ID: 77. "),
    (("quantity",), "o_custkey % 7 <> 0", "Quantity 4. "),
    (("subtotal", "total"), "o_custkey % 2 = 0", "Subtotal: $90.00. Grand total: $99.00. "),
    (("tax",), "o_custkey % 8 <> 0", "VAT 10 % $9.00. "),
    (("exemption",), "o_custkey % 16 = 0", "Exempt under Clause 7. "),
    (("delivery",), "o_custkey % 9 <> 0", "Delivery date: {d}. "),
    (("effective",), "o_custkey % 10 <> 0", "Effective date: {d}. "),
    (("parties", "duration", "scope", "price"), "o_custkey % 11 <> 0", "Parties: Works and Lee. Duration: 12 months. Scope: Supply. Price: $99.00. "),
    (("issuer", "holder"), "o_custkey % 12 <> 0", "Issued by: Board. Issued to: Anna Lee. "),
    (("signature",), "o_custkey % 13 <> 0", "Signed by A. Clerk. "),
    (("term",), "o_custkey % 14 <> 0", "2/10 net 30. "),
    (("vague",), "o_custkey % 15 = 0", "Services rendered. "),
    (("expiry",), "o_custkey % 2 = 1", "Valid until {d}. "),
]
WHEN = {kind: f"({when})" for kinds, when, _ in PLANTED for kind in kinds}
NUMBERED = "o_custkey % 19 <> 0"


def planted(day: str, kinds: str) -> str:
    """SQL of documents with planted fields, and the keys that say which."""
    texts = [(when, "concat('" + text.replace("{d}", f"', {day}, '") + "')") for _, when, text in PLANTED]
    parts = ", ".join(f"CASE WHEN {when} THEN {text} ELSE '' END" for when, text in texts)
    return f"SELECT o_orderkey AS doc_id, o_custkey, {day} AS day, {kinds} AS document_type, CASE WHEN {NUMBERED} THEN concat('DOC-', CAST(o_orderkey AS STRING)) END AS document_number, concat({parts}) AS text FROM orders"


LACKING_SQL = " ".join(f"WHEN '{kind}' THEN concat_ws(', ', CASE WHEN NOT ({NUMBERED}) THEN 'number' END, " + ", ".join(f"CASE WHEN NOT {WHEN[k]} THEN '{k}' END" for k in fields) + ")" for kind, fields in REQUIRED.items())
BAD_DAY = f"day > '{AS_OF}' OR ({WHEN['expiry']} AND day < '{AS_OF}')"
BAD_WORDS = f"CASE WHEN day > '{AS_OF}' THEN day ELSE 'Valid until ' || day END"
BILLED = f"({BILLING_SQL} OR kind = 'receipt')"


@query(f"""WITH d AS (SELECT *, document_type AS kind FROM ({planted("strftime(o_orderdate, '%Y-%m-%d')", f"({list(KINDS)})[o_orderkey % {len(KINDS)} + 1]")})),
m AS (SELECT *, CASE kind {LACKING_SQL} END AS lacking FROM d)
SELECT doc_id AS doc_key, 'R002' AS rule_id, true AS mandatory, true AS applies, lacking = '' AS complies, CASE WHEN lacking = '' THEN '' ELSE 'lacks ' || lacking END AS evidence FROM m
UNION ALL SELECT doc_id, 'R005', false, true, NOT ({BAD_DAY}), CASE WHEN {BAD_DAY} THEN 'date: ' || {BAD_WORDS} ELSE '' END FROM d
UNION ALL SELECT doc_id, 'R009', true, {BILLING_SQL}, NOT {BILLING_SQL} OR {WHEN['term']}, CASE WHEN NOT {BILLING_SQL} THEN '' WHEN {WHEN['term']} THEN 'term: 2/10 net 30' ELSE 'no term' END FROM d
UNION ALL SELECT doc_id, 'R010', true, {BILLED}, NOT {BILLED} OR ({WHEN['tax']} AND {WHEN['tax_id']}) OR {WHEN['exemption']}, CASE WHEN NOT {BILLED} THEN '' WHEN {WHEN['exemption']} THEN 'exemption: Exempt under Clause 7'
 ELSE CASE WHEN {WHEN['tax']} THEN 'tax: VAT 10 % $9.00' ELSE 'no tax' END || '; ' || CASE WHEN {WHEN['tax_id']} THEN 'tax_id: VAT ID: 77' ELSE 'no tax_id' END END FROM d""")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R002, R005, R009 and R010 by typed fields, on documents of six types with fields planted or left out."""
    kinds = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + f"), CAST(o_orderkey % {len(KINDS)} AS INT) + 1)"
    written = planted("date_format(o_orderdate, 'yyyy-MM-dd')", kinds).replace("FROM orders", "FROM {orders}")
    docs = spark.sql(written, orders=dealt(table(spark, sf_dir, "orders"), "o_orderkey"))
    return field_findings(docs, AS_OF).where("rule_id IN ('R002', 'R005', 'R009', 'R010')")
