"""The twelve rules as column expressions, grouped aggregates and joins over a whole batch.

Business tables stand for documents: an order is an invoice, its lineitems are the
lines, the customer buys and the supplier sells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.shared import join_counted, stored

CENT = 0.01
MAX_JUNK, MIN_CHARS = 0.1, 50
CURRENCIES = "[$€£¥₹]"


def money(c: str, scale: int = 2) -> Column:
    return F.col(c).cast(f"decimal(12,{scale})")


def legibility(docs: DataFrame) -> DataFrame:
    """R001: the share of characters that are neither letter, digit nor space."""
    n = F.length("text")
    junk = F.regexp_count("text", F.lit(r"[^\p{L}\p{N}\s]"))
    share = F.when(n > 0, junk.cast("double") / n.cast("double")).otherwise(1.0)
    return docs.select("doc_id", n.cast("long").alias("chars"), junk.cast("long").alias("junk"), (share.isNotNull() & (share <= MAX_JUNK) & (n >= MIN_CHARS)).alias("complies"))


def line_facts(lineitem: DataFrame) -> DataFrame:
    """One row per invoice with what R003, R005, R008 and R010 need of its lines.

    Dealt by invoice once: both the grouping by line number, which counts repeats without
    a set for each invoice, and the grouping by invoice keep that partitioning.
    """
    gross = money("l_extendedprice") * (1 - money("l_discount")) * (1 + money("l_tax"))
    lines = lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", gross.alias("g"), (F.col("l_tax") == 0).alias("free"))
    per_number = lines.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("g"), F.min("l_shipdate").alias("ship"), F.count_if("free").alias("free"))
    return per_number.groupBy("l_orderkey").agg(F.sum("n").alias("lines"), F.sum("g").alias("gross"), F.min("ship").alias("first_ship"), F.sum("free").alias("untaxed"), (F.sum("n") - F.count(F.lit(1))).alias("repeated"))


def line_sums(lineitem: DataFrame) -> DataFrame:
    """(l_orderkey, gross): the sum of each invoice's lines, added up before the shuffle."""
    gross = money("l_extendedprice") * (1 - money("l_discount")) * (1 + money("l_tax"))
    return lineitem.groupBy("l_orderkey").agg(F.sum(gross).alias("gross"))


def invoice_findings(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One row per invoice and rule: (doc_key, rule_id, mandatory, complies).

    A rule that does not apply, for lack of lines, is complied with; that is R002's to say.
    """
    d = orders.join(line_facts(lineitem), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.col("lines").isNull()
    checks = [
        ("R002", True, ~none),
        ("R003", True, none | (F.abs(money("o_totalprice") - F.col("gross")) <= CENT)),
        ("R005", False, none | (F.col("first_ship") >= F.col("o_orderdate"))),
        ("R008", False, none | (F.col("repeated") == 0)),
        ("R010", True, none | (F.col("untaxed") == 0)),
    ]
    rows = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(m).alias("mandatory"), F.coalesce(c, F.lit(False)).alias("complies")) for r, m, c in checks])
    return d.select(F.col("o_orderkey").alias("doc_key"), F.inline(rows))


def missing_lines(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """R002: invoices without a line."""
    return orders.join(lineitem.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


def line_amounts(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """R003, lines: quantity times list price against the stated amount."""
    expected = money("l_quantity") * money("p_retailprice")
    d = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    off = money("l_extendedprice") - expected
    return d.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.count_if(off != 0).alias("wrong_lines"), F.sum(off).cast("double").alias("overstated"))


def rollup_amounts(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """R003, totals: the stated total against the sum of the lines."""
    d = orders.join(line_sums(lineitem), F.col("o_orderkey") == F.col("l_orderkey"))
    off = money("o_totalprice") - F.col("gross")
    return d.select("o_orderkey", F.col("gross").cast("double").alias("gross"), off.cast("double").alias("overstated"), (F.abs(off) <= CENT).alias("complies"))


def invoice_arithmetic(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """R003 on stated figures: every line, the subtotal of right lines, tax within a cent, grand total."""
    right = F.col("quantity") * F.col("unit_price")
    sums = lines.groupBy("doc_id").agg(F.count_if(F.col("line_total") != right).alias("wrong_lines"), F.sum(right).alias("expected"))
    d = heads.join(sums, "doc_id")
    tax = F.col("subtotal") * F.col("rate") / 100
    return d.select(
        "doc_id", "wrong_lines",
        (F.col("subtotal") == F.col("expected")).alias("subtotal_ok"),
        (F.abs(F.col("tax") - tax) <= CENT).alias("tax_ok"),
        (F.col("grand") == F.col("subtotal") + F.col("tax") - F.col("discount")).alias("grand_ok"),
    ).withColumn("complies", (F.col("wrong_lines") == 0) & F.col("subtotal_ok") & F.col("tax_ok") & F.col("grand_ok"))


def date_order(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """R005: lines shipped before their order."""
    d = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate")
    return d.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("early_lines"), F.max(F.datediff("o_orderdate", "l_shipdate")).cast("long").alias("most_days"))


def outside_period(orders: DataFrame, start: str, end: str) -> DataFrame:
    """R005: invoices dated outside the audited period [start, end)."""
    return orders.where(~((F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz")))).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"))


def currencies(docs: DataFrame) -> DataFrame:
    """R006: the currency signs of each text; several need a stated rate."""
    signs = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({CURRENCIES})"), 1)))
    d = docs.select("doc_id", "text", signs.alias("signs")).where(F.size("signs") > 0)
    return d.select("doc_id", F.concat_ws("", "signs").alias("signs"), ((F.size("signs") == 1) | F.col("text").rlike("(?i)(conversion|exchange) rate")).alias("complies"))


def parties(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """R007: buyers of invoices without a name, a country or a region; countries are few."""
    place = F.broadcast(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"), "left"))
    d = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(place, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    complete = F.coalesce(F.col("c_name") != "", F.lit(False)) & F.col("n_name").isNotNull() & F.col("r_name").isNotNull()
    return d.groupBy(F.coalesce("r_name", F.lit("?")).alias("region")).agg(F.count(F.lit(1)).alias("invoices"), F.count_if(complete).alias("complete"))


def repeated_numbers(lineitem: DataFrame) -> DataFrame:
    """R008: line numbers that an invoice uses more than once."""
    return lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")


def number_gaps(keys: DataFrame) -> DataFrame:
    """R008: the whole numbers (column: number) after which the next is missing, the greatest apart."""
    k = keys.select("number").distinct()
    ends = k.join(k.select((F.col("number") - 1).alias("number")), "number", "left_anti")
    last = k.agg(F.max("number").alias("last"))  # one row
    return ends.join(F.broadcast(last), F.col("number") < F.col("last")).select(F.col("number").alias("after"))


def tax_breakdown(lineitem: DataFrame) -> DataFrame:
    """R010: lines and net amounts of each tax rate."""
    net = money("l_extendedprice") * (1 - money("l_discount"))
    return lineitem.groupBy("l_tax").agg(F.count(F.lit(1)).alias("lines"), F.sum(net).cast("double").alias("net"), F.sum((net * money("l_tax"))).cast("double").alias("tax"), (F.col("l_tax") > 0).alias("taxed"))


# ---------------------------------------------------------------- rules on document texts

SIGNED_TYPES = ("contract", "certificate", "delivery_challan")
BILLING_TYPES = ("invoice", "purchase_order")


def text_findings(docs: DataFrame) -> DataFrame:
    """R004, R006, R007, R009 and R011 on (doc_id, document_type, document_number, text); inapplicable rules comply."""
    t, kind = F.lower("text"), F.col("document_type")
    signs = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({CURRENCIES})"), 1)))
    checks = [
        ("R004", ~kind.isin(*SIGNED_TYPES) | t.rlike("signed by|signature:")),
        ("R006", (signs <= 1) | t.rlike("(conversion|exchange) rate")),
        ("R007", ~kind.isin(*BILLING_TYPES) | (t.rlike("[0-9]+ [a-z]+ (street|road|avenue)") & t.rlike("tax id"))),
        ("R009", ~kind.isin(*BILLING_TYPES) | t.rlike("net [0-9]+|due (on|by|date)")),
        ("R011", ~t.rlike("(miscellaneous|various items|sundries)")),
    ]
    return docs.select("doc_id", F.inline(F.array(*[F.struct(F.lit(r).alias("rule_id"), c.alias("complies")) for r, c in checks])))


#: Words that each type's fields are known by; every field must occur.
FIELDS = {
    "invoice": ("date", "seller", "buyer", "subtotal", "tax", "total"),
    "receipt": ("date", "seller", "buyer", "subtotal", "tax", "total"),
    "purchase_order": ("date", "vendor", "quantity", "delivery date", "net [0-9]+|due (on|by|date)"),
    "delivery_challan": ("date", "supplier", "receiver", "quantity", "signed by|signature:"),
    "contract": ("parties", "effective date", "term", "scope", "price", "signed by|signature:"),
    "certificate": ("date", "issued by", "issued to", "signed by|signature:"),
}
NUMBER_FORMAT = "^[A-Z]+-[0-9]+$"
TAX_NAMES, TAX_RATE, TAX_ID = "gst|vat|sales tax", "[0-9]+ ?%", "tax id"
EXEMPTION = "exempt.*(certificate|clause)"
VALID_UNTIL = "valid until ([0-9]{4}-[0-9]{2}-[0-9]{2})"


def text_audit(docs: DataFrame, as_of: str) -> DataFrame:
    """Eleven rules, all but R003, on (doc_id, document_type, document_number, text).

    One row per row of docs and rule: (doc_key, rule_id, mandatory, applies, complies).
    Nulls in text or type count as empty and unknown; a document without a number has a
    wrong format; rows with equal or null doc_id are judged each.  Expiry is judged as of a day, yyyy-MM-dd.
    Texts are judged where they are read; what the batch says of a number joins narrow rows.
    """
    d = docs.select("doc_id", F.coalesce("document_type", F.lit("unknown")).alias("kind"), "document_number", F.coalesce("text", F.lit("")).alias("text"))
    t, kind = F.lower("text"), F.col("kind")
    n, junk = F.length("text"), F.regexp_count("text", F.lit(r"[^\p{L}\p{N}\s]"))
    billing, signed = kind.isin(*BILLING_TYPES), kind.isin(*SIGNED_TYPES)
    signs = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({CURRENCIES})"), 1)))
    complete = F.lit(True)
    for name, fields in FIELDS.items():
        every = F.lit(True)
        for field in fields:
            every = every & t.rlike(field)
        complete = F.when(kind == name, every).otherwise(complete)
    expiry = F.regexp_extract(t, VALID_UNTIL, 1)
    taxed = t.rlike(TAX_NAMES) & t.rlike(TAX_RATE) & t.rlike(TAX_ID)
    everywhere = F.lit(True)
    checks = [
        ("R001", True, everywhere, (n >= MIN_CHARS) & (junk.cast("double") <= MAX_JUNK * n)),
        ("R002", True, kind.isin(*FIELDS), complete),
        ("R004", True, signed, t.rlike("signed by|signature:")),
        ("R005", False, kind == "certificate", (expiry == "") | (expiry >= as_of)),
        ("R006", True, signs > 0, (signs == 1) | t.rlike("(conversion|exchange) rate")),
        ("R007", True, billing, t.rlike("[0-9]+ [a-z]+ (street|road|avenue)") & t.rlike(TAX_ID)),
        ("R008", False, everywhere, F.coalesce(F.col("document_number").rlike(NUMBER_FORMAT), F.lit(False))),
        ("R009", True, billing, t.rlike("net [0-9]+|due (on|by|date)")),
        ("R010", True, billing | (kind == "receipt"), taxed | t.rlike(EXEMPTION)),
        ("R011", False, everywhere, ~t.rlike("(miscellaneous|various items|sundries)")),
        ("R012", False, t.contains("attached "), everywhere),
    ]
    rows = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(m).alias("mandatory"), a.alias("applies"), c.alias("complies")) for r, m, a, c in checks])
    narrow = stored(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "document_number", attached(F.col("text")).alias("wanted"), rows.alias("rules")), "judged")
    uses = stored(narrow.where("document_number IS NOT NULL").groupBy("document_number").agg(F.count(F.lit(1)).alias("uses")), "uses")
    repeated = join_counted(narrow.select("row", "document_number"), uses.where("uses > 1"), ["document_number"], "uses").select("row", F.lit(True).alias("repeated"))
    wanted = narrow.select("row", F.explode("wanted").alias("document_number"))
    lacking = wanted.join(uses, "document_number", "left_anti").select("row").distinct().withColumn("lacking", F.lit(True))
    whole = narrow.join(repeated, "row", "left").join(lacking, "row", "left")
    batch = F.when(F.col("rule_id") == "R008", F.col("complies") & F.col("repeated").isNull()).when(F.col("rule_id") == "R012", F.col("lacking").isNull()).otherwise(F.col("complies"))
    return whole.select(F.col("doc_id").alias("doc_key"), "repeated", "lacking", F.inline("rules")).select("doc_key", "rule_id", "mandatory", "applies", batch.alias("complies"))


def arithmetic_evidence(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """R003 of each invoice that fails it: the numbers, and over- or understatement, in words."""
    off = F.col("overstated")
    shown = lambda c: F.abs(c.cast("decimal(18,2)")).cast("string")
    said = F.concat(F.lit("stated total "), shown(F.col("o_totalprice")), F.lit(", sum of lines "), shown(F.col("gross")), F.when(off > 0, ", overstated by ").otherwise(", understated by "), shown(off))
    d = orders.join(line_sums(lineitem), F.col("o_orderkey") == F.col("l_orderkey"))
    d = d.select("o_orderkey", money("o_totalprice").alias("o_totalprice"), F.col("gross").cast("decimal(18,2)").alias("gross"))
    return d.withColumn("overstated", F.col("o_totalprice") - F.col("gross")).where(F.abs("overstated") > CENT).select("o_orderkey", said.alias("evidence"))


def attached(text: Column) -> Column:
    """The numbers that a text calls attached."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"attached ([A-Z]+-[0-9]+)"), 1))


def missing_attachments(docs: DataFrame) -> DataFrame:
    """R012: numbers that a text calls attached and no document of the batch has."""
    wanted = docs.select("doc_id", F.explode(attached(F.col("text"))).alias("wanted"))
    return wanted.join(docs.select(F.col("document_number").alias("wanted")), "wanted", "left_anti").select("doc_id", "wanted")
