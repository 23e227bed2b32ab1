"""Typed fields of documents, and the rules that ask for them, with the words that they found."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions import fields as grammar
from auditlake.operators.rules import BILLING_TYPES, SIGNED_TYPES

FLAT = "kind string, value string, start int, `end` int, weight double"
FOUND = f"array<struct<{FLAT}>>"
KINDS = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())


def with_fields(docs: DataFrame) -> DataFrame:
    """docs with fields, an array of kind, value, start, end (in characters) and weight; a null text has none."""

    @F.arrow_udf(FOUND)
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = [grammar.fields(t or "") for t in batch.to_pylist()]
            columns = zip(*chain.from_iterable(rows), strict=True) if any(rows) else [[]] * 5
            parts = [pa.array(x, kind) for x, kind in zip(columns, KINDS, strict=True)]
            yield pa.ListArray.from_arrays(pa.array(accumulate(map(len, rows), initial=0), pa.int32()), pa.StructArray.from_arrays(parts, grammar.Field._fields))

    return docs.withColumn("fields", found(F.col("text")))


def header_fields(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, value, start, end, weight, evidence): one row for each field, with the words that say it."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(f"{FLAT}, evidence string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = grammar.fields(text or "")
                at += [k] * len(found)
                rows += [(*f, text[f.start : f.end]) for f in found]
            for lo in range(0, len(rows), 10_000):
                columns = zip(*rows[lo : lo + 10_000], strict=True)
                parts = [pa.array(x, kind) for x, kind in zip(columns, (*KINDS, pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[lo : lo + 10_000])), *parts], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


SAID = "struct<first:map<string,string>,dates:array<struct<kind:string,value:string,words:string>>>"
DATED = ("date", "effective", "expiry")


def said_in(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of each text the words of the first field of each kind, and its dates in order."""
    put = lambda values: pa.array(values, pa.string())
    places = lambda rows: pa.array(accumulate(map(len, rows), initial=0), pa.int32())
    for batch in texts:
        first, dates = [], []
        for text in batch.to_pylist():
            found = [(f.kind, f.value, text[f.start : f.end]) for f in grammar.fields(text)]
            first.append({kind: words for kind, _, words in reversed(found)})
            dates.append([x for x in found if x[0] in DATED])
        said = pa.MapArray.from_arrays(places(first), put(list(chain.from_iterable(first))), put([w for x in first for w in x.values()]))
        days = pa.StructArray.from_arrays([put([x[k] for row in dates for x in row]) for k in range(3)], ["kind", "value", "words"])
        yield pa.StructArray.from_arrays([said, pa.ListArray.from_arrays(places(dates), days)], ["first", "dates"])


#: The fields that a document of each type must have, beside its number.
REQUIRED = {
    "invoice": ("date", "seller", "buyer", "quantity", "subtotal", "tax", "total"),
    "receipt": ("date", "seller", "buyer", "quantity", "subtotal", "tax", "total"),
    "purchase_order": ("date", "seller", "quantity", "delivery", "term"),
    "delivery_challan": ("date", "seller", "buyer", "quantity", "signature"),
    "contract": ("parties", "effective", "duration", "scope", "price", "signature"),
    "certificate": ("date", "issuer", "holder", "signature"),
}


def field_findings(docs: DataFrame, as_of: str = "9999-12-31", since: str = "0001-01-01") -> DataFrame:
    """R002, R004, R005, R007, R009, R010 and R011 of documents (doc_id, document_type, document_number, text) by their fields.

    One row for each row of docs and rule: (doc_key, rule_id, mandatory, applies, complies, evidence).  The
    evidence is what was found, the first of each kind, or what is lacking; a rule that does
    not apply is complied with.

    * R002: a number and the fields of its type.  R004: a signature.  R007: an address and a tax id.
    * R005: every date is one of the calendar, from since to as_of, and none has expired; days are yyyy-MM-dd.
    * R009: a term of payment.  R010: a tax with rate and amount and a tax id, or an exemption.  R011: nothing vague.
    """
    number = F.col("document_number") if "document_number" in docs.columns else F.lit("-")
    d = docs.select("doc_id", number.alias("number"), F.coalesce("document_type", F.lit("unknown")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "number", "kind", F.arrow_udf(said_in, SAID)("text").alias("said"))

    def said(kind: str) -> Column:
        return F.try_element_at("said.first", F.lit(kind))

    def wanted(*kinds: str) -> tuple[Column, Column]:
        complies, evidence = F.lit(True), []
        for k in kinds:
            complies = complies & said(k).isNotNull()
            evidence.append(F.coalesce(F.concat(F.lit(f"{k}: "), said(k)), F.lit(f"no {k}")))
        return complies, F.concat_ws("; ", *evidence)

    billing, signed, kind = F.col("kind").isin(*BILLING_TYPES), F.col("kind").isin(*SIGNED_TYPES), F.col("kind")
    numbered, missing = F.coalesce(F.col("number") != "", F.lit(False)), F.lit("")
    for name, kinds in REQUIRED.items():
        missing = F.when(kind == name, F.concat_ws(", ", F.when(~numbered, "number"), *[F.when(said(k).isNull(), k) for k in kinds])).otherwise(missing)
    day = lambda f: F.try_to_date(f["value"], "yyyy-MM-dd")
    first, last = F.lit(since).cast("date"), F.lit(as_of).cast("date")
    bad = F.filter("said.dates", lambda f: F.when(f["kind"] == "expiry", F.coalesce(day(f) < last, F.lit(True))).otherwise(F.coalesce(~day(f).between(first, last), F.lit(True))))
    # what several rules or columns ask for is found once
    d = d.withColumns({"missing": missing, "bad": F.get(bad, 0)})
    whole, lacking = F.col("missing") == "", F.when(F.col("missing") != "", F.concat(F.lit("lacks "), F.col("missing"))).otherwise("")
    taxed, tax_words = wanted("tax", "tax_id")
    exempt, vague = said("exemption"), said("vague")
    checks = [
        ("R002", True, kind.isin(*REQUIRED), whole, lacking), ("R004", True, signed, *wanted("signature")),
        ("R005", False, F.size("said.dates") > 0, F.col("bad").isNull(), F.coalesce(F.concat(F.lit("date: "), F.col("bad.words")), F.lit(""))),
        ("R007", True, billing, *wanted("address", "tax_id")), ("R009", True, billing, *wanted("term")),
        ("R010", True, billing | (kind == "receipt"), taxed | exempt.isNotNull(), F.coalesce(F.concat(F.lit("exemption: "), exempt), tax_words)),
        ("R011", False, F.lit(True), vague.isNull(), F.coalesce(F.concat(F.lit("vague: "), vague), F.lit(""))),
    ]
    rows = [F.struct(F.lit(r).alias("rule_id"), F.lit(m).alias("mandatory"), a.alias("applies"), (c | ~a).alias("complies"), F.when(a, e).otherwise("").alias("evidence")) for r, m, a, c, e in checks]
    return d.select(F.col("doc_id").alias("doc_key"), F.inline(F.array(*rows)))
