"""Numbers and names that are written inexactly: "INV 3", "inv-03" and "INV-3" are one.

Texts within a small edit distance are joined by positional q-grams: of two such texts, one of
the few rarest grams of each is shared, at almost the same place.  Only pairs that share such a
gram, have almost equal lengths and enough grams in common are measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.shared import join_counted, stored

GRAM = 2
#: Marks beyond both ends of a text, so that its first and last letters have grams of their own.
PAD = "\u0001"


def normal(number: Column) -> tuple[Column, Column]:
    """(letters, digits) of a document number: upper case, without separators and leading zeros."""
    plain = F.upper(F.regexp_replace(number, r"[^\p{L}\p{N}]", ""))
    return F.regexp_replace(plain, r"\p{N}", ""), F.regexp_replace(F.regexp_replace(plain, r"\p{L}", ""), "^0+(?=.)", "")


def grams(text: Column) -> Column:
    """The places and texts of all grams."""
    padded = F.concat(F.lit(PAD * (GRAM - 1)), text, F.lit(PAD * (GRAM - 1)))
    return F.transform(F.sequence(F.lit(1), F.length(text) + GRAM - 1), lambda i: F.struct(padded.substr(i, F.lit(GRAM)).alias("gram"), i.alias("at")))


def similar(left: DataFrame, right: DataFrame, most: int, within: tuple[str, ...] = ()) -> DataFrame:
    """(within..., a, b, distance): texts a of left and b of right at most so many edits apart, equal in the columns of within.

    left and right have a column text and those of within; nulls match nothing, and equal rows
    count once.  A text of up to GRAM * most letters may share no gram with a near one, so
    these are compared by length alone; there are few different ones.  No text is left out for being frequent.
    """
    keys = list(within)
    sides = [stored(d.select(*keys, "text").where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, "text"])).distinct(), "texts") for d in (left, right)]
    # how often a gram occurs on either side; a rare one is a better meeting place
    weight = sides[0].unionByName(sides[1]).select(F.explode(grams(F.col("text"))).alias("g")).groupBy("g.gram").agg(F.count(F.lit(1)).alias("uses"))
    weight = stored(weight, "grams")

    def met(side: DataFrame) -> DataFrame:
        """Each text with the GRAM * most + 1 rarest of its grams: one of them survives so many edits."""
        each = side.select(*keys, "text", F.explode(grams(F.col("text"))).alias("g")).select(*keys, "text", "g.gram", "g.at")
        each = join_counted(each, weight, ["gram"], "uses")  # the prefix of all numbers is a gram of every text
        rare = F.slice(F.sort_array(F.collect_list(F.struct("uses", "gram", "at"))), 1, GRAM * most + 1)  # as long as a text
        return each.groupBy(*keys, "text").agg(rare.alias("rare")).select(*keys, "text", F.explode("rare").alias("x")).select(*keys, "text", F.col("x.gram").alias("gram"), F.col("x.at").alias("at"))

    a = met(sides[0]).withColumnsRenamed({"text": "a", "at": "a_at"})
    b = met(sides[1]).withColumnsRenamed({"text": "b", "at": "b_at"})
    near = (F.abs(F.col("a_at") - F.col("b_at")) <= most) & (F.abs(F.length("a") - F.length("b")) <= most)
    pairs = a.join(b, [*keys, "gram"]).where(near).select(*keys, "a", "b")
    short = F.length("text") <= GRAM * most
    by_length = lambda d, name: d.where(short).select(*keys, F.col("text").alias(name), F.explode(F.sequence(F.greatest(F.lit(0), F.length("text") - most), F.length("text") + most)).alias("size"))
    small = by_length(sides[0], "a").join(sides[1].where(F.length("text") <= (GRAM + 1) * most).select(*keys, F.col("text").alias("b"), F.length("text").alias("size")), [*keys, "size"]).select(*keys, "a", "b")
    shared = F.size(F.array_intersect(F.transform(grams(F.col("a")), lambda g: g["gram"]), F.transform(grams(F.col("b")), lambda g: g["gram"])))
    # a gram that a text has twice counts once on both sides, so that the bound is on different grams
    fewest = F.size(F.array_distinct(F.transform(grams(F.col("a")), lambda g: g["gram"]))) - GRAM * most
    found = pairs.where(shared >= fewest).unionByName(small).distinct()
    return found.withColumn("distance", F.levenshtein("a", "b", most)).where("distance >= 0")


def found_references(docs: DataFrame, pattern: str, most: int = 1) -> DataFrame:
    """(doc_id, wanted, found): what each text refers to by the pattern's first group, and the document number that it means.

    The same digits are asked for, and letters at most so many edits apart; of several the
    nearest, then the first; null if no document of the batch is meant.  docs: doc_id, document_number, text.
    """
    named = lambda c: dict(zip(("letters", "digits"), normal(F.col(c)), strict=True))
    wanted = stored(docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 1))).alias("wanted")).withColumns(named("wanted")), "wanted")
    # numbers that are one after all stand for themselves by the first of them
    numbers = docs.select("document_number").where("document_number IS NOT NULL").withColumns(named("document_number")).groupBy("letters", "digits").agg(F.min("document_number").alias("found"))
    numbers = stored(numbers, "numbers")
    text = F.col("letters").alias("text")
    pairs = similar(wanted.select("digits", text), numbers.select("digits", text), most, ("digits",))
    best = pairs.withColumnRenamed("b", "letters").join(numbers, ["letters", "digits"]).groupBy("digits", F.col("a").alias("letters")).agg(F.min(F.struct("distance", "found")).alias("x"))
    # a third of all texts may refer to one number
    uses = wanted.groupBy("letters", "digits").agg(F.count(F.lit(1)).alias("uses")).join(best, ["letters", "digits"], "left")
    return join_counted(wanted, stored(uses, "meant"), ["letters", "digits"], "uses").select("doc_id", "wanted", F.col("x.found").alias("found"))
