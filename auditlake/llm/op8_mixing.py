"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target divided by its size gives the same number of copies for all its
documents; the whole part is taken from each, the fraction is rounded.  Two
fractional documents at a time pass words from one to the other, at random and
without changing the expected copies of either, until one of them is at none or one
more copy.  Groups of documents reduce to one fractional document each, and a tree
of further groups reduces those.  Each source keeps back a few dozen documents for
the root of its tree.  There each document, the largest first, is paired with all that
come after it as one: it is drawn with its fraction, and the rest make up for it in
equal shares, so that their expected copies stay the same too.  Only where the rest are
too small to make up for one of the outcomes, as for the last and smallest ones, the
other outcome is taken, and the nearer one where they are too small for both.

Defined cases: null or empty text has size 0 and takes 0; a null source is a source,
placed last; sources of size 0 have target 0; repeated rows are taken together, each as
often; an empty table gives an empty result; columns other than doc_id, text and source
are ignored.  All draws are hashes of the document and a seed, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import WORD, documents, fresh, stored

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
#: Documents in a group of the tree, on average.
FAN_IN = 32
#: Documents of a source that join at the root, on average.
RESERVE = 48
SEED = 8


def text_key(text: str | Column = "text") -> Column:
    """Tells documents of one doc_id apart."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def sizes(docs: DataFrame) -> DataFrame:
    """Distinct documents: size, in words, of all `same` rows that repeat one."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), text_key().alias("draw"))
    return rows.groupBy("doc_id", "source", "draw").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("same"))


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: source_size, docs, target.  The windows run over sources, not documents.

    Raising a common level until the targets add up to the total, each stopped at its
    limit, is where resharing the excess ends.  With the sources in order of limit per
    weight, the level grows while each next source is above its limit.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((place - 1) % len(WEIGHTS) + 1).cast("int")))
    per = per.withColumn("limit", MAX_COPIES * F.col("source_size"))
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("_level", rest.cast("double") / weights)
    level = F.max("_level").over(everything)
    return per.select("source", "source_size", "docs", F.least(F.col("limit").cast("double"), F.col("weight") * level).alias("target"))


def draw(*what: Column) -> Column:
    """Uniform in [0, 1), the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *what), 11).cast("double") / float(1 << 53)


UNIT = "struct<doc_id:bigint,draw:bigint,size:bigint,same:bigint,part:double>"


def settle(units: Column) -> Column:
    """Folds an array of fractional units (doc_id, draw, size, same, part) into done units and at most one that is left."""
    shape = UNIT
    start = F.struct(F.lit(None).cast(shape).alias("left"), F.array().cast(f"array<{shape}>").alias("done"))

    def step(state: Column, b: Column) -> Column:
        a = state["left"]
        room_a, room_b = (1 - a["part"]) * a["size"], (1 - b["part"]) * b["size"]
        mass_a, mass_b = a["part"] * a["size"], b["part"] * b["size"]
        up, down = F.least(room_a, mass_b), F.least(mass_a, room_b)
        gain = draw(a["doc_id"], a["draw"], b["doc_id"], b["draw"]) * (up + down) < down
        # the unit that reaches its bound is set to it exactly
        part_a = F.when(gain, F.when(room_a <= mass_b, 1.0).otherwise(a["part"] + up / a["size"])).otherwise(F.when(mass_a <= room_b, 0.0).otherwise(a["part"] - down / a["size"]))
        part_b = F.when(gain, F.when(mass_b <= room_a, 0.0).otherwise(b["part"] - up / b["size"])).otherwise(F.when(room_b <= mass_a, 1.0).otherwise(b["part"] + down / b["size"]))
        pair = F.array(a.withField("part", part_a), b.withField("part", part_b))
        fractional = lambda x: (x["part"] > 0) & (x["part"] < 1)
        moved = F.struct(F.get(F.filter(pair, fractional), F.lit(0)).alias("left"), F.concat(state["done"], F.filter(pair, lambda x: ~fractional(x))).alias("done"))
        return F.when(a.isNull(), F.struct(b.alias("left"), state["done"].alias("done"))).otherwise(moved)

    return F.aggregate(units, start, step)


def settle_all(left: Column, kept: Column) -> Column:
    """Done units of a source's last fractional one, or null, and of those kept back, which are of one part and in order of size."""
    slack = 1e-9
    size_of = lambda x: x["size"].cast("double")
    mass, size = (F.aggregate(kept, F.lit(0.0), f) for f in (lambda s, x: s + size_of(x) * x["part"], lambda s, x: s + size_of(x)))
    start = F.struct(mass.alias("mass"), size.alias("size"), F.array().cast(f"array<{UNIT}>").alias("done"))

    def step(state: Column, pair: Column) -> Column:
        x, inside = pair["unit"], pair["inside"]
        part = F.when(inside, F.greatest(F.lit(0.0), F.least(F.lit(1.0), state["mass"] / state["size"]))).otherwise(x["part"])
        rest_size = state["size"] - F.when(inside, size_of(x)).otherwise(0.0)
        rest_mass = state["mass"] - F.when(inside, part * x["size"]).otherwise(0.0)
        more, less = (1 - part) * x["size"], part * x["size"]
        can_gain, can_lose = more <= rest_mass + slack, less <= rest_size - rest_mass + slack
        drawn = draw(F.lit("root"), x["doc_id"], x["draw"]) < part
        gain = F.when(can_gain & can_lose, drawn).when(can_gain, True).when(can_lose, False).otherwise(part >= 0.5)
        mass = F.greatest(F.lit(0.0), F.least(rest_size, F.when(gain, rest_mass - more).otherwise(rest_mass + less)))
        done = F.array(x.withField("part", F.when(gain, 1.0).otherwise(0.0)))
        return F.struct(mass.alias("mass"), rest_size.alias("size"), F.concat(state["done"], done).alias("done"))

    of = lambda x, inside: F.struct(x.alias("unit"), F.lit(inside).alias("inside"))
    first = F.when(left.isNotNull(), F.array(of(left, False))).otherwise(F.array().cast(f"array<struct<unit:{UNIT},inside:boolean>>"))
    return F.aggregate(F.concat(first, F.transform(kept, lambda x: of(x, True))), start, step)["done"]


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, draw (its text_key), size, same, source, source_size, target and copies of each distinct document."""
    rows = stored(sizes(docs), "sizes")
    per = targets(rows)
    exact = F.col("target") / F.col("source_size")
    whole = F.floor(exact + 1e-9)
    per = per.withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(F.lit(0))).withColumn("part", F.greatest(F.lit(0.0), F.when(F.col("source_size") > 0, exact - whole).otherwise(0.0)))
    per = stored(per.withColumn("groups", F.greatest(F.lit(1), F.ceil(F.col("docs") / FAN_IN))), "sources")
    own = ["source", "docs", "source_size", "target", "whole"]
    sides = F.broadcast(per) if small(per) else per
    each = rows.join(sides, rows.source.eqNullSafe(per.source)).select("doc_id", "draw", "size", "same", rows.source, F.xxhash64(rows.source, F.isnull(rows.source)).alias("source_key"), *own[1:], "part", "groups")
    result = ["doc_id", "draw", "size", "same", "source", "source_size", "target", "copies"]
    open_ = (F.col("part") > 0) & (F.col("size") > 0)
    settled = each.where(~open_).withColumn("copies", F.col("whole")).select(*result)
    each = each.where(open_).withColumn("group", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "draw"), F.col("groups")))
    kept_back = draw(F.lit("reserve"), F.col("doc_id"), F.col("draw")) * F.col("docs") < RESERVE
    level, reserve = each.where(~kept_back), each.where(kept_back)
    most = per.agg(F.coalesce(F.max("groups"), F.lit(1))).first()[0]
    out = [settled]
    fields = ["doc_id", "draw", "size", "same", "part"]
    same_source = [F.first(c).alias(c) for c in ("groups", *own)]

    def units(which: Column) -> Column:
        found = F.sort_array(F.collect_list(F.when(which, F.struct(-F.col("size"), *fields))))
        return F.transform(found, lambda x: F.struct(*[x[f].alias(f) for f in fields]))

    while most > 1:
        folded = stored(level.groupBy("source_key", "group").agg(*same_source, settle(units(F.lit(True))).alias("s")), "level")
        done = folded.select(*own, F.explode("s.done").alias("u")).select(*own, "u.*")
        out.append(done.withColumn("copies", F.col("whole") + F.col("part").cast("long")).select(*result))
        left = folded.where("s.left is not null").select("source_key", "group", "groups", *own, "s.left.*")
        level = left.withColumn("groups", F.ceil(F.col("groups") / FAN_IN)).withColumn("group", F.pmod(F.col("group"), F.col("groups")))
        most = math.ceil(most / FAN_IN)
    last = level.withColumn("kept", F.lit(False)).unionByName(reserve.withColumn("kept", F.lit(True)))
    last = last.groupBy("source_key").agg(*same_source, settle(units(~F.col("kept"))).alias("s"), units(F.col("kept")).alias("kept"))
    # computed once: the next step names what is left several times
    last = stored(last, "root")
    done = last.select(*own, F.explode(F.concat("s.done", settle_all(F.col("s.left"), F.col("kept")))).alias("u")).select(*own, "u.*")
    out.append(done.withColumn("copies", F.col("whole") + F.col("part").cast("long")).select(*result))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found.withColumn("copies", F.col("copies").cast("long"))


def small(per: DataFrame, rows: int = 10_000) -> bool:
    """Whether a table has few enough rows to be broadcast."""
    return per.limit(rows + 1).count() <= rows


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    key, draw_key, source, copies, copy = (fresh(docs, c) for c in ("_mix_id", "_mix_draw", "_mix_source", "_mix_copies", "_mix_copy"))
    found = mix_sources(docs).where("copies > 0").select(F.col("doc_id").alias(key), F.col("draw").alias(draw_key), F.col("source").alias(source), F.col("copies").alias(copies))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (text_key() == F.col(draw_key)) & docs["source"].eqNullSafe(F.col(source))
    return docs.join(found, same).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copy)).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(documents(spark, sf_dir, "doc_id", "text", "source"))
    each = found.select("*", F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))))
    size = (F.col("size") / F.col("same")).cast("long")
    return each.select("doc_id", size.alias("size"), "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * size).alias("taken"), "copies")
