"""The shared folder, joins and places that do not depend on how rows are spread."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys that may be hot enough to be joined by broadcast.
HEAVY = 1000


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="auditlake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def open_store(uri: str):
    """(file system, path) of a path that tasks reach."""
    from pyarrow import fs

    # some paths come with one slash after the colon
    uri = re.sub("^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df over all cores by a key that few rows share, however few files or parts of a file it lies in."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str) -> DataFrame:
    """left.join(right, on) where right has one row of fixed width for each key of left, and how many rows it is for.

    Keys that more than a thousandth of left's rows have, fewer than HEAVY by that rule,
    are broadcast, and their rows stay where they are; all others are shuffled.  Both
    tables are read twice, so they should be stored.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * HEAVY > F.lit(total)
    few = F.broadcast(right.where(heavy))
    return left.join(few, on).unionByName(left.join(few.select(on), on, "left_anti").join(right.where(~heavy), on))


def positions(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """df with at, each row's place in its group from 0 by the columns of order, and n, the rows of the group.

    Rows are dealt by ranges of (group, order), so that no task holds a group; only the
    counts of each group in each range are added up.  Columns of group are never null, and
    df, which is read twice, should be stored.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())
    ranged = stored(ranged, "ranged").withColumn("_range", F.shiftright("_row", 33))
    counts = ranged.groupBy(*group, "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stored(counts.select(*group, "_range", "_rows", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n")), "ranges")
    return join_counted(ranged, counts, [*group, "_range"], "_rows").select(*df.columns, (F.col("_row") + F.col("_shift")).alias("at"), "n")
