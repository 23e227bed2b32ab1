"""A report that runs along with a folder: after every batch it is that of all files as they are then.

Each document has a keyed state with its last result.  A file that comes again gives its new
result and takes the old one back, so that the run's count, mean and squared deviation can be
merged without reading any result again.  What they are after a batch is written under
the batch's number; a batch that is run again writes the same.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditlake.functions.replies import decode_replies
from auditlake.operators.extract import Calls, extracted
from auditlake.operators.scoring import merged, moments, report_of_moments
from auditlake.schemas import SUFFIXES
from auditlake.sources.files import described, or_empty
from auditlake.sources.folder import register

MOMENTS = "sign int, n long, ok long, mean double, m2 double"


def changes(results: DataFrame) -> DataFrame:
    """(doc_key, passed, score, sign): new results, and with sign -1 those that they replace; results is a stream."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # of several results in a batch the last by time counts
        last = pd.concat(list(batches)).sort_values(["modified", "score", "passed"]).iloc[-1]
        rows = [(key[0], *state.get, -1)] if state.exists else []
        new = (bool(last["passed"]), float(last["score"]))
        state.update(new)
        yield pd.DataFrame([*rows, (key[0], *new, 1)], columns=["doc_key", "passed", "score", "sign"])

    return results.groupBy("doc_key").applyInPandasWithState(update, "doc_key string, passed boolean, score double, sign int", "passed boolean, score double", "append", GroupStateTimeout.NoTimeout)


def run_report(spark: SparkSession, folder: str, read: Callable[..., str], out: str, checkpoint: str, calls: Calls = Calls()) -> StreamingQuery:
    """Reads every file that is new or was replaced since the last run, and brings the moments in out up to date."""
    register(spark)
    files = described(spark.readStream.format("document_folder").option("suffixes", ",".join(SUFFIXES)).load(folder))
    # the time goes along in the key, for a path may come twice in a batch
    named = files.withColumn("path", F.to_json(F.struct("path", F.unix_micros("modificationTime").alias("time"))))
    plain = lambda path, content: read(json.loads(path)["path"], content)
    key = F.from_json("doc_key", "path string, time long")
    results = decode_replies(extracted(named, plain, calls)).select(key["path"].alias("doc_key"), key["time"].alias("modified"), "passed", "score")

    def merge(batch: DataFrame, number: int) -> None:
        new = moments(batch, (), F.col("sign"))
        before = known(spark, out, number - 1)
        merged(before.unionByName(new), ()).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return changes(results).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def known(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """The moments after the last batch, or the last up to a number; no rows before the first."""
    kept = or_empty(spark, lambda: spark.read.schema(f"{MOMENTS}, batch long").parquet(out), f"{MOMENTS}, batch long")
    kept = kept if upto is None else kept.where(F.col("batch") <= upto)
    last = kept.agg(F.max("batch").alias("batch"))
    return kept.join(F.broadcast(last), "batch").drop("batch")  # one row


def current_report(spark: SparkSession, out: str, title: str | None = None) -> DataFrame:
    """The report after the last batch."""
    empty = spark.createDataFrame([(1, 0, 0, 0.0, 0.0)], MOMENTS)
    return report_of_moments(merged(known(spark, out).unionByName(empty), ()), title)
