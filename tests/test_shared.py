"""Joins and references where one key has half of all rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditlake.operators.references import found_references
from auditlake.shared import join_counted, stored


@pytest.fixture
def without_broadcast(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_rows_of_a_hot_key_stay_where_they_are(spark, without_broadcast):
    key = F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.floor(F.col("id") / 4))
    left = stored(spark.range(20000).repartition(4).withColumn("key", key), "left")
    right = stored(left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.max("id") + 1).alias("top")), "right")
    got = join_counted(left, right, ["key"], "n").withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 20000
    assert all(r.n == (10000 if r.key == -1 else 2) for r in got)
    tasks = Counter(r.task for r in got if r.key == -1)
    assert max(tasks.values()) < 4000


def test_a_number_that_half_of_all_texts_mean(spark, without_broadcast):
    data = [(k, f"N-{k}", "see INV 07" if k % 2 else f"see inv-{k + 1}") for k in range(600)]
    data += [(1000 + k, f"INV-{k}", None) for k in range(0, 300)]
    docs = spark.createDataFrame(data, "doc_id long, document_number string, text string")
    got = {r.doc_id: (r.wanted, r.found) for r in found_references(docs, r"see (\S+[ -]\d+)").collect()}
    assert len(got) == 600
    for k in range(600):
        want = "INV-7" if k % 2 else (f"INV-{k + 1}" if k + 1 < 300 else None)
        assert got[k][1] == want
