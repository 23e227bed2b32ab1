"""Corpus queries on workers that have no copy of the package."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Only the driver's own path has the package; workers start in an empty folder without it.
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
import __spark_entry__ as e
for name in {names!r}:
    e.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name)
"""


@pytest.mark.parametrize("numbers", [(2, 3, 4, 5), (6, 7, 8, 9), (10, 11, 12, 13)])
def test_queries_run_on_bare_workers(tmp_path, numbers):
    from auditlake.llm.queries import QUERIES

    names = [q for n in numbers for q in QUERIES if q.startswith(f"op{n}_")]
    (tmp_path / "empty").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=REPO, shared=f"file://{tmp_path}/shared", names=names)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path / "empty", env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.split("\n")[:-1] == [f"ran {name}" for name in names], done.stderr[-2000:]
