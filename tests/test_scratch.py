"""Scratch tables in a session that nobody has told a folder."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

_PLAIN = """
from pyspark.sql import SparkSession
from siltstone.functions.scratch import Scratch, purge, scratch_root
from siltstone.operators.graph import jaccard_pairs

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
s = Scratch(spark, "one")
assert s.save(spark.range(5)).count() == 5 and scratch_root(spark).startswith("file:/") and Scratch(spark, "two").save(spark.range(3)).count() == 3
rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c"])], "id long, w array<string>")
assert [tuple(r) for r in jaccard_pairs(rows, "id", "w", 0.9).collect()] == [(1, 2, 1.0)]
purge(spark)
print("done")
"""


def test_scratch_needs_no_configuration(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).parents[1])}
    out = subprocess.run([sys.executable, "-c", _PLAIN], env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and out.stdout.strip().endswith("done"), out.stderr[-2000:]
