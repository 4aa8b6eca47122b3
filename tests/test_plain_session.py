"""A local session without spark.checkpoint.dir."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
PROGRAM = """
from pyspark.sql import SparkSession
from spanloom.sources.tables import saved, shared_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert saved(spark.range(3)).count() == 3
assert shared_dir(spark) == shared_dir(spark)
print("saved")
"""


def test_tables_are_saved_without_the_setting(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", PROGRAM], env=env, capture_output=True, text=True, timeout=200)
    assert done.stdout.strip().endswith("saved"), done.stderr[-2000:]
