from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", __spark_entry__.queries()["op5_line_dedup"](spark, "/root/testdata/sf0.001").count())
"""


def test_executors_find_the_package_wherever_the_driver_starts(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(Path(__file__).resolve().parents[2]))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 200" in done.stdout, done.stderr[-2000:]
