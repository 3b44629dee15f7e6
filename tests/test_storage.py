"""Where intermediate tables go."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

from tessella import storage

ROOT = str(Path(__file__).resolve().parent.parent)
PLAIN = """
from pyspark.sql import SparkSession
from tessella import storage
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
one, two = storage.stored(spark.range(3)), storage.stored(spark.range(4))
assert (one.count(), two.count()) == (3, 4) and spark.conf.get("spark.checkpoint.dir", None) is None
storage.discard(one)
print("root", storage._LOCAL[0])
"""


def test_a_plain_local_session(tmp_path):
    """No site settings and no spark.checkpoint.dir: tables go to a temporary folder that is gone afterwards."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", PLAIN], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert not os.path.exists(next(x for x in out.stdout.split("\n") if x.startswith("root")).split(" ")[1])


def test_shared_folder_is_the_sessions(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    path = storage.shared_dir(spark)
    assert before is None or path.split("/tessella-")[0].rstrip("/").endswith(before.rstrip("/").removeprefix("file:").lstrip("/"))
