"""The library on a cluster whose executors can't see the driver's folder."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"

RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
e._shipped = e._sent  # the branch of a cluster
first = e.queries()["g14_steps_by_bands"](spark, {data!r}).count()
again = e.queries()["g14_steps_by_bands"](spark, {data!r}).count()
assert sum(name.startswith("perfusia-") for name in spark.sparkContext._python_includes) == 1
print("rows", first, again)
spark.stop()
"""


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_executors_get_the_library(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    (tmp_path / "elsewhere").mkdir()
    code = RUN.format(root=str(ROOT), shared=f"file://{tmp_path}/shared", data=DATA)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "elsewhere", env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    first, again = done.stdout.split("rows")[-1].split()
    assert first == again == "32000"
