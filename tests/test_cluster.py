"""Queries whose driver and executors are different processes."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark
from oracle import SF

ROOT = Path(__file__).resolve().parents[1]
RUN = """
import sys
from pyspark.sql import SparkSession
shared, sf = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{shared}"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
from oracle import compare
from quarry import catalog
for _ in range(2):
    compare(spark, sf, catalog.QUERIES["source_jdbc"], catalog.ORACLE_SQL["source_jdbc"])
print("the same rows")
spark.stop()
"""


def test_database_read_by_executors(tmp_path):
    home, shared = tmp_path / "home", tmp_path / "shared"
    home.mkdir(), shared.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # executors leave their logs in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": f"{ROOT}:{ROOT / 'tests'}", "PYSPARK_PYTHON": sys.executable}
    ran = subprocess.run([sys.executable, "-c", RUN, str(shared), SF], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "the same rows" in ran.stdout, ran.stderr[-3000:]
