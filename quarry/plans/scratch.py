"""A shared folder for tables that a query writes and reads again."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Under the cluster's shared folder; only where none is named, a local one is made and set."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/quarry-scratch/{hashlib.md5(sf_dir.encode()).hexdigest()[:10]}/{name}"
