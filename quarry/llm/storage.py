"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is named (tests), a fresh local one."""
    place = spark.conf.get(KEY, None)
    if not place:
        place = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set(KEY, place)
    return place.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored table.

    It cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    readers of several columns or several consumers don't repeat the work.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Delete this process's stored tables, once no frame that reads them is wanted any more; how many went."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _made:
        place = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(place.getFileSystem(conf).delete(place, True))
    return gone


def tidy(spark: SparkSession) -> None:
    """Let go of the files of finished shuffles: Spark deletes them when the driver's garbage is collected, else rarely."""
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def exchange_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of ``size`` bytes at most: texts are long, and a batch exists on both sides of a worker."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", size), ("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)):
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
