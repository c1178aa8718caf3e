"""Sources and sinks: every format written and read back, options, modes, inference, custom sources."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quarry.plans.registry import Registry
from quarry.plans.scratch import scratch
from quarry.session import load, register

R = Registry()
NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _place(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{scratch(spark, sf_dir, 'sources')}/{name}"


def _format(kind: str, write: dict, read: dict):
    @R.frame(NATION, name=f"source_{kind}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, n = _place(spark, sf_dir, kind), load(spark, sf_dir, "nation")
        n.write.mode("overwrite").format(kind).options(**write).save(path)
        return spark.read.format(kind).options(**read).schema(n.schema).load(path)

    return query


_format("csv", {"header": "true", "sep": "|", "quote": "'", "nullValue": "-"}, {"header": "true", "sep": "|", "quote": "'", "nullValue": "-"})
_format("json", {"compression": "gzip"}, {"multiLine": "false"})
_format("parquet", {"compression": "zstd"}, {"mergeSchema": "true"})
_format("orc", {}, {})


@R.frame("SELECT n_name AS value FROM nation")
def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, sf_dir, "text")
    load(spark, sf_dir, "nation").select("n_name").write.mode("overwrite").option("lineSep", "\n").text(path)
    return spark.read.text(path)


@R.frame("SELECT 1::BIGINT AS files, count(*) AS lines FROM region")
def source_whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, sf_dir, "whole")
    load(spark, sf_dir, "region").select("r_name").coalesce(1).write.mode("overwrite").text(path)
    return spark.read.text(path, wholetext=True).agg(F.count("*").alias("files"), F.sum(F.length("value") - F.length(F.replace(F.col("value"), F.lit("\n"), F.lit("")))).cast("long").alias("lines"))


@R.frame("SELECT true AS named, true AS sized")
def source_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.read.format("binaryFile").option("pathGlobFilter", "region.parquet").load(sf_dir)
    return b.agg(F.bool_and(F.col("path").endswith("region.parquet")).alias("named"), F.bool_and(F.length("content") == F.col("length")).alias("sized"))


@R.frame("SELECT n_nationkey, n_regionkey::DOUBLE AS label, 2::BIGINT AS filled FROM nation WHERE n_nationkey > 0")
def source_libsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    path = _place(spark, sf_dir, "libsvm")
    n = load(spark, sf_dir, "nation").where("n_nationkey > 0")
    n.select(F.concat_ws(" ", "n_regionkey", F.concat(F.lit("1:"), "n_nationkey"), F.lit("3:7"))).write.mode("overwrite").text(path)
    v = vector_to_array("features")
    return spark.read.format("libsvm").option("numFeatures", 3).load(path).select(v[0].cast("int").alias("n_nationkey"), "label", F.size(F.filter(v, lambda x: x != 0)).cast("long").alias("filled"))


@R.frame("SELECT 'int' AS i, 'double' AS d, 'timestamp' AS t, 'boolean' AS b, 'string' AS s")
def source_csv_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, sf_dir, "inferred")
    spark.createDataFrame([("1,1.5,2020-01-01 00:00:00,true,x",), ("2,2,2020-01-02 00:00:00,false,y",)], "value string").write.mode("overwrite").text(path)
    df = spark.read.csv(path, inferSchema=True, timestampFormat="yyyy-MM-dd HH:mm:ss")
    return spark.createDataFrame([tuple(t for _, t in df.dtypes)], "i string, d string, t string, b string, s string")


@R.frame("SELECT unnest([1, NULL]) AS a, unnest([NULL, 'not json']) AS bad")
def source_corrupt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, sf_dir, "corrupt")
    spark.createDataFrame([('{"a": 1}',), ("not json",)], "value string").write.mode("overwrite").text(path)
    return spark.read.schema("a int, bad string").option("columnNameOfCorruptRecord", "bad").json(path)


@R.frame("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def source_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, sf_dir, "partitioned")
    load(spark, sf_dir, "orders").write.mode("overwrite").partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).where("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@R.frame("SELECT 15::BIGINT AS appended, 5::BIGINT AS ignored, true AS refused")
def source_save_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    path, r = _place(spark, sf_dir, "modes"), load(spark, sf_dir, "region")
    r.write.mode("overwrite").save(path)
    r.write.mode("ignore").save(path)
    ignored = spark.read.load(path).count()
    r.union(r).write.mode("append").save(path)
    try:
        r.write.mode("errorifexists").save(path)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.load(path).agg(F.count("*").alias("appended"), F.lit(ignored).cast("long").alias("ignored"), F.lit(refused).alias("refused"))


@R.frame("SELECT r_regionkey, r_name FROM region")
def source_sql_on_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM parquet.`{sf_dir}/region.parquet`")


@R.frame("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def source_insert_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, sf_dir, "directory")
    register(spark, sf_dir, "nation")
    spark.sql(f"INSERT OVERWRITE DIRECTORY '{path}' USING parquet SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
    return spark.read.parquet(path)


@R.frame("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def source_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached table, columnar in memory and on disk, read by two plans."""
    c = load(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey").persist()
    first = c.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    both = first.join(c.select("c_mktsegment").distinct(), "c_mktsegment")
    rows = both.collect()  # a row per segment
    c.unpersist()
    return spark.createDataFrame(rows, both.schema)


class SquaresReader(DataSourceReader):
    def __init__(self, count: int, parts: int):
        self.count, self.parts = count, parts

    def partitions(self):
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition) -> Iterator[tuple]:
        for i in range(partition.value, self.count, self.parts):
            yield i, i * i


class SquaresWriter(DataSourceWriter):
    """Counts rows; each task reports and the driver commits once."""

    def write(self, rows):
        return WriterCommitMessage() if sum(1 for _ in rows) >= 0 else None

    def commit(self, messages):
        if any(m is None for m in messages):
            raise RuntimeError("a task didn't report")


class Squares(DataSource):
    @classmethod
    def name(cls) -> str:
        return "squares"

    def schema(self) -> str:
        return "i long, square long"

    def reader(self, schema):
        return SquaresReader(int(self.options.get("count", 10)), int(self.options.get("parts", 2)))

    def writer(self, schema, overwrite):
        return SquaresWriter()


@R.frame("SELECT range AS i, range * range AS square FROM range(0, 20)")
def source_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(Squares)
    df = spark.read.format("squares").options(count=20, parts=3).load()
    df.write.format("squares").mode("append").save()
    return df


@R.frame(NATION)
def source_local_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    return spark.createDataFrame(n.toPandas(), n.schema)


@R.frame(NATION)
def source_jdbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in an embedded database, written by the driver and read in bounded ranges of its key. One process alone may
    open a database that can be written, and executors are others; they read the finished one, packed, which can't."""
    n = load(spark, sf_dir, "nation")
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    packed = re.sub("^file:/+", "/", f"{scratch(spark, sf_dir, 'derby')}-{uuid.uuid4().hex}.jar")
    with tempfile.TemporaryDirectory(prefix="quarry-derby-") as own:
        url = f"jdbc:derby:{own}/database"
        spark.createDataFrame([], n.schema).write.mode("overwrite").jdbc(f"{url};create=true", "nation", properties=options)  # no rows, so no tasks
        _insert(n, url, "nation")
        with contextlib.suppress(Py4JJavaError):  # its end is told by an exception
            spark.sparkContext._jvm.java.sql.DriverManager.getConnection(f"{url};shutdown=true")
        os.makedirs(os.path.dirname(packed), exist_ok=True)
        with zipfile.ZipFile(packed, "w") as out:
            for path in sorted(Path(own, "database").rglob("*")):
                out.write(path, path.relative_to(own))
    read = spark.read.jdbc(f"jdbc:derby:jar:({packed})database", "nation", column="n_nationkey", lowerBound=0, upperBound=25, numPartitions=3, properties=options)
    return read.select(*[F.col(c).cast(n.schema[c].dataType) for c in n.columns])


def _insert(df: DataFrame, url: str, table: str) -> None:
    """Rows into a table from the driver, which holds a partition of them at a time."""
    names, jvm = ", ".join(f'"{c}"' for c in df.columns), df.sparkSession.sparkContext._jvm
    connection = jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        put = connection.prepareStatement(f"INSERT INTO {table} ({names}) VALUES ({', '.join('?' * len(df.columns))})")
        for row in df.toLocalIterator():
            for k, v in enumerate(row, 1):
                put.setObject(k, v)
            put.executeUpdate()
        connection.commit()
    finally:
        connection.close()


def _png(width: int, height: int, value: int) -> bytes:
    """A grey picture, all of one value."""
    import struct
    import zlib

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    rows = (b"\0" + bytes([value]) * width) * height
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@R.frame("SELECT 'a.png' AS name, 3 AS width, 2 AS height, 1 AS channels, '000000000000' AS data UNION ALL SELECT 'b.png', 1, 1, 1, 'FF' UNION ALL SELECT 'c.png', 2, 1, 1, '7B7B'")
def source_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures with their sizes and bytes; a file that is none is left out."""
    path, jvm = _place(spark, sf_dir, "image"), spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, data in (("a.png", _png(3, 2, 0)), ("b.png", _png(1, 1, 255)), ("c.png", _png(2, 1, 123)), ("d.png", b"no picture")):
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
        out.write(bytearray(data))
        out.close()
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return i.select(F.element_at(F.split("origin", "/"), -1).alias("name"), "width", "height", F.col("nChannels").alias("channels"), F.hex("data").alias("data"))
