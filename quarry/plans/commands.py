"""Catalog and session commands: each does its work, and its result is what can be seen afterwards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.registry import Registry
from quarry.session import load, register

R = Registry()


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


@R.frame("SELECT '13' AS set_to, true AS reset")
def command_set_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "quarry.probe"
    spark.sql(f"SET {key} = 13")
    value = spark.conf.get(key)
    spark.sql(f"RESET {key}")
    return spark.createDataFrame([(value, spark.conf.get(key, None) is None)], "set_to string, reset boolean")


@R.frame("SELECT 25::BIGINT AS n, true AS cached, true AS cleared")
def command_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _name("cached")
    load(spark, sf_dir, "nation").createOrReplaceTempView(view)
    spark.sql(f"CACHE TABLE {view}")
    cached, n = spark.catalog.isCached(view), spark.table(view).count()
    spark.sql(f"UNCACHE TABLE {view}")
    return spark.createDataFrame([(n, cached, not spark.catalog.isCached(view))], "n long, cached boolean, cleared boolean")


@R.frame("SELECT true AS has_statistics, true AS listed, true AS columns_shown, true AS dropped")
def command_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE USING, ANALYZE, SHOW, DESCRIBE and DROP."""
    t = _name("supplier")
    register(spark, sf_dir, "supplier")
    spark.sql(f"CREATE TABLE {t} USING parquet AS SELECT * FROM supplier")
    spark.sql(f"ANALYZE TABLE {t} COMPUTE STATISTICS FOR ALL COLUMNS")
    about = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {t}").collect()}
    listed = spark.sql(f"SHOW TABLES LIKE '{t}'").count() == 1
    columns = [r[0] for r in spark.sql(f"SHOW COLUMNS IN {t}").collect()] == ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
    spark.sql(f"REFRESH TABLE {t}")
    spark.sql(f"DROP TABLE {t}")
    return spark.createDataFrame([("rows" in about.get("Statistics", ""), listed, columns, not spark.catalog.tableExists(t))], "has_statistics boolean, listed boolean, columns_shown boolean, dropped boolean")


@R.frame("SELECT r_regionkey, r_name FROM region")
def command_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A temporary view over a view, a global one, and a replaced one."""
    a, g = _name("view"), _name("global")
    register(spark, sf_dir, "region")
    spark.sql(f"CREATE TEMPORARY VIEW {a} AS SELECT r_regionkey FROM region WHERE r_regionkey < 2")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {a} AS SELECT * FROM region")
    spark.table(a).createGlobalTempView(g)
    return spark.newSession().sql(f"SELECT r_regionkey, r_name FROM global_temp.{g}")


@R.frame("SELECT true AS made, true AS used, true AS back")
def command_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _name("db")
    spark.sql(f"CREATE DATABASE {d}")
    made = spark.sql(f"SHOW DATABASES LIKE '{d}'").count() == 1
    session = spark.newSession()
    session.sql(f"USE {d}")
    used = session.catalog.currentDatabase() == d
    spark.sql(f"DROP DATABASE {d}")
    return spark.createDataFrame([(made, used, spark.catalog.currentDatabase() == "default")], "made boolean, used boolean, back boolean")


@R.frame("SELECT true AS logical, true AS pushed, true AS pruned")
def command_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "orders")
    text = spark.sql("EXPLAIN EXTENDED SELECT o_orderkey FROM orders WHERE o_totalprice > 5").first()[0]
    return spark.createDataFrame([("Optimized Logical Plan" in text, "GreaterThan(o_totalprice,5.0)" in text, "o_comment" not in text and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text)], "logical boolean, pushed boolean, pruned boolean")


@R.frame("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 100, 'NEW'")
def command_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _name("inserted")
    register(spark, sf_dir, "nation")
    spark.sql(f"CREATE TABLE {t} (n_nationkey INT, n_name STRING) USING parquet")
    spark.sql(f"INSERT OVERWRITE {t} SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
    spark.sql(f"INSERT INTO {t} VALUES (100, 'NEW')")
    return spark.table(t)


@R.frame("SELECT true AS listed")
def command_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ADD FILE and LIST FILES."""
    spark.sql(f"ADD FILE '{sf_dir}/region.parquet'")
    return spark.createDataFrame([(any("region.parquet" in r[0] for r in spark.sql("LIST FILES").collect()),)], "listed boolean")


@R.frame("SELECT n_nationkey, n_name FROM nation")
def command_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through a script, as SQL's TRANSFORM has it, in Arrow batches."""
    import subprocess

    import pandas as pd

    def script(batches):
        for rows in batches:
            if len(rows):
                fed = "\n".join(f"{a}\t{b}" for a, b in zip(rows["n_nationkey"], rows["n_name"], strict=True))
                out = subprocess.run(["cat"], input=fed, capture_output=True, text=True, check=True).stdout
                cells = [x.split("\t") for x in out.split("\n") if x]
                yield pd.DataFrame({"n_nationkey": [int(c[0]) for c in cells], "n_name": [c[1] for c in cells]})

    return load(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(script, "n_nationkey int, n_name string")


@R.frame("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def command_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "customer")
    return spark.sql("SELECT /*+ COALESCE(2), REPARTITION(4, c_mktsegment) */ c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment").select("c_mktsegment", F.col("n"))
