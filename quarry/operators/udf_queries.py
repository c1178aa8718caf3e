"""User-defined functions of every kind, and what key-value collections do, as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans.registry import Registry
from quarry.session import load

R = Registry()


@R.frame("SELECT n_nationkey, n_name || '/' || n_regionkey AS v FROM nation")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = F.udf(lambda a, b: f"{a}/{b}", "string")
    return load(spark, sf_dir, "nation").select("n_nationkey", join("n_name", "n_regionkey").alias("v"))


@R.frame("SELECT o_orderkey, round(o_totalprice * 1.1, 4) AS v FROM orders")
def udf_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def up(x: pd.Series) -> pd.Series:
        return x * 1.1

    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(up("o_totalprice"), 4).alias("v"))


@R.frame("SELECT o_orderkey, o_custkey + o_orderkey AS v FROM orders")
def udf_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow.compute as pc

    @F.arrow_udf("long")
    def add(a, b):
        return pc.add(a, b)

    return load(spark, sf_dir, "orders").select("o_orderkey", add("o_custkey", "o_orderkey").alias("v"))


@R.frame("SELECT n_nationkey, n_nationkey * 2 AS v FROM nation")
def udf_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udf.register("twice_of", lambda x: x * 2, "int")
    load(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, twice_of(n_nationkey) AS v FROM nation")


@R.frame("SELECT p_brand, round(sqrt(avg(p_retailprice * p_retailprice)), 4) AS rms FROM part GROUP BY 1")
def udaf_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def rms(x: pd.Series) -> float:
        return float((x * x).mean() ** 0.5)

    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(rms("p_retailprice"), 4).alias("rms"))


@R.frame("SELECT p_brand, sum(p_size)::BIGINT AS total, count(*) AS n, round(avg(p_size), 6) AS mean FROM part GROUP BY 1")
def typed_aggregator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zero, reduce, merge and finish: partial buffers per slice, merged, then finished."""
    p = load(spark, sf_dir, "part").groupBy("p_brand", F.pmod(F.hash("p_partkey"), F.lit(8)).alias("slice")).agg(F.struct(F.sum("p_size").alias("total"), F.count("*").alias("n")).alias("buffer"))
    merged = p.groupBy("p_brand").agg(F.sum("buffer.total").alias("total"), F.sum("buffer.n").alias("n"))
    return merged.select("p_brand", "total", "n", F.round(F.col("total") / F.col("n"), 6).alias("mean"))


@R.frame("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def join(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n_regionkey": rows["n_regionkey"].iloc[:1], "names": ["|".join(rows.sort_values("n_nationkey")["n_name"])]})

    return load(spark, sf_dir, "nation").groupBy("n_regionkey").applyInPandas(join, "n_regionkey int, names string")


@R.frame("SELECT n_nationkey, unnest(range(0, n_regionkey))::INTEGER AS i FROM nation WHERE n_regionkey > 0")
def udtf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="i int")
    class Count:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    spark.udtf.register("count_up", Count)
    load(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, i FROM nation, LATERAL count_up(n_regionkey)")


@R.frame("SELECT r_regionkey::INTEGER AS k, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS nations, 1::BIGINT AS regions FROM region")
def cogroup_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def both(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "nations": [len(a)], "regions": [len(b)]})

    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    return n.groupBy("n_regionkey").cogroup(r.groupBy("r_regionkey")).applyInPandas(both, "k int, nations long, regions long")


# Key-value collections.
@R.frame("SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1")
def kv_reduce_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@R.frame("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def kv_subtract_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = load(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return load(spark, sf_dir, "supplier").join(hot, "s_suppkey", "left_anti").select("s_suppkey")


@R.frame("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def kv_filter_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey")
    return o.where("o_orderkey BETWEEN 100 AND 900").select("o_orderkey")


@R.frame("SELECT n_nationkey, (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS i FROM nation")
def kv_zip_with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers in key order without one task for all rows: ranks in ranges, plus the ranges' starts."""
    n = load(spark, sf_dir, "nation").select("n_nationkey").repartitionByRange(4, "n_nationkey").withColumn("p", F.spark_partition_id())
    inner = n.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("n_nationkey")))
    starts = n.groupBy("p").agg(F.count("*").alias("c")).withColumn("start", F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)))
    return inner.join(starts, "p").select("n_nationkey", (F.col("r") - 1 + F.coalesce("start", F.lit(0))).cast("long").alias("i"))


@R.frame("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey + b.n_nationkey = 24")
def kv_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional zip of a table and its reverse, by joined positions."""
    i = kv_zip_with_index(spark, sf_dir)
    return i.select(F.col("n_nationkey").alias("a"), "i").join(i.select(F.col("n_nationkey").alias("b"), (24 - F.col("i")).alias("i")), "i").select("a", "b")


@R.frame("SELECT upper(n_name) AS line FROM nation")
def kv_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through an external process, one per partition."""
    import subprocess

    def pipe(batches):
        for rows in batches:
            if len(rows):
                out = subprocess.run(["tr", "a-z", "A-Z"], input="\n".join(rows["n_name"]), capture_output=True, text=True, check=True)
                yield pd.DataFrame({"line": out.stdout.split("\n")})

    return load(spark, sf_dir, "nation").select("n_name").mapInPandas(pipe, "line string")


@R.frame("SELECT count(*) AS n, 2::BIGINT AS parts FROM nation")
def kv_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gang-scheduled stage: both tasks wait for each other."""

    def wait(batches):
        from pyspark import BarrierTaskContext

        c = BarrierTaskContext.get()
        c.barrier()
        yield pd.DataFrame({"p": [c.partitionId()], "n": [sum(len(b) for b in batches)]})

    return load(spark, sf_dir, "nation").select("n_nationkey").repartition(2).mapInPandas(wait, "p int, n long", barrier=True).agg(F.sum("n").alias("n"), F.countDistinct("p").alias("parts"))


@R.frame("SELECT count(*) AS n FROM orders")
def kv_async_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        n = pool.submit(load(spark, sf_dir, "orders").count).result()
    return spark.createDataFrame([Row(n=n)], "n long")


@R.frame("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def kv_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage cut by a reliable checkpoint in the shared folder."""
    from quarry.plans.scratch import scratch

    spark.sparkContext.setCheckpointDir(scratch(spark, sf_dir, "checkpoint"))
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).checkpoint()


@R.frame("SELECT n_regionkey, list_sort(list(n_nationkey))::VARCHAR AS keys FROM nation GROUP BY 1")
def kv_glom(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("k"))
    return n.select("n_regionkey", F.concat(F.lit("["), F.array_join(F.col("k").cast("array<string>"), ", "), F.lit("]")).alias("keys"))
