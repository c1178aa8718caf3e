"""Grouping, grouping sets, pivots, statistics, sketches and windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.ranks import percentiles
from quarry.plans.registry import Registry
from quarry.session import load, register

R = Registry()

R.sql("agg_group", "SELECT l_returnflag, count(*) AS n, count(l_tax) AS taxed, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY l_returnflag")
R.sql("agg_by_ordinal", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
R.sql("agg_by_expression", "SELECT p_size % 10 AS d, count(*) AS n FROM part GROUP BY p_size % 10")
R.sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS supps, count(DISTINCT l_partkey, l_linenumber) AS pairs, count(DISTINCT l_linestatus) AS states FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS supps, count(DISTINCT (l_partkey, l_linenumber)) AS pairs, count(DISTINCT l_linestatus) AS states FROM lineitem GROUP BY l_returnflag")
R.sql("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 1) AS urgent FROM orders GROUP BY o_orderstatus")
R.sql(
    "agg_stats",
    "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(variance(l_quantity), 6) AS va, round(var_pop(l_quantity), 6) AS vap, round(skewness(l_quantity), 6) AS sk, round(kurtosis(l_quantity), 6) AS ku FROM lineitem GROUP BY l_returnflag",
    "WITH m AS (SELECT l_returnflag, avg(l_quantity) AS mu FROM lineitem GROUP BY 1), c AS (SELECT l.l_returnflag, avg((l_quantity - mu) ** 2) AS m2, avg((l_quantity - mu) ** 3) AS m3, avg((l_quantity - mu) ** 4) AS m4, stddev_samp(l_quantity) AS sd, stddev_pop(l_quantity) AS sdp, var_samp(l_quantity) AS va, var_pop(l_quantity) AS vap FROM lineitem l JOIN m USING (l_returnflag) GROUP BY 1) SELECT l_returnflag, round(sd, 6) AS sd, round(sdp, 6) AS sdp, round(va, 6) AS va, round(vap, 6) AS vap, round(m3 / m2 ** 1.5, 6) AS sk, round(m4 / m2 ** 2 - 3, 6) AS ku FROM c",
)
R.sql("agg_corr_cov", "SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs FROM lineitem GROUP BY l_linestatus")
R.sql("agg_percentile", "SELECT l_returnflag, percentile(l_extendedprice, 0.5) AS p50, percentile(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
R.sql("agg_first_last", "SELECT c_mktsegment, min_by(c_name, c_custkey) AS f, max_by(c_name, c_custkey) AS l, max(struct(c_acctbal, c_custkey)).c_custkey AS rich FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, min_by(c_name, c_custkey) AS f, max_by(c_name, c_custkey) AS l, max_by(c_custkey, (c_acctbal, c_custkey)) AS rich FROM customer GROUP BY c_mktsegment")

@R.frame("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(stddev(o_totalprice), 4) AS std, quantile_disc(o_orderkey, 0.5) AS middle, sum(o_orderkey % 7)::BIGINT AS rest, round(max(o_custkey ** 2), 0) AS squared, sum(ceil(o_totalprice)::BIGINT)::BIGINT AS whole, max(length(o_orderpriority))::INTEGER AS longest FROM orders GROUP BY o_orderstatus")
def agg_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates by their other names. approx_percentile gives the median up to a share of the rows, and so only bounds it."""
    register(spark, sf_dir, "orders")
    others = spark.sql("SELECT o_orderstatus, round(mean(o_totalprice), 4) AS mean, round(std(o_totalprice), 4) AS std, sum(mod(o_orderkey, 7)) AS rest, round(max(power(o_custkey, 2)), 0) AS squared, sum(ceiling(o_totalprice)) AS whole, max(character_length(o_orderpriority)) AS longest FROM orders GROUP BY o_orderstatus")
    middle = percentiles(spark.table("orders"), ["o_orderkey"], ["0.5"], ["o_orderstatus"]).select(F.col("o_orderstatus").alias("_status"), F.col("o_orderkey")[0].alias("middle"))
    return others.join(middle, F.col("o_orderstatus").eqNullSafe(F.col("_status"))).select("o_orderstatus", "mean", "std", "middle", "rest", "squared", "whole", "longest")


@R.frame("SELECT c_nationkey, arg_min(c_name, c_custkey) AS first, arg_max(c_name, c_custkey) AS last, count(DISTINCT c_mktsegment) > 0 AS any FROM customer GROUP BY 1")
def agg_ordered_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first and last see rows in order where one frame holds the group."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = load(spark, sf_dir, "customer").select("c_nationkey", F.first("c_name").over(w).alias("first"), F.last("c_name").over(w).alias("last"), F.any_value("c_mktsegment").over(w).isNotNull().alias("any"))
    return c.distinct()


R.sql("agg_bool", "SELECT o_custkey, bool_and(o_totalprice > 50000) AS all_big, bool_or(o_totalprice > 200000) AS any_big, count_if(o_orderstatus = 'F') AS f FROM orders GROUP BY o_custkey", "SELECT o_custkey, bool_and(o_totalprice > 50000) AS all_big, bool_or(o_totalprice > 200000) AS any_big, count_if(o_orderstatus = 'F')::BIGINT AS f FROM orders GROUP BY o_custkey")
R.sql("cube", "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
R.sql("rollup", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
R.sql("grouping_sets", "SELECT c_nationkey AS a, c_mktsegment AS b, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), (c_nationkey, c_mktsegment), ())")
R.sql("grouping_id", "SELECT o_orderstatus AS a, o_orderpriority AS b, grouping_id(o_orderstatus, o_orderpriority) AS g, CAST(grouping(o_orderpriority) AS INT) AS gb, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus AS a, o_orderpriority AS b, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS g, grouping(o_orderpriority)::INTEGER AS gb, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
R.sql(
    "pivot_two",
    "SELECT * FROM (SELECT l_returnflag AS f, l_linestatus AS s, l_quantity AS q FROM lineitem) PIVOT (count(*) AS n, max(q) AS m FOR s IN ('O' AS o, 'F' AS f2))",
    "SELECT l_returnflag AS f, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS o_n, max(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS o_m, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS f2_n, max(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS f2_m FROM lineitem GROUP BY 1",
)


@R.frame("SELECT event_type, count(CASE WHEN user_id % 3 = 0 THEN 1 END) AS \"0\", count(CASE WHEN user_id % 3 = 1 THEN 1 END) AS \"1\", count(CASE WHEN user_id % 3 = 2 THEN 1 END) AS \"2\" FROM events GROUP BY event_type")
def pivot_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("u", F.col("user_id") % 3).groupBy("event_type").pivot("u", [0, 1, 2]).agg(F.count("event_id")).na.fill(0)


@R.frame("SELECT n_regionkey, 'n_name' AS k, n_name AS v FROM nation UNION ALL SELECT n_regionkey, 'key', n_nationkey::VARCHAR FROM nation")
def unpivot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").select("n_regionkey", "n_name", F.col("n_nationkey").cast("string").alias("key"))
    return n.unpivot("n_regionkey", ["n_name", "key"], "k", "v")


R.sql("collect_sorted", "SELECT n_regionkey, concat_ws(',', array_sort(collect_list(n_name))) AS names, size(collect_set(n_nationkey % 3)) AS kinds FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(DISTINCT n_nationkey % 3)::INTEGER AS kinds FROM nation GROUP BY n_regionkey")


@R.frame("SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ALL")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey")
    return n.union(n).distinct().groupBy("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"))


@R.frame("SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey")
def drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey")).dropDuplicates(["c_nationkey"])


@R.frame("SELECT list_sort(list(DISTINCT o_orderpriority)) AS priority, list_sort(list(DISTINCT o_orderstatus)) AS status FROM orders")
def freq_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With room for ten, all of five priorities and three states are found."""
    return load(spark, sf_dir, "orders").stat.freqItems(["o_orderpriority", "o_orderstatus"], 0.1).select(F.array_sort("o_orderpriority_freqItems").alias("priority"), F.array_sort("o_orderstatus_freqItems").alias("status"))


@R.frame("SELECT o_orderstatus, true AS close FROM orders GROUP BY o_orderstatus")
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperLogLog++ within three standard errors of the exact count."""
    o = load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.countDistinct("o_custkey").alias("e"))
    return o.select("o_orderstatus", (F.abs(F.col("a") - F.col("e")) <= 0.06 * F.col("e") + 1).alias("close"))


@R.frame("SELECT l_returnflag, true AS close FROM lineitem GROUP BY l_returnflag")
def approx_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch's median has a rank within 1 % of the middle."""
    li = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    q = li.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", 0.5, 1000).alias("q"))
    rank = F.avg((F.col("l_extendedprice") <= F.col("q")).cast("int"))
    return li.join(q, "l_returnflag").groupBy("l_returnflag").agg((F.abs(rank - 0.5) < 0.01).alias("close"))


@R.frame("SELECT o_orderpriority, count(*) AS estimate FROM orders GROUP BY 1 UNION ALL SELECT 'none of them', 0")
def count_min_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates read from the serialised sketch; with far fewer values than its width they are the counts."""
    o = load(spark, sf_dir, "orders")
    blob = o.agg(F.count_min_sketch("o_orderpriority", F.lit(0.001), F.lit(0.99), F.lit(7)).alias("s")).first().s
    counts = spark.sparkContext._jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(bytearray(blob))
    asked = [r.o_orderpriority for r in o.select("o_orderpriority").distinct().limit(100).collect()] + ["none of them"]
    return spark.createDataFrame([(x, counts.estimateCount(x)) for x in asked], "o_orderpriority string, estimate long")


@R.frame("SELECT count(*) AS members, 0::BIGINT AS missed, count(*) AS strangers, true AS few_let_through FROM orders")
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bloom filters of all order keys, one per slice of about 4096: no key is missed, and of as many other keys hardly one passes."""
    orders, bits = load(spark, sf_dir, "orders"), 1 << 16
    slices = max(16, -(-orders.count() // 4096))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        filled = np.zeros(bits, dtype=bool)
        for k in range(3):
            filled[(pdf["h"].to_numpy().view("uint64") >> np.uint64(16 * k)) % np.uint64(bits)] = True
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "filter": [np.packbits(filled).tobytes()]})

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        filled = np.unpackbits(np.frombuffer(right["filter"].iloc[0], np.uint8)).astype(bool) if len(right) else np.zeros(bits, dtype=bool)
        h, member = left["h"].to_numpy().view("uint64"), left["member"].to_numpy()
        found = np.logical_and.reduce([filled[(h >> np.uint64(16 * k)) % np.uint64(bits)] for k in range(3)])
        return pd.DataFrame({"members": [int(member.sum())], "missed": [int((member & ~found).sum())], "strangers": [int((~member).sum())], "passed": [int((~member & found).sum())]})

    hashed = lambda key, member: orders.select(F.xxhash64(key).alias("h"), F.lit(member).alias("member")).withColumn("slice", F.pmod(F.hash("h"), F.lit(slices)))
    members = hashed(F.col("o_orderkey"), True)
    filters = members.groupBy("slice").applyInPandas(build, "slice int, filter binary")
    hit = members.union(hashed(-F.col("o_orderkey") - 1, False)).groupBy("slice").cogroup(filters.groupBy("slice")).applyInPandas(probe, "members long, missed long, strangers long, passed long")
    total = hit.agg(*[F.sum(c).alias(c) for c in ("members", "missed", "strangers", "passed")])
    return total.select("members", "missed", "strangers", (F.col("passed") < 0.02 * F.col("strangers")).alias("few_let_through"))


@R.frame("SELECT floor(o_totalprice / 50000)::BIGINT AS bin, true AS close FROM orders GROUP BY 1")
def approx_distinct_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_totalprice") / 50000).alias("bin")).agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.countDistinct("o_custkey").alias("e"))
    return o.select("bin", (F.abs(F.col("a") - F.col("e")) <= 0.06 * F.col("e") + 1).alias("close"))


@R.frame("SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS variance, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem")
def stat_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mergeable moments: partial (n, mean, m2) of slices combined by Chan's rule."""
    s = load(spark, sf_dir, "lineitem").groupBy(F.pmod(F.hash("l_orderkey"), F.lit(16)).alias("s")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"), (F.var_pop("l_quantity") * F.count("*")).alias("m2"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    t = s.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum("m2").alias("m2"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return t.select("n", F.round("mean", 6).alias("mean"), F.round((F.col("m2") + F.col("q") - F.col("n") * F.col("mean") ** 2) / F.col("n"), 6).alias("variance"), "lo", "hi")


R.sql("describe_table", "SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev(o_totalprice), 4) AS sd, min(o_totalprice) AS lo, percentile(o_totalprice, 0.25) AS q1, percentile(o_totalprice, 0.75) AS q3, max(o_totalprice) AS hi FROM orders", "SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev(o_totalprice), 4) AS sd, min(o_totalprice) AS lo, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS hi FROM orders")


@R.frame("SELECT o_orderstatus, count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS urgent FROM orders GROUP BY 1")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "orders").stat.crosstab("o_orderstatus", "o_orderpriority")
    return t.select(F.col("o_orderstatus_o_orderpriority").alias("o_orderstatus"), F.col("`1-URGENT`").alias("urgent"))


# Windows.
INT = "(row_number() OVER w)::INTEGER AS rn, (rank() OVER w)::INTEGER AS rk, (dense_rank() OVER w)::INTEGER AS dr"
R.sql("win_rank", "SELECT c_custkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey)", f"SELECT c_custkey, {INT}, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey)")
R.sql("win_ties", "SELECT c_custkey, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)", "SELECT c_custkey, (rank() OVER w)::INTEGER AS rk, (dense_rank() OVER w)::INTEGER AS dr FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)")
R.sql("win_ntile", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM orders", "SELECT o_orderkey, (ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INTEGER AS q FROM orders")
R.sql("win_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, -1) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
R.sql("win_first_last", "SELECT n_nationkey, first_value(v) IGNORE NULLS OVER w AS f, last_value(v) IGNORE NULLS OVER w AS l FROM (SELECT n_nationkey, n_regionkey, nullif(n_nationkey % 4, 0) AS v FROM nation) x WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "SELECT n_nationkey, first_value(v IGNORE NULLS) OVER w AS f, last_value(v IGNORE NULLS) OVER w AS l FROM (SELECT n_nationkey, n_regionkey, nullif(n_nationkey % 4, 0) AS v FROM nation) x WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
R.sql("win_rows", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS m FROM orders")
R.sql("win_range", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS n FROM part")
R.sql("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
R.sql("win_aggregates", "SELECT c_custkey, round(corr(c_acctbal, c_custkey) OVER w, 6) AS r, max(c_acctbal) OVER w AS m, size(collect_set(c_mktsegment) OVER w) AS segs FROM customer WINDOW w AS (PARTITION BY c_nationkey)", "SELECT c_custkey, round(corr(c_acctbal, c_custkey) OVER w, 6) AS r, max(c_acctbal) OVER w AS m, (count(DISTINCT c_mktsegment) OVER w)::INTEGER AS segs FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
R.sql("win_running_share", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")


@R.frame("SELECT n_nationkey, (max(n_nationkey) OVER (PARTITION BY n_regionkey) - min(n_nationkey) OVER (PARTITION BY n_regionkey))::DOUBLE AS width FROM nation")
def win_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def width(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return load(spark, sf_dir, "nation").select("n_nationkey", width("n_nationkey").over(Window.partitionBy("n_regionkey")).alias("width"))
