"""Projection, filters, subqueries, joins, sets, sorting and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.registry import Registry
from quarry.session import load

R = Registry()

# Projection, filters, predicates, generators.
R.sql("project", "SELECT c_custkey AS k, upper(c_name) AS name, c_acctbal * 2 AS twice, customer.c_nationkey AS nation FROM customer")
R.sql("filter_pred", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND NOT (o_orderstatus = 'F') OR o_orderpriority LIKE '1-%'")
R.sql("between_in", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') OR p_size NOT IN (1, 2, 3)")
R.sql(
    "null_safe_eq",
    "SELECT l.k, l.v <=> r.v AS same FROM (SELECT nullif(n_nationkey % 4, 0) AS v, n_nationkey AS k FROM nation) l JOIN (SELECT nullif(n_nationkey % 3, 0) AS v, n_nationkey AS k FROM nation) r ON l.k = r.k",
    "SELECT l.k, l.v IS NOT DISTINCT FROM r.v AS same FROM (SELECT nullif(n_nationkey % 4, 0) AS v, n_nationkey AS k FROM nation) l JOIN (SELECT nullif(n_nationkey % 3, 0) AS v, n_nationkey AS k FROM nation) r ON l.k = r.k",
)
R.sql("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status FROM orders")
R.sql("having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 100 AND count(*) > 2")
R.sql("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT o_custkey, n FROM per WHERE n >= 1")
R.sql("inline_subquery", "SELECT s.k, s.m FROM (SELECT n_regionkey AS k, max(n_name) AS m FROM nation GROUP BY n_regionkey) AS s WHERE s.k > 0")
R.sql("exists_subquery", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000)")
R.sql("not_exists_subquery", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
R.sql("in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
R.sql("not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 2) FROM region)")
R.sql("not_in_subquery", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)")
R.sql("scalar_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
R.sql("existence_join", "SELECT c_custkey FROM customer c WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
R.sql("inline_values", "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, CAST(NULL AS STRING))) AS t(k, v)", "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, CAST(NULL AS VARCHAR))) AS t(k, v)")
R.sql("range_tvf", "SELECT id FROM range(3, 40, 4)", "SELECT range AS id FROM range(3, 40, 4)")
R.sql("null_handling", "SELECT c, b, b + 1 AS s, c > 1 AND b IS NULL AS t, c > 1 OR b > 2 AS u FROM (VALUES (1, 2), (2, NULL), (NULL, 3)) AS v(c, b)")
R.sql("explode_lateral", "SELECT lang, w, count(*) AS n FROM documents LATERAL VIEW explode(split(text, ' ')) t AS w GROUP BY lang, w", "SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY lang, w")
R.sql("explode_outer_lateral", "SELECT n_nationkey, x FROM nation LATERAL VIEW OUTER explode(sequence(1, n_regionkey)) t AS x WHERE n_regionkey > 0", "SELECT n_nationkey, unnest(range(1, n_regionkey + 1))::INTEGER AS x FROM nation WHERE n_regionkey > 0")
R.sql("posexplode_rows", "SELECT n_nationkey, pos, c FROM nation LATERAL VIEW posexplode(split(n_name, '')) t AS pos, c", "SELECT n_nationkey, (i - 1)::INTEGER AS pos, n_name[i] AS c FROM (SELECT *, unnest(range(1, len(n_name) + 1)) AS i FROM nation)")
R.sql("stack_rows", "SELECT r_regionkey, k, v FROM region LATERAL VIEW stack(2, 'a', r_regionkey, 'b', r_regionkey * 10) t AS k, v", "SELECT r_regionkey, 'a' AS k, r_regionkey AS v FROM region UNION ALL SELECT r_regionkey, 'b', r_regionkey * 10 FROM region")
R.sql("inline_structs", "SELECT r_regionkey, a, b FROM region LATERAL VIEW inline(array(named_struct('a', r_regionkey, 'b', r_name), named_struct('a', -1, 'b', 'none'))) t AS a, b", "SELECT r_regionkey, r_regionkey AS a, r_name AS b FROM region UNION ALL SELECT r_regionkey, -1, 'none' FROM region")
R.sql("struct_access", "SELECT s.k AS k, s.n.name AS name FROM (SELECT named_struct('k', n_nationkey, 'n', named_struct('name', n_name)) AS s FROM nation) x", "SELECT n_nationkey AS k, n_name AS name FROM nation")


@R.frame("SELECT n_nationkey, n_name FROM nation")
def column_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    return n.select(n.colRegex("`n_na.*`"))


@R.frame("SELECT r_regionkey AS key, lower(r_name) AS name_lower FROM region")
def with_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "region").withColumn("name_lower", F.lower("r_name")).withColumnRenamed("r_regionkey", "key").drop("r_name")


@R.frame("SELECT n_nationkey, coalesce(CASE WHEN n_regionkey = 1 THEN NULL WHEN n_regionkey = 3 THEN 30 ELSE n_regionkey END, -1) AS v FROM nation")
def fill_and_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_regionkey") != 1, F.col("n_regionkey")).alias("v"))
    return n.na.fill({"v": -1}).na.replace({3: 30}, subset=["v"])


@R.frame("SELECT n_nationkey, v FROM (SELECT n_nationkey, nullif(n_regionkey, 1) AS v FROM nation) WHERE v IS NOT NULL")
def drop_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select("n_nationkey", F.nullif(F.col("n_regionkey"), F.lit(1)).alias("v")).na.drop(subset=["v"])


@R.frame("SELECT o_orderkey FROM orders WHERE (('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT) % 10 < 3")
def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), 16, 10).cast("long")
    return load(spark, sf_dir, "orders").where(h % 10 < 3).select("o_orderkey")


@R.frame("SELECT unnest(['bernoulli', 'poisson', 'stratified', 'split']) AS kind, true AS near, unnest([0, 0, 0, count(*)])::BIGINT AS whole FROM orders")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all orders are as large as asked, within five standard deviations; two splits are the whole."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    n, strata = o.count(), {r.o_orderstatus: r["count"] for r in o.groupBy("o_orderstatus").count().collect()}
    a, b = o.randomSplit([0.7, 0.3], seed=11)
    share, out = {"F": 0.5, "O": 0.1}, None
    asked = {"bernoulli": (o.sample(0.2, seed=7), 0.2 * n), "poisson": (o.sample(True, 0.2, 7), 0.2 * n), "stratified": (o.sampleBy("o_orderstatus", share, seed=3), sum(share[k] * strata.get(k, 0) for k in share)), "split": (a, 0.7 * n)}
    for k, (df, want) in asked.items():
        whole = F.lit(a.union(b).distinct().count() if k == "split" else 0).cast("long")
        row = df.agg(F.lit(k).alias("kind"), (F.abs(F.count("*") - want) <= 5 * want**0.5).alias("near"), whole.alias("whole"))
        out = row if out is None else out.union(row)
    return out


@R.frame("SELECT count(*) AS n FROM orders")
def repartitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.repartition(8, "o_custkey").hint("rebalance").repartitionByRange(4, "o_orderkey").coalesce(2).agg(F.count("*").alias("n"))


# Joins.
R.sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
R.sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
R.sql("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'")
R.sql("join_full", "SELECT a.k AS ka, b.k AS kb FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 10) b ON a.k = b.k")
R.sql("join_semi", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
R.sql("join_anti", "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
R.sql("join_cross", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b")
R.sql("join_natural", "SELECT * FROM (SELECT n_regionkey AS r_regionkey, n_name FROM nation) a NATURAL JOIN region")
R.sql("join_using", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")
R.sql("join_theta", "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey")
R.sql("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
R.sql("join_empty", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE false) o ON c_custkey = o_custkey WHERE c_nationkey = 3")
R.sql("join_shuffle_hash", "SELECT /*+ SHUFFLE_HASH(c) */ c_mktsegment, count(*) AS n FROM orders o JOIN customer c ON o_custkey = c_custkey GROUP BY c_mktsegment")
R.sql("join_merge", "SELECT /*+ MERGE(c) */ c_nationkey, count(*) AS n FROM orders o JOIN customer c ON o_custkey = c_custkey GROUP BY c_nationkey")


@R.frame("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 nations are of fixed size, so they are broadcast whatever the customers' number."""
    return load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@R.frame("SELECT e.event_id, b.lo FROM events e JOIN (SELECT range AS lo FROM range(0, 200, 10)) b ON e.value >= b.lo AND e.value < b.lo + 10")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join as an equi-join on the range's bucket."""
    bins = spark.range(0, 200, 10).withColumnRenamed("id", "lo").withColumn("b", (F.col("lo") / 10).cast("long"))
    return load(spark, sf_dir, "events").where("value >= 0").withColumn("b", F.floor(F.col("value") / 10)).join(bins, "b").select("event_id", "lo")


@R.frame(
    "SELECT e.event_id, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS last_purchase FROM events e WHERE e.event_type = 'click'"
)
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join without a join: the last purchase seen before each row, in one pass per user."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    e = load(spark, sf_dir, "events").withColumn("last_purchase", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w))
    return e.where("event_type = 'click'").select("event_id", "last_purchase")


def salted_join(left: DataFrame, right: DataFrame, key: str, grains: int = 16, most: int = 1024) -> DataFrame:
    """An inner join whose hot keys, those of over a ``most``-th of the left rows, are dealt to ``grains`` tasks.

    There are fewer than ``most`` such keys, so they are broadcast; only their right rows are repeated."""
    counted = left.groupBy(key).count()
    hot = F.broadcast(counted.where(F.col("count") > left.count() / most).select(key, F.lit(True).alias("_hot")))
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(grains)).cast("int")
    dealt = left.withColumn("_grain", spread).join(hot, key, "left").withColumn("_grain", F.when(F.col("_hot"), F.col("_grain")).otherwise(0)).drop("_hot")
    repeated = right.join(hot, key, "left").withColumn("_grain", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(grains - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(repeated.hint("shuffle_hash"), [key, "_grain"]).drop("_grain")


@R.frame("SELECT s_nationkey, count(*) AS n, round(sum(l_quantity), 0) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def join_skew_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few suppliers of many lines each: all of them are hot."""
    li = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return salted_join(li, s, "l_suppkey").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 0).alias("quantity"))


@R.frame("SELECT o_orderkey AS left_key, c_custkey AS right_key FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed join: each side stays one struct."""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    pairs = o.select(F.struct("*").alias("_1")).join(c.select(F.struct("*").alias("_2")), F.col("_1.o_custkey") == F.col("_2.c_custkey"))
    return pairs.where("_1.o_totalprice > 100000").select(F.col("_1.o_orderkey").alias("left_key"), F.col("_2.c_custkey").alias("right_key"))


@R.frame("SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables bucketed alike by order key meet without a shuffle."""
    import uuid

    from quarry.plans.scratch import scratch

    tag = uuid.uuid4().hex[:12]
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        place = f"{scratch(spark, sf_dir, 'bucketed')}/{name}_{tag}"
        load(spark, sf_dir, name).write.option("path", place).bucketBy(8, key).sortBy(key).saveAsTable(f"bucketed_{name}_{tag}")
    o, li = spark.table(f"bucketed_orders_{tag}"), spark.table(f"bucketed_lineitem_{tag}")
    return o.hint("merge").join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


# Sets.
R.sql("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
R.sql("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region")
R.sql("except_distinct", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 20")
R.sql("except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
R.sql("intersect_distinct", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
R.sql("intersect_all", "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT s_nationkey % 5 FROM supplier")


@R.frame("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return a.unionByName(load(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k")))


# Sorting and limits.
R.sql("sort_nulls", "SELECT k, row_number() OVER (ORDER BY v DESC NULLS LAST, k) AS place FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS v FROM nation) x", "SELECT k, (row_number() OVER (ORDER BY v DESC NULLS LAST, k))::INTEGER AS place FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS v FROM nation) x")
R.sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
R.sql("limit_ordered", "SELECT c_custkey FROM customer ORDER BY 1 LIMIT 7 OFFSET 3")
R.sql("topk_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) x WHERE r <= 2")


@R.frame("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS place FROM orders")
def sort_within_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DISTRIBUTE BY and SORT BY: a customer's orders lie in one partition, in order; an order's place is counted from the running number."""
    from pyspark.sql import Window

    o = load(spark, sf_dir, "orders").repartition(8, "o_custkey").sortWithinPartitions("o_custkey", F.desc("o_totalprice"), "o_orderkey")
    o = o.select("o_custkey", "o_orderkey", F.monotonically_increasing_id().alias("i"))
    return o.select("o_orderkey", (F.col("i") - F.min("i").over(Window.partitionBy("o_custkey")) + 1).alias("place"))


# Whole queries.
R.sql("tpch_q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus")
R.sql("tpch_q3", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
R.sql("tpch_q4", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority")
R.sql("tpch_q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name")
R.sql("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1996-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24")
R.sql("tpch_q10", "SELECT c_custkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey ORDER BY revenue DESC, c_custkey LIMIT 20")
R.sql("tpch_q12", "SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low FROM orders, lineitem WHERE o_orderkey = l_orderkey GROUP BY l_linestatus", "SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS high, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS low FROM orders, lineitem WHERE o_orderkey = l_orderkey GROUP BY l_linestatus")
R.sql("tpch_q14", "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem, part WHERE l_partkey = p_partkey")
R.sql("tpch_q18", "SELECT c_custkey, o_orderkey, round(sum(l_quantity), 2) AS qty FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_custkey, o_orderkey ORDER BY qty DESC, o_orderkey LIMIT 100")
R.sql("star_revenue", "SELECT year(o_orderdate) AS y, p_brand, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY year(o_orderdate), p_brand", "SELECT year(o_orderdate)::INTEGER AS y, p_brand, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY year(o_orderdate), p_brand")
