"""Queries over blocks: sampling, storage, local and global operations, generators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import local_global as lg
from quarry.operators.blocks import BLOCK, BlockFrame, BlockReader, BlockStore, choose, count_bounds, keyed_block, mean_estimate, reservoir, split, sum_bounds, sum_estimate
from quarry.plans.registry import Registry
from quarry.plans.scratch import scratch
from quarry.session import load
from quarry.sources import generators as gen

R = Registry()
N = 10
LINE = "(('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber)), 1, 8))::BIGINT) % 10"
ORDER = "(('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT) % 10"
VECTOR = "(('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT) % 5"


def lines(spark: SparkSession, sf_dir: str) -> BlockFrame:
    return BlockFrame.assign(load(spark, sf_dir, "lineitem"), N, ["l_orderkey", "l_linenumber"])


def vectors(spark: SparkSession, sf_dir: str) -> BlockFrame:
    return BlockFrame.assign(load(spark, sf_dir, "embeddings"), 5, ["vec_id"])


@R.frame(f"SELECT l_orderkey, l_linenumber, {LINE} AS block_id FROM lineitem")
def block_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).df.select("l_orderkey", "l_linenumber", BLOCK)


@R.frame(f"SELECT {LINE} AS block_id, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem GROUP BY 1")
def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).df.groupBy(BLOCK).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@R.frame(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {LINE} IN (2, 5)")
def block_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).subset([2, 5]).df.select("l_orderkey", "l_linenumber")


@R.frame(f"SELECT CASE {LINE} WHEN 7 THEN 0 WHEN 1 THEN 1 END AS position, count(*) AS n FROM lineitem WHERE {LINE} IN (7, 1) GROUP BY 1")
def block_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).reindexed([7, 1]).groupBy("position").agg(F.count("*").alias("n"))


@R.frame(f"SELECT count(*) AS n FROM orders WHERE {ORDER} IN (0, 4)")
def block_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two blocks on the driver, which is what this operator is for."""
    rows = BlockFrame.assign(load(spark, sf_dir, "orders").select("o_orderkey"), N, ["o_orderkey"]).collect([0, 4])
    return spark.range(1).select(F.lit(len(rows)).cast("long").alias("n"))


@R.frame(f"SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev(l_quantity), 6) AS sd, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE {LINE} IN (1, 7) GROUP BY 1")
def block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return lines(spark, sf_dir).subset([1, 7]).df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev(q), 6).alias("sd"), F.min(q).alias("lo"), F.max(q).alias("hi"))


@R.frame(f"SELECT s AS summary, v AS l_linenumber FROM (SELECT unnest(['count', 'min', '50%', 'max']) AS s, unnest([count(*)::VARCHAR, min(l_linenumber)::VARCHAR, quantile_disc(l_linenumber, 0.5)::VARCHAR, max(l_linenumber)::VARCHAR]) AS v FROM lineitem WHERE {LINE} IN (3))")
def block_summary_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = BlockFrame(lines(spark, sf_dir).df.select("l_linenumber", BLOCK), N)
    return f.describe([3], ["count", "min", "50%", "max"])


CHOSEN = ", ".join(map(str, choose(N, 2, 0)))


@R.frame(f"WITH x AS (SELECT l_quantity AS q, l_returnflag AS f FROM lineitem WHERE {LINE} IN ({CHOSEN})) SELECT unnest(['count', 'mean', 'stddev', 'min', '25%', '50%', '75%', 'max']) AS summary, unnest([count(*), round(avg(q), 4), round(stddev(q), 4), min(q), quantile_disc(q, 0.25), quantile_disc(q, 0.5), quantile_disc(q, 0.75), max(q)])::DOUBLE AS l_quantity, unnest([count(*)::VARCHAR, NULL, NULL, min(f), NULL, NULL, NULL, max(f)]) AS l_returnflag FROM x")
def block_summary_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All default statistics of two blocks chosen by a seed."""
    s = BlockFrame(lines(spark, sf_dir).df.select("l_quantity", "l_returnflag", BLOCK), N).describe(2)
    return s.select("summary", F.round(F.col("l_quantity").cast("double"), 4).alias("l_quantity"), "l_returnflag")


@R.frame(f"SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE {LINE} IN (0, 9)")
def block_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def double(batches):
        for rows in batches:
            yield rows[["l_orderkey", "l_linenumber"]].assign(twice=rows["l_quantity"] * 2)

    return lines(spark, sf_dir).map_rows(double, "l_orderkey long, l_linenumber int, twice double", [0, 9])


@R.frame(f"SELECT {LINE} AS block_id, max(l_quantity) AS v FROM lineitem WHERE {LINE} = 0 GROUP BY 1 UNION ALL SELECT {LINE}, min(l_quantity) FROM lineitem WHERE {LINE} = 3 GROUP BY 1")
def block_map_fn_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = BlockFrame(lines(spark, sf_dir).df.select("l_quantity", BLOCK), N)
    return f.local_by_id({0: lambda r: pd.DataFrame({"block_id": [0], "v": [r["l_quantity"].max()]}), 3: lambda r: pd.DataFrame({"block_id": [3], "v": [r["l_quantity"].min()]})}, "block_id long, v double")


@R.frame(f"SELECT 'train' AS role, count(*) AS n FROM orders WHERE {ORDER} IN ({', '.join(map(str, split(N, 3, 2, 1)[0]))}) UNION ALL SELECT 'predict', count(*) FROM orders WHERE {ORDER} IN ({', '.join(map(str, split(N, 3, 2, 1)[1]))})")
def block_train_predict_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = BlockFrame.assign(load(spark, sf_dir, "orders"), N, ["o_orderkey"])
    train, predict = split(N, 3, 2, seed=1)
    count = lambda ids, role: f.subset(ids).df.agg(F.lit(role).alias("role"), F.count("*").alias("n"))
    return count(train, "train").union(count(predict, "predict"))


@R.frame("SELECT range AS i, 10::BIGINT AS n FROM range(0, 3)")
def block_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One independent seeded permutation of block ids per job."""
    return spark.createDataFrame([(i, len(set(choose(N, N, i)))) for i in range(3)], "i long, n long")


@R.frame(f"SELECT count(*) AS n, round(avg(l_quantity), 9) AS mean, round(avg(l_quantity) - 1.96 * stddev(l_quantity) / sqrt(count(*)), 9) AS low, round(avg(l_quantity) + 1.96 * stddev(l_quantity) / sqrt(count(*)), 9) AS high FROM lineitem WHERE {LINE} IN (0, 1, 2)")
def block_mean_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = mean_estimate(lines(spark, sf_dir), "l_quantity", [0, 1, 2])
    return e.select("n", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@R.frame(f"SELECT round(count(*) * 10 / 3.0, 6)::DOUBLE AS count, round(sum(l_quantity) * 10 / 3.0, 4)::DOUBLE AS sum FROM lineitem WHERE {LINE} IN (4, 5, 6)")
def block_count_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_estimate(lines(spark, sf_dir), "l_quantity", [4, 5, 6]).select(F.round("count", 6).alias("count"), F.round("sum", 4).alias("sum"))


@R.frame(f"SELECT l_returnflag, count(*) * 5 AS n FROM lineitem WHERE {LINE} IN (0, 5) GROUP BY 1")
def block_count_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).subset([0, 5]).df.groupBy("l_returnflag").agg((F.count("*") * 5).alias("n"))


@R.frame("SELECT count(*) AS n, 10::BIGINT AS blocks, true AS fair FROM orders")
def block_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random assignment: every block near a tenth of all rows."""
    per = BlockFrame.assign(load(spark, sf_dir, "orders"), N, seed=5).df.groupBy(BLOCK).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), (F.max("n") < 1.5 * F.avg("n")).alias("fair"))


def _roundtrip(kind: str):
    oracle = "SELECT n_nationkey::VARCHAR AS k, n_name AS name FROM nation" if kind != "text" else "SELECT n_name AS value FROM nation"

    @R.frame(oracle, name=f"block_store_{kind}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = load(spark, sf_dir, "nation")
        df = n.select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("name")) if kind != "text" else n.select(F.col("n_name").alias("value"))
        store = BlockStore(spark, scratch(spark, sf_dir, "blocks"))
        target = store.create(df, 4, "geo", f"nation.{kind}", kind, keys=["k"] if kind != "text" else ["value"])
        return store.open(target, df.withColumn(BLOCK, F.lit(0)).schema).df.drop(BLOCK)

    return query


for _kind in ("csv", "json", "parquet", "orc", "text"):
    _roundtrip(_kind)


@R.frame("SELECT 'parquet' AS kind, 6::BIGINT AS blocks, count(*) AS n FROM (SELECT * FROM supplier)")
def block_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = BlockStore(spark, scratch(spark, sf_dir, "blocks"))
    target = store.create(load(spark, sf_dir, "supplier"), 6, "geo", "supplier", keys=["s_suppkey"])
    about = store.about(target)
    rows = store.take(target, about["names"])
    return rows.agg(F.lit(about["kind"]).alias("kind"), F.lit(len(about["names"])).cast("long").alias("blocks"), F.count("*").alias("n"))


@R.frame("SELECT count(*) AS n, max(s_acctbal) AS top FROM supplier WHERE (('0x' || substr(md5(s_suppkey::VARCHAR), 1, 8))::BIGINT) % 6 IN (0, 1)")
def block_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = BlockStore(spark, scratch(spark, sf_dir, "blocks_apply"))
    target = store.create(load(spark, sf_dir, "supplier"), 6, "geo", "supplier", keys=["s_suppkey"])
    return store.apply(target, ["block_id=0", "block_id=1"], lambda r: pd.DataFrame({"n": [len(r)], "top": [r["s_acctbal"].max()]}), "n long, top double")


@R.frame("SELECT count(*) AS n, 5::BIGINT AS partitions, 5::BIGINT AS blocks FROM customer")
def block_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file, one partition, one block."""
    path = f"{scratch(spark, sf_dir, 'block_reader')}/customer"
    load(spark, sf_dir, "customer").repartition(5).write.mode("overwrite").parquet(path)
    df = BlockReader(spark).parquet(path)
    per = df.groupBy(F.spark_partition_id().alias("p"), BLOCK).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n"), F.countDistinct("p").alias("partitions"), F.countDistinct(BLOCK).alias("blocks"))


def _one_file_one_block(kind: str):
    @R.frame("SELECT 4::BIGINT AS partitions, 4::BIGINT AS blocks, true AS one, count(*) AS n, max(c_name) AS last FROM customer", name=f"block_reader_{kind}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Of two folders whose files have the same names: every file a partition and a block of its own."""
        base, names = f"{scratch(spark, sf_dir, 'block_reader')}/{kind}", load(spark, sf_dir, "customer").select(F.col("c_name").alias("value"))
        paths = [f"{base}/first", f"{base}/second"]
        for path, wanted in zip(paths, (0, 1), strict=True):
            names.where(F.pmod(F.hash("value"), F.lit(2)) == wanted).repartition(2).write.mode("overwrite").format(kind).save(path)
        reader = BlockReader(spark)
        df = getattr(reader, kind)(paths).withColumnRenamed("_c0", "value")
        per = df.groupBy(F.spark_partition_id().alias("p"), BLOCK).agg(F.count("*").alias("n"), F.max("value").alias("last"))
        return per.agg(F.countDistinct("p").alias("partitions"), F.countDistinct(BLOCK).alias("blocks"), (F.count("*") == 4).alias("one"), F.sum("n").alias("n"), F.max("last").alias("last"))

    return query


for _kind in ("csv", "json", "orc", "text"):
    _one_file_one_block(_kind)

SUPPLIERS = "(('0x' || substr(md5(s_suppkey::VARCHAR), 1, 8))::BIGINT) % 6"


@R.frame(f"SELECT {SUPPLIERS} AS block_id, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier WHERE {SUPPLIERS} IN (1, 4) GROUP BY 1")
def block_take_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named blocks, each as a frame of its own."""
    store = BlockStore(spark, scratch(spark, sf_dir, "blocks_list"))
    target = store.create(load(spark, sf_dir, "supplier"), 6, "geo", "supplier", keys=["s_suppkey"])
    one, four = store.take_each(target, ["block_id=1", "block_id=4"])
    count = lambda df: df.groupBy(F.col(BLOCK).cast("long").alias(BLOCK)).agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"))
    return count(one).union(count(four))


@R.frame(f"SELECT count(*) AS n, round(sum(s_acctbal) / count(*), 6) AS mean FROM supplier WHERE {SUPPLIERS} IN (2, 3)")
def block_apply_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of a matrix, which the rows are made into first."""
    store = BlockStore(spark, scratch(spark, sf_dir, "blocks_transfer"))
    target = store.create(load(spark, sf_dir, "supplier"), 6, "geo", "supplier", keys=["s_suppkey"])
    f = lambda m: pd.DataFrame({"n": [m.shape[0]], "mean": [round(float(m.mean()), 6) if len(m) else None]})
    return store.apply(target, ["block_id=2", "block_id=3"], f, "n long, mean double", lambda rows: rows[["s_acctbal"]].to_numpy())


@R.frame(f"SELECT round(greatest(n, n * 5 - 1.96 * sqrt(n * 0.8) * 5), 6)::DOUBLE AS low, (n * 5)::DOUBLE AS count, round(n * 5 + 1.96 * sqrt(n * 0.8) * 5, 6)::DOUBLE AS high, n * 5 - 4.0 * sqrt(n * 0.8) * 5 < whole AND whole < n * 5 + 4.0 * sqrt(n * 0.8) * 5 AS holds FROM (SELECT count_if({LINE} IN (2, 6)) AS n, count(*) AS whole FROM lineitem)")
def block_count_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lines(spark, sf_dir)
    wide = count_bounds(f, [2, 6], z=4.0).crossJoin(f.df.agg(F.count("*").alias("whole"))).select(((F.col("low") < F.col("whole")) & (F.col("whole") < F.col("high"))).alias("holds"))
    return count_bounds(f, [2, 6]).select(*[F.round(c, 6).alias(c) for c in ("low", "count", "high")]).crossJoin(wide)  # one row each


@R.frame(f"SELECT l_returnflag, round(greatest(n, n * 5 - 1.96 * sqrt(n * 0.8) * 5), 6)::DOUBLE AS low, (n * 5)::DOUBLE AS count, round(n * 5 + 1.96 * sqrt(n * 0.8) * 5, 6)::DOUBLE AS high FROM (SELECT l_returnflag, count(*) AS n FROM lineitem WHERE {LINE} IN (2, 6) GROUP BY 1)")
def block_count_by_key_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_bounds(lines(spark, sf_dir), [2, 6], ["l_returnflag"]).select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("low", "count", "high")])


@R.frame(f"SELECT round(s * 5 - 1.96 * sqrt(q * 0.8) * 5, 4) AS low, round(s * 5, 4) AS sum, round(s * 5 + 1.96 * sqrt(q * 0.8) * 5, 4) AS high FROM (SELECT sum(l_quantity) AS s, sum(l_quantity ** 2) AS q FROM lineitem WHERE {LINE} IN (2, 6))")
def block_sum_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_bounds(lines(spark, sf_dir), "l_quantity", [2, 6]).select(*[F.round(c, 4).alias(c) for c in ("low", "sum", "high")])


@R.frame("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR) LIMIT 100")
def sample_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    return reservoir(o, 100, ["o_orderkey"], o.count())


# Itemsets: baskets are suppliers' lines by part brand. The SQL lists pairs and triples only, so the queries stop there.
BASKETS = "SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey"


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item")).distinct()


def basket_blocks(spark: SparkSession, sf_dir: str) -> BlockFrame:
    grouped = baskets(spark, sf_dir).groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return BlockFrame(grouped.withColumn(BLOCK, keyed_block(4, "basket")), 4)


LOCAL = f"""
WITH b AS ({BASKETS}), k AS (SELECT *, (('0x' || substr(md5(basket::VARCHAR), 1, 8))::BIGINT) % 4 AS block_id FROM b),
pair AS (SELECT x.block_id, '{{' || x.item || ',' || y.item || '}}' AS itemset, count(*) AS support FROM k x JOIN k y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2),
triple AS (SELECT x.block_id, '{{' || x.item || ',' || y.item || ',' || z.item || '}}' AS itemset, count(*) AS support FROM k x JOIN k y ON x.basket = y.basket AND x.item < y.item JOIN k z ON y.basket = z.basket AND y.item < z.item GROUP BY 1, 2),
local AS (SELECT * FROM pair WHERE support >= 4 UNION ALL SELECT * FROM triple WHERE support >= 4)
"""


@R.frame(LOCAL + "SELECT block_id, itemset, support FROM local")
def itemset_local_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.local_itemsets(basket_blocks(spark, sf_dir), "items", 4, most_items=3)


@R.frame(LOCAL + "SELECT itemset, (sum(support) // count(*))::BIGINT AS support FROM local GROUP BY itemset HAVING count(*) >= 2")
def itemset_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.vote_itemsets(lg.local_itemsets(basket_blocks(spark, sf_dir), "items", 4, most_items=3), 4)


@R.frame(
    LOCAL
    + ", cand AS (SELECT DISTINCT itemset FROM local), parts AS (SELECT itemset, unnest(string_split(trim(itemset, '{}'), ',')) AS item FROM cand), met AS (SELECT basket, itemset, count(*) AS m FROM b JOIN parts USING (item) GROUP BY 1, 2), full_ AS (SELECT itemset, count(*) AS c FROM met WHERE m = len(string_split(itemset, ',')) GROUP BY 1) SELECT itemset, round(c / (SELECT count(DISTINCT basket) FROM b), 9) AS support FROM full_ WHERE c / (SELECT count(DISTINCT basket) FROM b) >= 0.003"
)
def itemset_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = lg.local_itemsets(basket_blocks(spark, sf_dir), "items", 4, most_items=3)
    return lg.recount_itemsets(candidates, baskets(spark, sf_dir), "basket", "item", 0.003).select("itemset", F.round("support", 9).alias("support"))


SHARED = LOCAL.replace("support >= 4", "support >= ceil(0.01 * (SELECT count(DISTINCT basket) FROM k n WHERE n.block_id = s.block_id))").replace("FROM pair WHERE", "FROM pair s WHERE").replace("FROM triple WHERE", "FROM triple s WHERE")


@R.frame(SHARED + "SELECT block_id, itemset, support FROM local")
def itemset_local_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Itemsets in a hundredth of a block's baskets."""
    return lg.local_itemsets(basket_blocks(spark, sf_dir), "items", 0.01, most_items=3)


@R.frame("SELECT '1 ' || n_nationkey || ' ' || n_regionkey AS line, [1, n_nationkey, n_regionkey]::VARCHAR AS items FROM nation")
def itemset_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = load(spark, sf_dir, "nation").select(F.concat_ws(" ", F.lit(1), "n_nationkey", "n_regionkey").alias("line"))
    items = F.transform(F.split("line", " "), lambda x: x.cast("int"))
    return text.select("line", F.concat(F.lit("["), F.array_join(items.cast("array<string>"), ", "), F.lit("]")).alias("items"))


# Clustering and classification.
@R.frame()
def cluster_local_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = lg.local_centres(vectors(spark, sf_dir), "embedding", 3)
    return local.union(lg.global_centres(local, 3)).select("block_id", "place", F.size("centre").alias("width"), F.round(F.aggregate("centre", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@R.frame()
def cluster_best_of_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = lg.local_centres(vectors(spark, sf_dir), "embedding", 2, lg.best_of_trials)
    return lg.global_centres(local, 2, method=lg.best_of_trials).select("place", F.size("centre").alias("width"))


WIDE = f"e AS (SELECT label, {VECTOR} AS b, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), c AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2), p AS (SELECT b, i, avg(x) AS x FROM e GROUP BY 1, 2)"


@R.frame(f"WITH {WIDE}, d AS (SELECT label, b, sum((c.x - p.x) ** 2) AS d FROM c JOIN p USING (i) GROUP BY 1, 2) SELECT round(sum(m), 6) AS distance FROM (SELECT min(d) AS m FROM d GROUP BY label)")
def cluster_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the labels' mean vectors to the blocks' mean vectors."""
    f = vectors(spark, sf_dir)
    mean = F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(64)]).alias("centre")
    return lg.centre_distance(f.df.groupBy(F.col("label").alias("id")).agg(mean), f.df.groupBy(BLOCK).agg(mean)).select(F.round("distance", 6).alias("distance"))


@R.frame("SELECT greatest(p, 1 - p) AS purity FROM (SELECT avg(CASE WHEN (embedding[1] > 0)::INTEGER = label % 2 THEN 1 ELSE 0 END) AS p FROM embeddings)")
def cluster_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return lg.purity(e.select((F.col("label") % 2).alias("label"), (F.col("embedding")[0] > 0).cast("int").alias("predicted")))


def _classifier(name: str, make):
    @R.frame(name=name)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = vectors(spark, sf_dir)
        models = lg.trimmed(lg.local_models(f.subset([0, 1, 2]), "embedding", "label", make, "vec_id"))
        return lg.weighted_accuracy(lg.vote_predictions(f.subset([3, 4]), models, "embedding", "vec_id", "label"), "label")

    return query


_classifier("classify_lr", lg.Logistic)
_classifier("classify_tree", lg.Tree)
_classifier("classify_forest", lg.Forest)

SCORES = "SELECT c_nationkey::BIGINT AS block_id, round(avg(c_acctbal), 4) AS accuracy FROM customer GROUP BY 1"


@R.frame(f"WITH s AS ({SCORES}), r AS (SELECT *, row_number() OVER (ORDER BY accuracy, block_id) AS u, count(*) OVER () AS n FROM s), c AS (SELECT *, greatest(1, floor(n * 0.1)) AS k FROM r), b AS (SELECT max(CASE WHEN u = k + 1 THEN accuracy END) AS lo, max(CASE WHEN u = n - k THEN accuracy END) AS hi FROM c) SELECT block_id, accuracy, accuracy AS weight FROM c, b WHERE accuracy BETWEEN lo AND hi")
def score_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("block_id")).agg(F.round(F.avg("c_acctbal"), 4).alias("accuracy"))
    return lg.trimmed(s)


VOTES = "SELECT vec_id, m, (label + (vec_id % (m + 2) = 0)::INTEGER) AS vote, label FROM embeddings, (SELECT unnest([1, 2, 3, 4, 5]) AS m)"


@R.frame(f"SELECT vec_id, vote FROM (SELECT vec_id, vote, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, vote) AS r FROM ({VOTES}) GROUP BY vec_id, vote) WHERE r = 1")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of five simulated members per row; ties go to the smaller class."""
    v = _votes(spark, sf_dir).groupBy("vec_id", "vote").agg(F.count("*").alias("c"))
    return v.groupBy("vec_id").agg(F.max_by("vote", F.struct("c", -F.col("vote"))).alias("vote"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("m"))
    return e.withColumn("vote", F.col("label") + (F.col("vec_id") % (F.col("m") + 2) == 0).cast("int"))


@R.frame(f"WITH w AS (SELECT vec_id, vote FROM (SELECT vec_id, vote, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, vote) AS r FROM ({VOTES}) GROUP BY vec_id, vote) WHERE r = 1), p AS (SELECT {VECTOR} AS b, avg((e.label = w.vote)::INTEGER) AS a, count(*) AS n FROM embeddings e JOIN w USING (vec_id) GROUP BY 1) SELECT round(sum(a * n) / sum(n), 9) AS accuracy, sum(n)::BIGINT AS n FROM p")
def weighted_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = majority_vote(spark, sf_dir).select("vec_id", F.col("vote").alias("predicted"))
    met = vectors(spark, sf_dir).df.join(won, "vec_id")
    return lg.weighted_accuracy(met, "label").select(F.round("accuracy", 9).alias("accuracy"), "n")


# Generators.
BATCHES = gen.support_batches([2, 3], seed=3) + gen.support_batches([3], stratified=True, seed=4)
for _i, _b in enumerate(BATCHES):
    _b.number = _i
PLANTED = ", ".join(f"('{'-'.join(map(str, x))}', {b.number})" for b in BATCHES[:2] for x in b.shares)


@R.frame(f"SELECT itemset, batch, true AS close FROM (VALUES {PLANTED}) t(itemset, batch)")
def gen_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every planted itemset of every batch is drawn about as often as planted: within four standard deviations."""
    count, batches = 20_000, BATCHES[:2]
    rows = gen.transactions(spark, batches, count, seed=1)
    of = F.create_map(*[x for b in batches for x in (F.lit(b.number), F.array(*[F.lit(i) for i in sorted({i for s in b.shares for i in s})]))])
    drawn = rows.select("items", F.explode(F.array(*[F.lit(b.number) for b in batches])).alias("batch")).select("batch", F.array_join(F.array_intersect(of[F.col("batch")], "items"), "-").alias("itemset"))
    n = drawn.groupBy("batch", "itemset").agg((F.count("*") / count).alias("drawn"))
    t = gen.truth(spark, batches).select(F.array_join("itemset", "-").alias("itemset"), "batch", "proportion")
    met, p = t.join(n, ["batch", "itemset"], "left"), F.col("proportion")
    return met.select("itemset", "batch", (F.abs(F.coalesce("drawn", F.lit(0.0)) - p) < 4 * F.sqrt(p * (1 - p) / count) + 1e-4).alias("close"))


@R.frame("SELECT 250000 AS transactions, 3 AS full_size, true AS rising, true AS within FROM range(1)")
def gen_itemset_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many transactions fill a number of bytes; a stratified batch keeps the bounds that it was given."""
    planned = gen.count_for_bytes(1_000_000, [gen.SupportBatch(0, {(1, 2): 0.25, (3,): 0.5})])
    b = BATCHES[2]
    full = max(b.shares, key=len)
    subsets = [p for s, p in b.shares.items() if s != full and set(s) <= set(full)]
    within = 0.05 <= b.shares[full] <= 0.1 and abs(sum(subsets)) <= 0.15 - b.shares[full] + 1e-9
    return spark.createDataFrame([(planned, len(full), all(p > 0 for p in subsets), bool(within))], "transactions int, full_size int, rising boolean, within boolean")


@R.frame("SELECT unnest([0, 1, 2]) AS label, unnest([300, 200, 100])::BIGINT AS n, unnest([300, 200, 100])::BIGINT AS sound, true AS centred")
def gen_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform draws keep their bounds, a rotated constant lies on its line, a plane's points lie within its noise; means lie at the shifts."""
    kinds = [gen.Cluster([gen.gaussian(0, 0.1), gen.uniform(-0.1, 0.1)]), gen.Cluster([gen.gamma(2, 0.05), gen.constant(0)], [gen.rotation(2, 0, 1, 0.5)]), gen.Cluster([gen.gaussian(0, 0.1)] * 2, [gen.Hyperplane([1.0, 1.0], 0.0, gen.gaussian(0, 0.01))])]
    shifts = gen.grid_shift(3, 2, 10.0, seed=2)
    df = gen.clusters(spark, kinds, [300, 200, 100], shifts)
    place = F.create_map(*[x for i, s in enumerate(shifts) for x in (F.lit(i), F.array(*[F.lit(float(v)) for v in s]))])[F.col("label")]
    x, y = F.col("features")[0] - place[0], F.col("features")[1] - place[1]
    sound = F.when(F.col("label") == 0, F.abs(y) <= 0.1).when(F.col("label") == 1, (F.abs(y - x * F.tan(F.lit(0.5))) < 1e-9) & (x >= 0)).otherwise(F.abs(x + y) < 5 * 0.01 * 2**0.5)
    # Standard deviations of the means: gamma draws have the mean 0.1, turned by 0.5.
    off = F.when(F.col("label") == 1, F.greatest(F.abs(F.avg(x) - 0.1 * F.cos(F.lit(0.5))), F.abs(F.avg(y) - 0.1 * F.sin(F.lit(0.5))))).otherwise(F.greatest(F.abs(F.avg(x)), F.abs(F.avg(y))))
    return df.groupBy("label").agg(F.count("*").alias("n"), F.count_if(sound).alias("sound"), (off < 0.05).alias("centred"))
