"""Feature transformers, statistics, evaluators and learners over the tables."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml import clustering as mc
from pyspark.ml import evaluation as me
from pyspark.ml import feature as mf
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import ChiSquareTest, Correlation, KolmogorovSmirnovTest, Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans.registry import Registry
from quarry.session import load

R = Registry()


def part_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"), "p_retailprice", array_to_vector(F.array(F.col("p_size").cast("double"), "p_retailprice")).alias("v"))


def at(c: str, i: int, places: int = 6):
    return F.round(vector_to_array(c)[i], places)


@R.frame("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS standard, round(p_size / max(abs(p_size)) OVER ()::DOUBLE, 6) AS scaled, (p_size > 25)::INTEGER::DOUBLE AS high, round(p_size / sqrt(p_size ** 2 + p_retailprice ** 2), 6) AS unit, (p_size * 2)::DOUBLE AS doubled FROM part")
def ml_scalers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = part_vectors(spark, sf_dir)
    stages = [
        mf.StandardScaler(inputCol="v", outputCol="s", withMean=True, withStd=True),
        mf.MaxAbsScaler(inputCol="v", outputCol="m"),
        mf.Binarizer(threshold=25.0, inputCol="size", outputCol="high"),
        mf.Normalizer(p=2.0, inputCol="v", outputCol="n"),
        mf.ElementwiseProduct(scalingVec=Vectors.dense([2.0, 0.5]), inputCol="v", outputCol="e"),
    ]
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.select("p_partkey", at("s", 0).alias("standard"), at("m", 0).alias("scaled"), "high", at("n", 0).alias("unit"), at("e", 0).alias("doubled"))


@R.frame("SELECT p_partkey, 5 AS terms, round(p_size::DOUBLE ** 2, 4) AS square, p_retailprice AS second, round((p_size + p_retailprice) / sqrt(2), 4) AS wave FROM part")
def ml_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = part_vectors(spark, sf_dir)
    stages = [mf.PolynomialExpansion(degree=2, inputCol="v", outputCol="x"), mf.VectorSlicer(inputCol="v", outputCol="c", indices=[1]), mf.DCT(inputCol="v", outputCol="d"), mf.VectorSizeHint(inputCol="v", size=2)]
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.select("p_partkey", F.size(vector_to_array("x")).alias("terms"), at("x", 1, 4).alias("square"), vector_to_array("c")[0].alias("second"), at("d", 0, 4).alias("wave"))


@R.frame("WITH t AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), n AS (SELECT count(*) AS n FROM part), d AS (SELECT w, ln((n + 1.0::DOUBLE) / (count(DISTINCT p_partkey) + 1)) AS idf FROM t, n GROUP BY w, n) SELECT p_partkey, len(string_split(lower(p_name), ' '))::INTEGER AS words, list_aggregate(list_filter(string_split(lower(p_name), ' '), lambda x: x NOT IN ('red', 'ring', 'of')), 'string_agg', ' ') AS kept, greatest(len(string_split(lower(p_name), ' ')) - 1, 0)::INTEGER AS pairs, (SELECT round(sum(idf), 6) FROM t JOIN d USING (w) WHERE t.p_partkey = part.p_partkey) AS weight FROM part")
def ml_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, words that aren't stop words, pairs, and the sum of each name's hashed term frequencies by inverse document frequency."""
    df = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    stages = [
        mf.Tokenizer(inputCol="p_name", outputCol="w"),
        mf.StopWordsRemover(inputCol="w", outputCol="k", stopWords=["red", "ring", "of"]),
        mf.NGram(n=2, inputCol="w", outputCol="g"),
        mf.HashingTF(numFeatures=1 << 20, inputCol="w", outputCol="t"),
        mf.IDF(inputCol="t", outputCol="i"),
    ]
    out = Pipeline(stages=stages).fit(df).transform(df)
    kept = F.when(F.size("k") > 0, F.array_join("k", " "))
    # A sparse vector as JSON text, for its dense array would have a million places.
    values = F.from_json(F.get_json_object(F.to_json(F.struct("i")), "$.i.values"), "array<double>")
    return out.select("p_partkey", F.size("w").alias("words"), kept.alias("kept"), F.size("g").alias("pairs"), F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("weight"))


@R.frame("SELECT p_brand, count(*) AS n, 1.0::DOUBLE AS total FROM part GROUP BY 1")
def ml_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "part").select("p_brand")
    out = Pipeline(stages=[mf.StringIndexer(inputCol="p_brand", outputCol="i"), mf.OneHotEncoder(inputCols=["i"], outputCols=["o"], dropLast=False)]).fit(df).transform(df)
    return out.groupBy("p_brand").agg(F.count("*").alias("n"), F.max(F.aggregate(vector_to_array("o"), F.lit(0.0), lambda a, x: a + x)).alias("total"))


@R.frame("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def ml_sql_transformer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mf.SQLTransformer(statement="SELECT p_brand, count(*) AS n FROM __THIS__ GROUP BY p_brand").transform(load(spark, sf_dir, "part"))


@R.frame("SELECT round(corr(p_size, p_retailprice), 6) AS pearson, round((SELECT corr(a, b) FROM (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)), 6) AS spearman, round(avg(p_size), 6) AS mean, round(var_samp(p_size), 4) AS variance FROM part")
def ml_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = part_vectors(spark, sf_dir)
    matrix = lambda kind: float(Correlation.corr(df, "v", kind).first()[0].toArray()[0, 1])
    s = df.select(Summarizer.metrics("mean", "variance").summary(F.col("v")).alias("s")).select(at("s.mean", 0).alias("mean"), at("s.variance", 0, 4).alias("variance"))
    return s.select(F.round(F.lit(matrix("pearson")), 6).alias("pearson"), F.round(F.lit(matrix("spearman")), 6).alias("spearman"), "mean", "variance")


@R.frame()
def ml_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = part_vectors(spark, sf_dir).withColumn("label", (F.col("size") % 3).cast("double")).withColumn("k", array_to_vector(F.array(F.col("size") % 5)))
    chi = ChiSquareTest.test(df, "k", "label").select(at("pValues", 0).alias("chi"))
    ks = KolmogorovSmirnovTest.test(df, "p_retailprice", "norm", 1200.0, 300.0).select(F.round("pValue", 6).alias("ks"))
    return chi.crossJoin(ks)  # one row each


@R.frame("WITH m AS (SELECT var_samp(embedding[1]::DOUBLE) AS a, var_samp(embedding[2]::DOUBLE) AS b, covar_samp(embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS c FROM embeddings) SELECT round((a + b + sqrt((a - b) ** 2 + 4 * c ** 2)) / 2 / (a + b), 6) AS first_share, round((a + b - sqrt((a - b) ** 2 + 4 * c ** 2)) / 2 / (a + b), 6) AS second_share FROM m")
def ml_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of variance of two components, which have a closed form in two dimensions."""
    e = load(spark, sf_dir, "embeddings").select(array_to_vector(F.slice(F.col("embedding").cast("array<double>"), 1, 2)).alias("v"))
    shares = mf.PCA(k=2, inputCol="v", outputCol="p").fit(e).explainedVariance.toArray()
    return spark.createDataFrame([tuple(round(float(x), 6) for x in shares)], "first_share double, second_share double")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select((F.col("o_totalprice") > 150000).cast("double").alias("label"), (F.col("o_custkey") % 2).cast("double").alias("prediction"), (F.col("o_custkey") % 100 / 100.0).cast("double").alias("rawPrediction"))


BASE = "SELECT (o_totalprice > 150000)::INTEGER AS y, o_custkey % 2 AS p FROM orders"


@R.frame(f"WITH b AS ({BASE}), c AS (SELECT count(*) AS n, count_if(y = p) AS hit, count_if(y = 1 AND p = 1) AS tp, count_if(p = 1) AS pp, count_if(y = 1) AS yp FROM b) SELECT round(hit / n, 6) AS accuracy, round(tp / pp, 6) AS precision_1, round(tp / yp, 6) AS recall_1, round(sqrt((n - hit) / n), 6) AS rmse, round((n - hit) / n, 6) AS mae FROM c")
def ml_evaluators(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predictions(spark, sf_dir)
    m = lambda name: me.MulticlassClassificationEvaluator(metricName=name, metricLabel=1.0).evaluate(df)
    r = lambda name: me.RegressionEvaluator(metricName=name).evaluate(df)
    values = [m("accuracy"), m("precisionByLabel"), m("recallByLabel"), r("rmse"), r("mae")]
    return spark.createDataFrame([tuple(round(float(v), 6) for v in values)], "accuracy double, precision_1 double, recall_1 double, rmse double, mae double")


@R.frame("WITH s AS (SELECT (o_totalprice > 150000)::INTEGER AS y, o_custkey % 100 AS r FROM orders), k AS (SELECT r, count_if(y = 1) AS p, count_if(y = 0) AS n FROM s GROUP BY r), c AS (SELECT *, sum(n) OVER (ORDER BY r) - n AS below FROM k) SELECT round(sum(p * (below + n / 2)) / ((SELECT count_if(y = 1) FROM s) * (SELECT count_if(y = 0) FROM s)), 4) AS auc FROM c")
def ml_area_under_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    auc = me.BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0).evaluate(predictions(spark, sf_dir))
    return spark.createDataFrame([(round(float(auc), 4),)], "auc double")


@R.frame("SELECT n_nationkey, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS k_means, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS bisecting, 1.0::DOUBLE AS silhouette FROM nation")
def ml_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations at their region's place: the clusters are the regions, named by their least nation."""
    n = load(spark, sf_dir, "nation").select("n_nationkey", array_to_vector(F.array(F.pow(F.lit(2.0), F.col("n_regionkey")))).alias("features"))
    least = lambda c, out: F.min("n_nationkey").over(Window.partitionBy(c)).alias(out)
    near = mc.KMeans(k=5, seed=3, initSteps=10).fit(n).transform(n)
    split = mc.BisectingKMeans(k=5, seed=3).fit(n).transform(n).select("n_nationkey", F.col("prediction").alias("half"))
    silhouette = round(float(me.ClusteringEvaluator().evaluate(near)), 6)
    return near.join(split, "n_nationkey").select("n_nationkey", least("prediction", "k_means"), least("half", "bisecting"), F.lit(silhouette).alias("silhouette"))


@R.frame("SELECT round(avg((l_returnflag = 'R')::INTEGER), 3) AS share, round(avg(CASE WHEN l_returnflag = 'R' THEN l_tax END), 3) AS low, round(avg(CASE WHEN l_returnflag <> 'R' THEN 50 + l_tax END), 3) AS high FROM lineitem")
def ml_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Gaussians that lie apart: their weights and means are those of the rows that made them."""
    x = load(spark, sf_dir, "lineitem").select(array_to_vector(F.array(F.when(F.col("l_returnflag") == "R", F.col("l_tax")).otherwise(50 + F.col("l_tax")))).alias("features"))
    m = mc.GaussianMixture(k=2, seed=3, maxIter=50).fit(x)
    (low, share), (high, _) = sorted((float(g.mean[0]), w) for g, w in zip(m.gaussians, m.weights, strict=True))
    return spark.createDataFrame([(round(share, 3), round(low, 3), round(high, 3))], "share double, low double, high double")


@R.frame("SELECT range AS id, (range < 30)::INTEGER AS with_first FROM range(50)")
def ml_power_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of 30 and 20, all linked within, and one weak link between them."""
    i = spark.range(50).toDF("src").join(spark.range(50).toDF("dst"), F.expr("src < dst AND (src < 30) = (dst < 30)"))
    g = i.withColumn("w", F.lit(1.0)).union(spark.sql("SELECT 0L, 30L, 0.01D"))
    out = mc.PowerIterationClustering(k=2, maxIter=20, weightCol="w", initMode="degree").assignClusters(g)
    first = out.where("id = 0").select(F.col("cluster").alias("first"))
    return out.crossJoin(first).select("id", (F.col("cluster") == F.col("first")).cast("int").alias("with_first"))  # one row


@R.frame("WITH o AS (SELECT (o_totalprice > 150000)::INTEGER AS y, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INTEGER AS x FROM orders), g AS (SELECT x, ln(sum(y) / (count(*) - sum(y))::DOUBLE) AS odds FROM o GROUP BY x) SELECT round(max(CASE WHEN x = 0 THEN odds END), 3) AS intercept, round(max(CASE WHEN x = 1 THEN odds END) - max(CASE WHEN x = 0 THEN odds END), 3) AS slope, 0.0::DOUBLE AS chosen, (SELECT count(*) FROM part WHERE p_size > 25) AS large FROM g")
def ml_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic regression on one mark is the log odds; boosted trees find a cut; cross-validation prefers no penalty to a crushing one."""
    x = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("double")
    o = load(spark, sf_dir, "orders").select((F.col("o_totalprice") > 150000).cast("double").alias("label"), array_to_vector(F.array(x)).alias("features"))
    fitted = LogisticRegression(maxIter=100, tol=1e-10).fit(o)
    df = part_vectors(spark, sf_dir).select(array_to_vector(F.array("size")).alias("features"), (F.col("size") > 25).cast("double").alias("label"))
    lr = LogisticRegression(maxIter=50)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 1e6]).build()
    best = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=me.MulticlassClassificationEvaluator(metricName="logLoss"), numFolds=2, seed=1).fit(df)
    trees = GBTClassifier(maxIter=3, maxDepth=3, seed=1, maxBins=64).fit(df).transform(df)
    large = trees.where("prediction = 1").count()
    return spark.createDataFrame([(round(float(fitted.intercept), 3), round(float(fitted.coefficients[0]), 3), float(best.bestModel.getRegParam()), large)], "intercept double, slope double, chosen double, large long")


@R.frame("SELECT round(regr_slope(p_retailprice, p_size), 4) AS slope, round(regr_intercept(p_retailprice, p_size), 3) AS intercept FROM part")
def ml_linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "part").select(F.array(F.col("p_size").cast("double")).alias("x"), F.col("p_retailprice").alias("label")).select(array_to_vector("x").alias("features"), "label")
    m = LinearRegression(solver="normal").fit(df)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 4), round(float(m.intercept), 3))], "slope double, intercept double")


BASKET = "SELECT DISTINCT l_orderkey AS b, l_linenumber AS i FROM lineitem"


@R.frame(f"WITH b AS ({BASKET}), n AS (SELECT count(DISTINCT b) AS n FROM b), p AS (SELECT x.i AS a, y.i AS c, count(*) AS f FROM b x JOIN b y ON x.b = y.b AND x.i <> y.i GROUP BY 1, 2), s AS (SELECT i, count(*) AS f FROM b GROUP BY 1) SELECT p.a AS antecedent, p.c AS consequent, round(p.f / s.f, 6) AS confidence FROM p JOIN s ON s.i = p.a, n WHERE p.f >= 0.2 * n.n AND p.f / s.f >= 0.5")
def ml_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("items"))
    rules = FPGrowth(itemsCol="items", minSupport=0.2, minConfidence=0.5).fit(b).associationRules.where(F.size("antecedent") == 1)
    return rules.select(F.col("antecedent")[0].alias("antecedent"), F.col("consequent")[0].alias("consequent"), F.round("confidence", 6).alias("confidence"))


@R.frame("WITH f AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1, 2), n AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT x.event_type AS first, y.event_type AS then_, count(*) AS freq FROM f x JOIN f y ON x.user_id = y.user_id AND x.a < y.z GROUP BY 1, 2")
def ml_prefix_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = load(spark, sf_dir, "events").withColumn("all", F.collect_list(F.array("event_type")).over(w)).groupBy("user_id").agg(F.first("all").alias("sequence"))
    found = PrefixSpan(minSupport=0.0, maxPatternLength=2).findFrequentSequentialPatterns(s).where((F.size("sequence") == 2))
    return found.select(F.col("sequence")[0][0].alias("first"), F.col("sequence")[1][0].alias("then_"), "freq")


@R.frame("SELECT range AS a, range + 10 AS b FROM range(10)")
def ml_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate similarity join of hashed sets finds each set's twin and nothing else."""
    df = spark.range(20).select("id", (F.col("id") % 10).alias("twin")).select("id", mf_sets())
    model = mf.MinHashLSH(inputCol="v", outputCol="h", numHashTables=3, seed=1).fit(df)
    near = model.approxSimilarityJoin(df, df, 0.1).where("datasetA.id < datasetB.id")
    return near.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"))


def mf_sets():
    """Twins have equal sets of five of a hundred elements."""
    return array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.when(F.pmod(F.xxhash64("twin", k), F.lit(20)) == 0, 1.0).otherwise(F.when(k == F.col("twin"), 1.0).otherwise(0.0)))).alias("v")


@R.frame("SELECT round(avg(1 / sqrt(2 * pi()) / 5 * exp(0 - ((p_size - 20) / 5.0::DOUBLE) ** 2 / 2)), 8) AS at_20, round(avg(1 / sqrt(2 * pi()) / 5 * exp(0 - ((p_size - 40) / 5.0::DOUBLE) ** 2 / 2)), 8) AS at_40 FROM part")
def ml_kernel_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian kernel density of a column at given points, as one aggregate."""
    import math

    at_ = lambda x, h=5.0: F.round(F.avg(F.exp(-(((F.col("p_size") - x) / h) ** 2) / 2)) / (math.sqrt(2 * math.pi) * h), 8)
    return load(spark, sf_dir, "part").agg(at_(20).alias("at_20"), at_(40).alias("at_40"))


@R.frame("WITH r AS (SELECT o_custkey AS q, o_orderpriority IN ('1-URGENT', '2-HIGH') AS hit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders), c AS (SELECT *, sum(hit::INTEGER) OVER (PARTITION BY q ORDER BY k) AS hits, sum(hit::INTEGER) OVER (PARTITION BY q) AS total FROM r) SELECT round(avg(p3), 6) AS precision_at_3, round(avg(ap), 6) AS mean_average_precision FROM (SELECT q, sum(CASE WHEN k <= 3 AND hit THEN 1 ELSE 0 END) / 3.0::DOUBLE AS p3, coalesce(sum(CASE WHEN hit THEN hits / k::DOUBLE END) / max(total), 0) AS ap FROM c GROUP BY q)")
def ml_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = Window.partitionBy("q").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("hit"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("k"))
    per = o.withColumn("hits", F.sum("hit").over(ranked)).groupBy("q").agg((F.sum(F.when(F.col("k") <= 3, F.col("hit")).otherwise(0)) / 3.0).alias("p3"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("k"))) / F.sum("hit"), F.lit(0.0)).alias("ap"))
    return per.agg(F.round(F.avg("p3"), 6).alias("precision_at_3"), F.round(F.avg("ap"), 6).alias("mean_average_precision"))


@R.frame("WITH o AS (SELECT o_custkey, count(*) AS n, (avg(o_totalprice) > 150000)::INTEGER AS x FROM orders GROUP BY 1) SELECT round(ln(avg(CASE WHEN x = 0 THEN n END)), 4) AS intercept, round(ln(avg(CASE WHEN x = 1 THEN n END)) - ln(avg(CASE WHEN x = 0 THEN n END)), 4) AS slope FROM o")
def ml_generalised_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Poisson regression by iteratively reweighted least squares; on one mark it is the logarithms of the means."""
    from pyspark.ml.regression import GeneralizedLinearRegression

    x = (F.avg("o_totalprice") > 150000).cast("double")
    o = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("label"), array_to_vector(F.array(x)).alias("features"))
    m = GeneralizedLinearRegression(family="poisson", link="log", maxIter=50, tol=1e-10).fit(o)
    return spark.createDataFrame([(round(float(m.intercept), 4), round(float(m.coefficients[0]), 4))], "intercept double, slope double")


@R.frame("SELECT label, top FROM (SELECT label, vec_id AS top, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings) WHERE r <= 3")
def ml_top_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.col("embedding")[0]), "vec_id"))
    return load(spark, sf_dir, "embeddings").withColumn("r", r).where("r <= 3").select("label", F.col("vec_id").alias("top"))


@R.frame("WITH m AS (SELECT sum(embedding[1]::DOUBLE ** 2) AS a, sum(embedding[2]::DOUBLE ** 2) AS b, sum(embedding[1]::DOUBLE * embedding[2]::DOUBLE) AS c FROM embeddings) SELECT round(sqrt((a + b + sqrt((a - b) ** 2 + 4 * c ** 2)) / 2), 5) AS first_value, round(sqrt((a + b - sqrt((a - b) ** 2 + 4 * c ** 2)) / 2), 5) AS second_value FROM m")
def ml_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Singular values of two columns, from the sums of their products: one aggregate, and a matrix of two by two."""
    import numpy as np

    x, y = (F.col("embedding")[i].cast("double") for i in (0, 1))
    a, b, c = load(spark, sf_dir, "embeddings").agg(F.sum(x * x), F.sum(y * y), F.sum(x * y)).first()
    values = np.sqrt(np.linalg.eigvalsh(np.array([[a, c], [c, b]])))[::-1]
    return spark.createDataFrame([tuple(round(float(v), 5) for v in values)], "first_value double, second_value double")


@R.frame("SELECT p_partkey, p_retailprice AS label, 3 AS terms, p_size::DOUBLE AS size, round(p_size * p_retailprice, 4) AS product FROM part")
def ml_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_size") % 2).cast("double").alias("odd"))
    out = mf.RFormula(formula="p_retailprice ~ p_size + odd + p_size:p_retailprice").fit(df).transform(df)
    v = vector_to_array("features")
    return out.select("p_partkey", "label", F.size(v).alias("terms"), v[0].alias("size"), F.round(v[2], 4).alias("product"))


@R.frame("WITH o AS (SELECT avg((o_orderkey % 3 = o_custkey % 3)::INTEGER) AS hit FROM orders) SELECT round(hit, 6) AS subset_accuracy, round((1 - hit) * 2 / 4, 6) AS hamming_loss, round((1 + hit) / 2, 6) AS precision, round((1 + hit) / 2, 6) AS recall FROM o")
def ml_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is told two labels of four, one of which is always right."""
    pair = lambda c: F.array((F.col(c) % 3).cast("double"), F.lit(3.0))
    df = load(spark, sf_dir, "orders").select(pair("o_orderkey").alias("prediction"), pair("o_custkey").alias("label"))
    value = lambda name: round(float(me.MultilabelClassificationEvaluator(metricName=name).evaluate(df)), 6)
    return spark.createDataFrame([tuple(value(n) for n in ("subsetAccuracy", "hammingLoss", "precision", "recall"))], "subset_accuracy double, hamming_loss double, precision double, recall double")


@R.frame("SELECT range AS id, (range % 2 = 0)::INTEGER AS with_first FROM range(60)")
def ml_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two vocabularies that share no word: their main topics tell them apart."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda w: F.when(F.floor(w / 5) == F.col("id") % 2, 5.0 + F.pmod(F.hash("id", w), F.lit(3))).otherwise(0.0))
    df = spark.range(60).select("id", array_to_vector(counts).alias("features"))
    model = mc.LDA(k=2, seed=1, maxIter=30, optimizer="em").fit(df)
    shares = vector_to_array("topicDistribution")
    main = model.transform(df).select("id", (shares[0] > shares[1]).alias("main"))
    first = main.where("id = 0").select(F.col("main").alias("first"))
    return main.crossJoin(first).select("id", (F.col("main") == F.col("first")).cast("int").alias("with_first"))  # one row
