"""What must be refused, and the command line."""

import pytest
from oracle import SF
from pyspark.errors import AnalysisException, ParseException

from quarry.__main__ import parse, run
from quarry.operators.blocks import BlockStore
from quarry.session import register


@pytest.mark.parametrize(
    "text",
    [
        "SELECT sum(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN 1 FOLLOWING AND 1 PRECEDING) FROM nation",
        "SELECT sum(n_nationkey) OVER (ORDER BY n_name RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) FROM nation",
        "SELECT sum(n_nationkey) OVER (ORDER BY n_nationkey, n_name RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) FROM nation",
        "SELECT rank() OVER (PARTITION BY n_nationkey) FROM nation",
        "SELECT * FROM nation LIMIT -1",
        "SELECT n_name, count(*) FROM nation GROUP BY 3",
        "SELECT n_name FROM nation ORDER BY 5",
        "SELECT missing FROM nation",
        "SELECT n_nationkey FROM nation UNION SELECT r_regionkey, r_name FROM region",
        "SELECT * FROM nation WHERE count(*) > 1",
        "SELECT n_name FROM nation TABLESAMPLE (120 PERCENT)",
        "SELECT grouping(n_name) FROM nation",
    ],
)
def test_refused(spark, text):
    register(spark, SF, "nation", "region")
    with pytest.raises((AnalysisException, ParseException)):
        spark.sql(text).collect()


def test_scalar_subquery_of_several_rows(spark):
    register(spark, SF, "nation")
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        spark.sql("SELECT (SELECT n_nationkey FROM nation) AS v").collect()


def test_command_line(spark, tmp_path):
    store = BlockStore(spark, str(tmp_path))
    rows = [(i, [1, 2, i % 3], [float(i % 2) * 4 + i * 0.01, 1.0], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, items array<int>, features array<double>, label int")
    source = store.create(df, 5, "d", "t", keys=["id"])
    target = str(tmp_path / "out")
    for args in (["itemsets", source, target, "--sizes", "2,3", "--support", "0.2"], ["itemsets", source, target, "--sizes", "2", "--support", "0.2", "--recount"], ["cluster", source, target, "--sizes", "3"], ["classify", source, target, "--sizes", "3", "--predict", "2"], ["classify", source, target, "--sizes", "2", "--local-only", "--method", "tree"]):
        for path in run(parse(args), spark):
            assert spark.read.parquet(path).count() > 0
    with pytest.raises(ValueError):
        run(parse(["classify", source, target, "--sizes", "5", "--predict", "2"]), spark)
