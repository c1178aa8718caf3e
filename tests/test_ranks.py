"""Percentiles are exact however many rows there are."""

import math
import random
import shutil
from pathlib import Path

import duckdb
from oracle import SF, compare

from quarry import catalog
from quarry.operators.blocks import BlockFrame
from quarry.operators.ranks import percentiles


def test_summary_of_many_rows(spark):
    n = 400_001
    df = spark.range(n).selectExpr("id * 7919 % 400001 as x", "cast(id as string) as s", "cast(id % 2 as double) as y", "id % 1 as block_id")
    rows = {r.summary: r for r in BlockFrame(df, 1).describe([0], ["max", "50%", "25%", "count", "12.5%", "0%", "100%"]).collect()}
    assert {s: rows[s].x for s in ("25%", "50%", "12.5%", "0%", "100%", "max", "count")} == {"25%": "100000", "50%": "200000", "12.5%": "50000", "0%": "0", "100%": "400000", "max": "400000", "count": "400001"}
    assert (rows["50%"].s, rows["50%"].y) == ("200000.0", "0.0")
    assert [r.summary for r in BlockFrame(df, 1).describe([0], ["max", "50%", "count", "50%"]).collect()] == ["max", "50%", "count", "50%"]
    empty = BlockFrame(df.where("x < 0"), 1).describe([0], ["count", "50%"]).collect()
    assert [(r.summary, r.x, r.s) for r in empty] == [("count", "0", "0"), ("50%", None, None)]


def test_percentiles_of_groups(spark):
    pick = random.Random(3)
    rows = [(pick.choice(["a", "b", None]), pick.choice([None, pick.randrange(50), pick.randrange(10**6)]), pick.random()) for _ in range(5000)] + [("none", None, None)]
    got = percentiles(spark.createDataFrame(rows, "k string, v long, w double"), ["v", "w"], ["0.1", "0.5", "0.999", "1"], ["k"]).collect()
    assert len(got) == 4
    for r in got:
        for name, at in (("v", 1), ("w", 2)):
            own = sorted(x[at] for x in rows if x[0] == r.k and x[at] is not None)
            assert r[name] == [own[max(1, math.ceil(len(own) * p / 1000)) - 1] if own else None for p in (100, 500, 999, 1000)]


def test_aliases_of_many_rows(spark, tmp_path):
    for p in Path(SF).glob("*.parquet"):
        shutil.copy(p, tmp_path)
    (tmp_path / "orders.parquet").chmod(0o644)
    part = "i * 2654435761 % 9000011 AS o_orderkey, i % 1000 AS o_custkey, ['O', 'F', NULL][1 + i % 3] AS o_orderstatus, (i % 997)::DOUBLE AS o_totalprice, '1-URGENT' AS o_orderpriority"
    duckdb.execute(f"COPY (SELECT {part} FROM range(9000000) r(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    compare(spark, str(tmp_path), catalog.QUERIES["agg_aliases"], catalog.ORACLE_SQL["agg_aliases"])
