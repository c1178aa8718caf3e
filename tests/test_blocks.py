"""Blocks, the store, local and global operations and generators on small inputs."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import local_global as lg
from quarry.operators.blocks import BLOCK, BlockFrame, BlockStore, choose, file_type, reservoir, share_for, split
from quarry.plans.relational import salted_join
from quarry.sources import generators as gen


def test_choice_is_a_permutation():
    assert sorted(choose(7, 7, 3)) == list(range(7)) and choose(7, 3, 3) == choose(7, 3, 3)
    train, predict = split(10, 4, 5, 1)
    assert not set(train) & set(predict)
    with pytest.raises(ValueError):
        split(3, 2, 2)
    with pytest.raises(ValueError):
        choose(3, 4)


def test_summary_errors(spark):
    f = BlockFrame.assign(spark.range(100).toDF("x"), 4, ["x"])
    for bad in ("abc%", "120%", "median"):
        with pytest.raises(ValueError):
            f.describe(1, [bad])
    with pytest.raises(ValueError):
        f.subset([9])
    assert [r.summary for r in f.describe([1], ["count", "max"]).collect()] == ["count", "max"]


def test_pruning(spark, tmp_path):
    store = BlockStore(spark, str(tmp_path))
    target = store.create(spark.range(1000).toDF("x"), 5, "d", "numbers", keys=["x"])
    two = store.open(target).subset([1, 3]).df
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [block_id" in plan
    assert {r[BLOCK] for r in two.select(BLOCK).distinct().collect()} == {1, 3}
    assert sum(f.count() for f in store.take_each(target, store.about(target)["names"])) == 1000


def test_file_type():
    assert [file_type(x) for x in ("a/b.csv", "a.parquet/", "x", "y.tar")] == ["csv", "parquet", "text", "text"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=6), max_size=25), st.integers(1, 4))
def test_itemsets_like_counting(baskets, least):
    from itertools import combinations

    want = {}
    for size in (1, 2, 3):
        for c in combinations(range(7), size):
            n = sum(set(c) <= set(b) for b in baskets)
            if n >= least:
                want[c] = n
    assert lg.frequent_itemsets(baskets, least) == want


def test_itemsets_of_any_size(spark):
    rows = [(0, list("abcde"))] * 3 + [(0, list("abcd")), (0, list("xy"))]
    frame = BlockFrame(spark.createDataFrame(rows, f"{BLOCK} long, items array<string>"), 1)
    got = {r.itemset: r.support for r in lg.local_itemsets(frame, "items", 3).collect()}
    assert got["{a,b,c,d}"] == 4 and got["{a,b,c,d,e}"] == 3 and len(got) == 26


def test_learners():
    r = np.random.RandomState(0)
    x = np.vstack([r.randn(120, 3) - 2, r.randn(120, 3) + 2])
    y = np.repeat([5, 9], 120)
    for m in (lg.Logistic(), lg.Tree(), lg.Forest()):
        assert (m.fit(x, y).predict(x) == y).mean() > 0.95
    for c in (lg.kmeans(x, 2), lg.best_of_trials(x)):
        assert np.allclose(np.sort(c.mean(1)), [-2, 2], atol=0.5)
    assert lg.majority(np.array([[1, 2], [2, 2], [1, 1], [2, 1]])).tolist() == [1, 1]


def test_trim_of_few(spark):
    m = spark.createDataFrame([(0, 0.5), (1, 0.9)], "block_id long, accuracy double")
    assert lg.trimmed(m).count() == 2
    assert {r.weight for r in lg.trimmed(m, by_score=False).collect()} == {1.0}


def test_local_by_id(spark):
    f = BlockFrame(spark.createDataFrame([(0, 1), (0, 2), (1, 5)], f"{BLOCK} long, x long"), 2)
    out = f.local_by_id({0: lambda d: pd.DataFrame({"s": [d.x.sum()]}), 1: lambda d: pd.DataFrame({"s": [-d.x.sum()]})}, "s long")
    assert sorted(r.s for r in out.collect()) == [-5, 3]


def test_generators(spark):
    batches = gen.support_batches([3, 2], stratified=True, seed=1)
    for b in batches:
        full = max(b.shares, key=len)
        assert 0.05 <= b.shares[full] <= 0.1
        assert sum(p for s, p in b.shares.items() if set(s) <= set(full)) <= 0.15 + 1e-9
    assert gen.count_for_bytes(4000, batches) > 0 and gen.truth(spark, batches).count() == sum(len(b.shares) for b in batches)
    assert gen.transactions(spark, batches, 50).count() == 50
    assert np.allclose(gen.axis_rotation([0, 0, 1], 0.3), gen.rotation(3, 0, 1, 0.3))
    p = gen.Hyperplane([1.0, 2.0], 3.0)(np.random.RandomState(0), np.ones((4, 2)))
    assert np.allclose(p @ [1, 2], 3)
    assert len({tuple(np.floor(v / 10)) for v in gen.grid_shift(9, 2, 10)}) == 9


def test_local_centres_are_means_of_what_is_nearest(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    frame = BlockFrame.assign(rows, 3, ["vec_id"])
    found = {}
    for r in lg.local_centres(frame, "embedding", 3).collect():
        found.setdefault(r.block_id, []).append(r.centre)
    assert found.keys() == {0, 1, 2}
    for block, centres in found.items():
        x = np.array([r.embedding for r in frame.subset([block]).df.collect()], dtype=float)
        c = np.array(centres)
        near = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        assert len(c) == 3
        for k in range(3):
            assert np.abs(x[near == k].mean(0) - c[k]).max() < 1e-3


@pytest.mark.parametrize("make", [lg.Logistic, lg.Tree, lg.Forest])
def test_votes_of_local_models_find_the_class(spark, make):
    """Classes that a threshold tells apart, in every block: the vote is right on blocks that no model saw."""
    pick = np.random.RandomState(1)
    rows = [(i, [float(v) for v in pick.randn(4)]) for i in range(900)]
    df = spark.createDataFrame([(i, v, int(v[1] > 0.2)) for i, v in rows], "vec_id long, embedding array<double>, label int")
    frame = BlockFrame.assign(df, 5, ["vec_id"])
    models = lg.trimmed(lg.local_models(frame.subset([0, 1, 2]), "embedding", "label", make, "vec_id"))
    seen = lg.vote_predictions(frame.subset([3, 4]), models, "embedding", "vec_id", "label").toPandas()
    share = (seen["label"] == seen["predicted"]).mean()
    assert len(seen) == frame.subset([3, 4]).df.count() and share > 0.9
    assert lg.weighted_accuracy(spark.createDataFrame(seen), "label").first().accuracy == pytest.approx(share)


def test_recount_of_itemsets_of_any_size(spark):
    pick = np.random.RandomState(2)
    baskets = [sorted({str(x) for x in pick.randint(0, 9, 6)}) for _ in range(200)]
    flat = spark.createDataFrame([(i, x) for i, b in enumerate(baskets) for x in b + b[:1]], "basket long, item string")
    wanted = ["{1,2}", "{2,1}", "{0,3,5}", "{1,2,4,7}", "{3}", "{8,9}"]
    got = {r.itemset: r.support for r in lg.recount_itemsets(spark.createDataFrame([(w,) for w in wanted], "itemset string"), flat, "basket", "item", 0.0).collect()}
    want = {w: sum(set(w[1:-1].split(",")) <= set(b) for b in baskets) / 200 for w in wanted}
    assert got == pytest.approx({w: n for w, n in want.items() if n})
    assert lg.recount_itemsets(spark.createDataFrame([], "itemset string"), flat, "basket", "item", 0.0).count() == 0


def test_reservoir_draws_all_alike(spark):
    df = spark.range(3000).toDF("x")
    rows = [r.x for r in reservoir(df, 600, ["x"], 3000).collect()]
    assert len(rows) == len(set(rows)) == 600 and abs(np.mean(rows) - 1499.5) < 4 * 866 / 600**0.5
    assert reservoir(df, 5000, ["x"], 3000).count() == 3000
    assert 0.2 < share_for(600, 3000) < 0.27 and share_for(10, 10) == 1.0


def test_salted_join(spark):
    left = spark.createDataFrame([(i % 3 if i < 600 else i, i) for i in range(700)] + [(None, 1)], "k long, v long")
    right = spark.createDataFrame([(k, f"r{k}{c}") for k in range(0, 700, 2) for c in "ab"] + [(None, "n")], "k long, w string")
    want = sorted(tuple(r) for r in left.join(right, "k").collect())
    assert sorted(tuple(r) for r in salted_join(left, right, "k", grains=4, most=10).collect()) == want
