"""Top-k search against all scores."""

import numpy as np

from quarry.llm import topk_search


def brute(rows, k, every):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in good if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_against_all(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD", 150)
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    monkeypatch.setattr(topk_search, "RESOLVE", 12)
    pick = np.random.RandomState(4)
    rows = [(i, pick.randn(8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2050, [1.0, float("nan")] * 4), (2100, [1.0, None] * 4), (2150, [float("inf")] * 8), (2200, []), (2250, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    got = topk_search.search(df, k=5, every=50).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute(rows, 5, 50)
    assert topk_search.search(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.search(few, k=5, every=50).collect()} == brute(rows[:3], 5, 50)


def test_bounds_hold():
    pick = np.random.RandomState(5)
    cells, queries = pick.randint(-50, 50, (200, 6)), pick.randint(-50, 50, (9, 6)).astype(float)
    queries[3], queries[:, 2], asking = 0, 0, np.arange(9)
    reading = topk_search.Reading(topk_search.Lists(np.arange(200), cells), queries)
    exact = (queries / np.maximum(1, reading.sizes)[:, None]) @ cells.T / np.sqrt((cells**2).sum(axis=1).max())
    width = []
    for share in (0.1, 0.3, 0.6, 1.0):
        reading.read(share, asking)
        lower, upper = reading.bounds(asking)
        assert (lower <= exact).all() and (exact <= upper).all()
        width.append((upper - lower).mean())
    assert width == sorted(width, reverse=True) and width[-1] < 1e-3


def test_queries_stop_reading_early(spark):
    """On the table every query stops before the lists end; what was read and what was left is counted."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    cells = np.floor(256 * np.array([r.embedding for r in rows]).astype(np.float64)).astype(np.int64)
    lists, asked = topk_search.Lists(ids, cells), np.flatnonzero(ids % 50 == 0)
    found = {q: (best.tolist(), score) for q, best, score in lists.top(ids[asked], cells[asked], 5)}
    assert len(found) == len(asked)
    for at in asked:
        all_ = cells @ cells[at]
        all_[at] = -(1 << 60)
        order = np.lexsort((ids, -all_))[:5]
        assert found[ids[at]] == (ids[order].tolist(), all_[order].tolist())
    assert lists.n_entries == len(asked) * cells.size and lists.n_read < 0.85 * lists.n_entries


def test_large_components(spark):
    """Integers far beyond 2**28, and sums beyond a long: exact, and in order."""
    pick = np.random.RandomState(6)
    rows = [(i, (pick.randn(4) * 10.0 ** pick.randint(-2, 13)).tolist()) for i in range(300)]
    rows += [(1000, [2e6, 2e6, -2e6, 1.0]), (1001, [2e6, 2e6, -2e6, 1.25]), (1050, [1e300, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    held = [(i, [min(max(int(np.floor(min(max(256 * x, -(2.0**63)), 2.0**63 - 1024))), -(2**63)), 2**63 - 1) for x in v]) for i, v in rows]
    want = set()
    for q, a in held:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in held if i != q)
            want |= {(q, r + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(scored[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.search(df).collect()} == want


def test_few_rows_and_no_components(spark):
    """More results wanted than a shard of some size has; vectors that are all empty."""
    rows = [(i, [float((i * 7) % 13), 1.0]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.search(df, k=100, every=50).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute(rows, 100, 50)
    empty = [(i, []) for i in range(100)]
    got = topk_search.search(spark.createDataFrame(empty, "vec_id long, embedding array<float>")).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute(empty, 5, 50)
