"""Cross-entropy difference against a dictionary version."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lm_scoring
from quarry.llm.queries import op7_lm_scoring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(texts, good):
    words = {d: WORD.findall((t or "").translate(LOWER)) for d, t in texts.items()}
    models = []
    for keep in (lambda d: d in good, lambda d: True):
        uni = Counter(w for d, x in words.items() if keep(d) for w in x)
        pairs = Counter(p for d, x in words.items() if keep(d) for p in zip(x, x[1:], strict=False))
        models.append((uni, pairs, sum(uni.values())))
    size, ratio = len(models[1][0]) + 1, models[0][2] / models[1][2]
    out = {}
    for d, x in words.items():
        own, score = Counter(zip(x, x[1:], strict=False)), 0.0
        for (v, w), n in own.items():
            p = []
            for (uni, pairs, total), scale, drop in zip(models, (1.0, ratio), (n if d in good else 0, n), strict=True):
                base = (uni[w] + 1) / (total + size)
                p.append((scale * (pairs[v, w] - drop) + lm_scoring.MU * base) / (scale * uni[v] + lm_scoring.MU))
            score += n * (math.log(p[0]) - math.log(p[1]))
        out[d] = (sum(own.values()), score / max(1, sum(own.values())))
    return out


def same(rows, want):
    assert len(rows) == len(want) and {r.doc_id for r in rows} == set(want)
    for r in rows:
        assert r.n_tokens == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-6)


def marked(spark, ids):
    return spark.createDataFrame([(d,) for d in ids], "doc_id long")


@pytest.mark.parametrize("small", [False, True])
def test_table(spark, small, monkeypatch):
    """As it is, and in slices of some documents and many buckets."""
    if small:
        monkeypatch.setattr(lm_scoring, "SLICE_BYTES", 20_000)
        monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 30_000)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    rows = lm_scoring.score(docs, marked(spark, good)) if small else op7_lm_scoring(spark, sf)
    same(rows.collect(), brute({r.doc_id: r.text for r in docs.collect()}, good))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "one", 0), (4, "a b a b", 0), (None, "a b", 0)], "doc_id long, text string, score int")
    good = spark.createDataFrame([(4,), (77,)], "doc_id long")
    got = {r.doc_id: (r.n_tokens, r.score) for r in lm_scoring.score(docs, good).collect()}
    assert got[1] == got[2] == got[3] == (0, 0.0) and got[4][0] == 3 and got[None] == (0, None)
    assert {r.score for r in lm_scoring.score(docs, good.limit(0)).where("doc_id is not null").collect()} == {0.0}
    assert lm_scoring.score(docs.limit(0), good).count() == 0


def test_repeated_ids_are_documents_each(spark):
    texts = ["a b c a b", "a b", "c a b", "a b c a b"]
    docs = spark.createDataFrame([(7, t, "x") for t in texts], "doc_id long, text string, grain string")
    want = brute(dict(enumerate(texts)), set(range(4)))
    got = sorted((r.n_tokens, round(r.score, 6)) for r in lm_scoring.score(docs, marked(spark, [7, 7])).collect())
    assert got == sorted((n, round(x, 6)) for n, x in want.values())


def test_all_of_a_large_target_counts(spark):
    texts = {d: f"w{d % 50} x{d % 7} rare{d}" for d in range(70_000)}
    good = {d for d in texts if d % 3}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    same(lm_scoring.score(docs, marked(spark, good)).collect(), brute(texts, good))


def test_long_texts_and_pairs_that_repeat_often(spark):
    texts = {1: "ha " * 700_000 + "so it is", 2: "ha ha so", 3: "ho " * 66_000, 4: "so it goes ho ho", 5: "same " * 100_000}
    docs, good = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), {2, 3}
    got = lm_scoring.score(docs, marked(spark, good)).collect()
    assert next(r.n_tokens for r in got if r.doc_id == 5) == 99_999
    same(got, brute(texts, good))


@pytest.mark.parametrize("most", [0, 255, 256, 65_536, 2**24, 2**48, 2**64 - 1])
def test_whole_numbers(most):
    x = np.array([0, 1, most, 7], dtype=np.uint64)
    assert lm_scoring.whole(lm_scoring.ints(x)).tolist() == x.tolist()
    assert lm_scoring.whole(lm_scoring.ints(x[:0])).tolist() == []
