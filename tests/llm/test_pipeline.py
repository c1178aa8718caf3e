"""The pipeline's stages, each against a brute-force version on its own input."""

import duckdb
import numpy as np
import pyarrow as pa
from test_jaccard_join import brute as brute_components
from test_packing import check as check_packing
from test_suffix_dedup import brute as brute_repeats

import corpus_pipeline
from quarry.llm import pairwise_quality, quality_rules
from quarry.llm.storage import forget, materialize
from quarry.llm.textops import string_buffer

SF = "/root/testdata/sf0.001"


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "quality_classifier", "ngram_jaccard_join", "suffix_dedup", "packing"]

    ruled = materialize(stages["quality_rules"](spark, docs, SF), "test")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = {r[0] for r in con.execute(f"select doc_id from ({quality_rules.ORACLE}) where kept").fetchall()}
    assert set(texts_of(ruled)) == want and ruled.columns == columns

    rated = materialize(stages["quality_classifier"](spark, ruled, SF), "test")
    left = texts_of(ruled)
    x = dict(zip(left, pairwise_quality.feature_rows(*string_buffer(pa.array(left.values()))), strict=True))
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").orderBy("doc_id").collect() if not pairwise_quality.is_held_out(r.doc_id) and r.doc_id in x]
    model = pairwise_quality.fit(np.array([x[d] for d, _ in labels]), np.array([q for _, q in labels]))
    want = {d for d in left if model is None or model.score(x[d][None])[0] >= pairwise_quality.CUT}
    assert set(texts_of(rated)) == want and rated.columns == columns

    single = materialize(stages["ngram_jaccard_join"](spark, rated, SF), "test")
    assert set(texts_of(single)) == {d for d, _, c in brute_components(texts_of(rated), 5, 80) if d == c} and single.columns == columns

    cut = materialize(stages["suffix_dedup"](spark, single, SF), "test")
    before, after, gone = texts_of(single), texts_of(cut), brute_repeats(texts_of(single))
    assert set(after) == set(before) and cut.columns == columns
    for d, (size, removed, _, _) in gone.items():
        rest = len(after[d].encode())
        assert (after[d] == before[d]) if not removed else size - removed <= rest <= size - removed + 6 * gone[d][2]
    assert all(r.n_chars == len(r.text) for r in cut.collect() if gone[r.doc_id][1])

    check_packing(stages["packing"](spark, cut, SF).collect(), after)
    check_packing(corpus_pipeline.run(spark, SF).collect(), after)
    assert forget(spark) > 5


def test_odd_rows_pass_all_stages(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "x " * 80, "en", None, 1), (3, "word " * 70, "en", "s", 1)]
    rows += [(10 + i, " ".join(f"w{(i * 37 + j * j) % 211}" for j in range(70)), "en", "s", 9) for i in range(12)]
    clash = ", _kept string, n_words int, bucket long, _doc long, score double"
    docs = spark.createDataFrame([(*r, "k", 1, 2, 3, 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + clash)
    left, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test")
        assert docs.columns == columns or name == "packing"
        left.append({r.doc_id for r in docs.collect()})
    assert left[0] == set(range(10, 22)) and left[0] >= left[1] >= left[2] == left[3] == left[4]
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, SF), "test")
    assert empty.count() == 0
