"""Encoding against the public library, decoding as a round trip, and a unigram model against all segmentations."""

import random
import zlib

import numpy as np
import pytest

from quarry.llm import pieces
from quarry.llm.queries import op1_sentencepiece, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_like_library():
    pick = random.Random(1)
    texts = ["", " ", "\n", " a", "a ", "a\n b", "   ", "x" * 300, "ab" * 2000 + " " * 40 + "z", "日本語 тест", "\u0000a", "  A  b\tc\nÉé ﬁ ①", "▁x ▁▁ y"]
    texts += ["".join(pick.choice("aethn  .\n▁éX1") for _ in range(pick.randint(1, 60))) for _ in range(800)]
    e = pieces.Encoder.of(PATH)
    ids, offsets = e.encode(texts)
    for t, a, b, want in zip(texts, offsets[:-1], offsets[1:], library().encode(texts), strict=True):
        assert ids[a:b].tolist() == want, t
    back = pieces.decode(e.model, ids, offsets)
    assert all(t == b for t, b in zip(texts, back, strict=True) if pieces.MARK not in t)


def test_unigram_best_path():
    m = pieces.Model.__new__(pieces.Model)
    pick = random.Random(2)
    vocabulary = ["▁", "a", "b", "c", "ab", "bc", "▁a", "▁ab", "abc", "ca", "▁c", "bca"]
    m._set({p: i for i, p in enumerate(vocabulary)}, {i: -pick.random() * 5 for i in range(len(vocabulary))}, pieces.UNIGRAM, 99)

    def best(w):
        if not w:
            return 0.0
        return max(m.scores.get(m.ids.get(w[:k], -1), m.worst) + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in m.ids or k == 1)

    words = sorted({"▁" + "".join(pick.choice("abcd") for _ in range(pick.randint(1, 9))) for _ in range(200)})
    for w, got in zip(words, m.segments(words), strict=True):
        assert "".join(got) == w
        assert sum(m.scores.get(m.ids.get(p, -1), m.worst) for p in got) == pytest.approx(best(w))


def test_tables(spark):
    rows = op1_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert all(r.round_trip for r in rows)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    model = library()
    want = {d: model.encode(t) for d, t in texts.items()}
    assert {r.doc_id: (r.n_ids, r.ids_crc32) for r in rows} == {d: (len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for d, x in want.items()}
    df = spark.createDataFrame([(1, None, "e"), (2, "two words", "e"), (2, "two words", "e"), (None, "", "e")], "doc_id long, text string, ids string")
    enc = pieces.encode(df, PATH)
    assert sorted((r.doc_id or 0, r.text) for r in pieces.decoded(enc, PATH).collect()) == [(0, ""), (1, ""), (2, "two words"), (2, "two words")]
    assert pieces.encode(df.limit(0), PATH).count() == 0
