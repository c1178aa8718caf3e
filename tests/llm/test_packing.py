"""Packing against whole-text tokenization and the rules of the layout."""

import zlib

import numpy as np
import pytest

from quarry.llm import packing
from quarry.llm.queries import op10_packing, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    t = ids_of.__dict__.setdefault("t", Tokenizer.from_file(PATH))
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, texts):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids, at = np.array(ids_of(texts[d]), dtype="<u4"), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0  # no padding anywhere


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(op10_packing(spark, sf).collect(), texts)


def test_edges(spark):
    texts = {0: None, 1: "", 2: "a b\tc  d\n\n e's I'M ΆΣ ́x", 3: "word " * 9000, 4: "x" * 20000, 5: "same text", 6: "same text", None: "no id"}
    df = spark.createDataFrame([(k, v, "extra") for k, v in texts.items()], "doc_id long, text string, length string")
    check(packing.pack(df, PATH).collect(), texts)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_plain_words_need_no_library():
    """Words of printable Latin-1 are cut and merged here, to the library's ids."""
    pick = np.random.RandomState(5)
    letters = [chr(c) for c in range(33, 256) if chr(c).isprintable() and not chr(c).isspace()] + list("etaoinsrh'.,#*" * 12)
    words = ["".join(pick.choice(letters, pick.randint(1, 14))) for _ in range(20_000)]
    words += ["", "aaaaaaaaaa", "th" * 50, "\u00ff" * 100, "it's", "--'s", "we'LL'VE", "x86\u00b2\u00bd", "\u00aa\u00b5\u00ba\u00d7\u00f7", "onat.###"]
    text = " ".join(w for w in words if "<|" not in w)
    want = ids_of(text)
    encoder = packing.WordEncoder(PATH)
    encoder.tokenizer = None
    ids, offsets = encoder.encode([text, "the\nsame  " + text])
    assert ids[: offsets[1]].tolist() == want
    assert ids[offsets[1] :].tolist() == ids_of("the same")[:-1] + want


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|>", "A<|EndOfText|>B <|x", "A <|endoftext|> B", "A<|startoftext|>\u00c9", "\u0394<|ENDOFTEXT|>", "x" * 101 + " " + "\u00fc" * 130 + "!"])
def test_special_tokens_and_long_words(text):
    """Special tokens count as they are written only; a long word is the library's."""
    assert packing.WordEncoder(PATH).encode([text])[0].tolist() == ids_of(text)


def test_first_neighbours_decide_nothing(monkeypatch):
    """The best neighbours, put in order first, are a head of all; windows that use them up go on with the others."""
    pick = np.random.RandomState(4)
    docs = [np.minimum(pick.zipf(1.3, pick.randint(1, 30)), 3000).astype(np.uint32) for _ in range(2000)]
    ids, offsets = np.concatenate(docs), np.cumsum([0, *map(len, docs)])
    shard, used = packing.Shard(ids, offsets), np.zeros(2000, dtype=bool)
    used[9] = True
    every, some = shard.neighbours(9, used).tolist(), shard.neighbours(9, used, 5).tolist()
    assert 5 <= len(some) < len(every) and some == every[: len(some)]
    found = []
    for first in (1, 50, 10_000):
        monkeypatch.setattr(packing, "FIRST", first)
        packer = packing.Packer(0)
        packer.add(list(range(2000)), ids, offsets)
        packer.pack()
        packer.close()
        found.append(packer.batch())
    assert found[0].equals(found[2]) and found[1].equals(found[2])


def test_neighbours_share_terms():
    ids = np.array([5, 6, 7, 5, 6, 7, 8, 9, 10, 7, 8, 9], dtype=np.uint32)
    shard = packing.Shard(ids, np.array([0, 3, 6, 9, 12]))
    used = np.zeros(4, dtype=bool)
    used[0] = True
    assert shard.neighbours(0, used).tolist() == [1, 3]
    used[1] = True
    assert shard.neighbours(0, used).tolist() == [3]
    used[2] = True
    assert shard.neighbours(2, used).tolist() == [3]


def test_neighbours_by_brute_force():
    """Every unused document that shares a term, in the order of its BM25 score over all the seed's terms."""
    pick = np.random.RandomState(3)
    docs = [np.minimum(pick.zipf(1.3, pick.randint(1, 400)), 3000).astype(np.uint32) for _ in range(300)]
    docs += [docs[7], np.array([49_000], dtype=np.uint32), np.zeros(0, dtype=np.uint32)]
    sizes = np.array([len(d) for d in docs])
    shard = packing.Shard(np.concatenate(docs), np.concatenate([[0], np.cumsum(sizes)]))
    df, n, mean = {}, len(docs), sizes.mean()
    for d in docs:
        for t in set(d.tolist()):
            df[t] = df.get(t, 0) + 1
    used = np.zeros(n, dtype=bool)
    for seed in [7, 0, 301, 302, *pick.permutation(299)[:150].tolist()]:
        used[seed] = True
        asked, want = set(docs[seed].tolist()), {}
        for i in np.flatnonzero(~used):
            tf = {t: c for t, c in zip(*map(np.ndarray.tolist, np.unique(docs[i], return_counts=True)), strict=True) if t in asked}
            if tf:
                norm = packing.K1 * (1 - packing.B + packing.B * sizes[i] / mean)
                want[i] = sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * (packing.K1 + 1) / (c + norm) for t, c in tf.items())
        got = shard.neighbours(seed, used).tolist()
        assert sorted(got) == sorted(want)
        values = np.array([want[i] for i in got])
        assert (np.diff(values) <= 1e-4 * np.abs(values[:-1]) + 1e-6).all()


@pytest.mark.parametrize("sizes", [[1], [4096], [4097], [5000, 100, 3995, 1], [3000] * 7])
def test_layout(sizes):
    p = packing.Packer(0)
    ids = np.arange(sum(sizes), dtype=np.uint32) % 50
    p.add(list(range(len(sizes))), ids, np.concatenate([[0], np.cumsum(sizes)]))
    p.pack()
    p.close()
    b = p.batch().to_pylist()
    per = {}
    for r in b:
        per[r["sequence_id"]] = per.get(r["sequence_id"], 0) + r["length"]
    assert sum(per.values()) == sum(sizes)
    assert sum(v == 4096 for v in per.values()) == sum(sizes) // 4096
