"""Suffix deduplication against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest

from quarry.llm import suffix_dedup
from quarry.llm.queries import op2_suffix_dedup
from quarry.llm.run_index import earlier_windows


def brute(texts, length=100):
    seen, out = set(), {}
    for d in sorted(texts):
        t = (texts[d] or "").encode()
        gone = np.zeros(len(t) + 1, dtype=np.int64)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i] += 1
                gone[i + length] -= 1
            seen.add(w)
        mark = np.cumsum(gone)[:-1] > 0
        rest = bytes(np.frombuffer(t, np.uint8)[~mark])
        spans = int((mark & ~np.concatenate([[False], mark[:-1]])).sum()) if len(t) else 0
        out[d] = (len(t), int(mark.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


def run(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    assert run(op2_suffix_dedup(spark, f"/root/testdata/{sf}")) == brute(texts)


@pytest.mark.parametrize("family", [256, 2])
def test_planted(spark, monkeypatch, family):
    monkeypatch.setattr(suffix_dedup, "FAMILY", family)
    pick = random.Random(5)
    noise = lambda n: "".join(pick.choice("abcdefgh é") for _ in range(n))
    passage = noise(260)
    texts = {0: None, 1: "", 2: "x" * 99, 3: "x" * 100, 4: "x" * 900, 5: "ab" * 300, 6: passage + passage}
    for i in range(12):
        texts[20 - i] = noise(150) + passage[i : 250 - i] + noise(40)
        p = list(passage)
        p[pick.randrange(260)] = "Z"
        texts[40 + i] = "".join(p)
    texts[60], texts[61] = texts[40], noise(60) + "Mentpa " * 100
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, kind string").repartition(3)
    assert run(suffix_dedup.remove_repeats(df)) == brute(texts)
    kept = {r.doc_id: r for r in suffix_dedup.cleaned(df).collect()}
    assert kept[60].text == "" and kept[2].text == "x" * 99 and kept[60].kind == "x" and set(kept) == set(texts)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "y" * 300), (7, "q" * 50 + "r" * 60), (7, "q" * 50 + "r" * 60)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(False, 0), (False, 0), (True, 0)]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_run_index():
    pick = np.random.RandomState(1)
    for _ in range(60):
        strings, groups = [], []
        for g in range(pick.randint(1, 5)):
            base = bytes(pick.choice(list(b"abc"), size=pick.randint(3, 40)))
            for _ in range(pick.randint(1, 9)):
                b = bytearray(base)
                for _ in range(pick.randint(0, 4)):
                    b[pick.randint(len(b))] = pick.choice(list(b"abcd"))
                strings.append(bytes(b[pick.randint(0, 3) :]) or b"a")
                groups.append(g)
        least = pick.randint(1, 9)
        size = np.array([len(s) for s in strings])
        hit = earlier_windows(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size, np.array(groups), least)
        for i, s in enumerate(strings):
            for p in range(hit.shape[1]):
                w = s[p : p + least]
                assert hit[i, p] == (len(w) == least and any(groups[j] == groups[i] and w in strings[j] for j in range(i)))


def test_cleaned_keeps_clashing_columns(spark):
    pick = random.Random(5)
    same = "".join(pick.choice("abcdefgh ") for _ in range(300))
    rows = [(1, same, "a", "b", 1), (2, f"x{same}y", "c", "d", 1), (None, same, "e", "f", 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, _doc string, _text string, home int, n_bytes int")
    got = suffix_dedup.cleaned(df)
    assert got.columns == df.columns
    assert {(r.doc_id, r.text, r._doc, r._text) for r in got.collect()} == {(1, same, "a", "b"), (2, "xy", "c", "d"), (None, same, "e", "f")}
