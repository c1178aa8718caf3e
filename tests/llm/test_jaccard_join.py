"""The join against all pairs, on tables and on planted cases."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import jaccard_join
from quarry.llm.queries import op6_ngram_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(texts, size=4, percent=85):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    to = {d: d for d in texts}

    def root(d):
        while to[d] != d:
            d = to[d]
        return d

    where = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    pairs = {(min(a, b), max(a, b)) for ds in where.values() for i, a in enumerate(ds) for b in ds[:i]}
    for a, b in pairs:
        x, y = sets[a], sets[b]
        if 100 * len(x & y) >= percent * len(x | y):
            ra, rb = root(a), root(b)
            to[max(ra, rb)] = min(ra, rb)
    return {(d, len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    got = {tuple(r) for r in op6_ngram_jaccard_join(spark, f"/root/testdata/{sf}").select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("small", [False, True])
def test_planted(spark, small, monkeypatch):
    """Small: every n-gram counts as hot and is spread over many buckets, and texts are found by a join."""
    if small:
        monkeypatch.setattr(jaccard_join, "HOT", 2)
        monkeypatch.setattr(jaccard_join, "BUCKET_ENTRIES", 20)
        monkeypatch.setattr(jaccard_join, "FILTER_BITS", 1)
    pick = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {0: None, 1: "", 2: "a b", 3: "A  B", 4: "a b c d", 5: "\n\t"}
    for base in range(6):  # chains and stars of near copies at and about the limit
        words = [pick.choice(vocabulary) for _ in range(60 + 25 * base)]
        for k in range(14):
            w = list(words)
            for _ in range(k % 4):
                w[pick.randrange(len(w))] = pick.choice(vocabulary)
            texts[1000 - 100 * base - k] = " ".join(w)
            if k % 5 == 0:
                words = w
    df = spark.createDataFrame([(k, v, 7) for k, v in texts.items()], "doc_id long, text string, n int").repartition(5)
    got = {tuple(r) for r in jaccard_join.link(df).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute(texts)
    assert len({c for _, n, c in got if n}) < sum(n > 0 for _, n, _ in got)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert [tuple(r) for r in jaccard_join.link(df).collect()] == [(1, 2, 1), (1, 2, 1)]
    assert jaccard_join.link(df.limit(0)).count() == 0


def test_keep_odd_rows(spark):
    """Null ids stay, rows that repeat an id become one, columns that clash with inner names survive."""
    long = " ".join(f"w{i * i % 9973}" for i in range(150_000))
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e F", "y"), (None, "a b c d e f", "z"), (None, None, "z"), (3, None, "n"), (4, long, "l"), (5, long + " end", "l"), (6, "p q r s t u", "p")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, _kept string, _place int, slot int")
    got = jaccard_join.keep(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r._kept) for r in got.collect()) == [(0, "z"), (0, "z"), (1, "x"), (3, "n"), (4, "l"), (6, "p")]


def test_only_what_pairs_ask_for_travels(spark):
    """Of many stored texts those of a few pairs, and entries in fewer bytes than they have."""
    texts = spark.range(2000).selectExpr("id as doc_id", "1L as n", "cast('p' as binary) as parts", "cast(cast(id as string) as binary) as packed")
    asked = spark.createDataFrame([(5,), (1999,)], "doc long")
    got = {r.doc_id: bytes(r.packed) for r in jaccard_join.packed_of(texts, asked).collect()}
    assert {5, 1999} <= got.keys() and len(got) < 20 and got[1999] == b"1999"
    pick = np.random.RandomState(1)
    e = np.zeros(5000, dtype=jaccard_join.ENTRY)
    for f in ("h", "fp"):
        e[f] = pick.randint(0, 1 << 62, len(e))
    e["doc"], e["n"], e["pos"] = np.arange(len(e)) * 37 - 3, pick.randint(1, 3000, len(e)), pick.randint(0, 400, len(e))
    blob = jaccard_join._packed(e)
    assert len(blob) < 0.75 * e.nbytes and (jaccard_join._unpacked(blob) == e).all()


def test_members_without_a_partner_leave_their_group():
    """Exactly those stay that pass both filters with another one of their group."""
    pick = np.random.RandomState(2)
    for percent in (80, 85, 100):
        n = pick.randint(1, 60, 700)
        pos = (pick.rand(700) * (n - -(-percent * n // 100) + 1)).astype(np.int64)
        group = np.sort(pick.randint(0, 60, 700))
        group = np.unique(group, return_inverse=True)[1]
        want = [any(i != j and group[i] == group[j] and jaccard_join.passes(n[i], n[j], pos[i], pos[j], percent) for j in range(700)) for i in range(700)]
        assert 50 < sum(want) < 690 and jaccard_join.partnered(group, n, pos, percent).tolist() == want
    assert not len(jaccard_join.partnered(group[:0], n[:0], pos[:0], 85))


class Held:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("table", [True, False])
def test_entries_travel_small(table):
    """Of equal sets one is dealt out; entries take few bytes, and those of lone n-grams leave their groups."""
    pick = random.Random(4)
    texts = [" ".join(f"w{pick.randrange(10**6)}" for _ in range(300)) for _ in range(200)]
    docs = pa.record_batch({"doc_id": pa.array(range(-200, 200), pa.int64()), "text": texts + texts})
    sets = jaccard_join.shingle_sets(*jaccard_join.string_buffer(docs.column(1)), 4)
    prints = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<u8") for s in sets[:200]])
    order = np.argsort(prints[:, 0])
    least = (prints[order, 0], prints[order, 1], np.arange(-200, 0)[order]) if table else None
    rarity = Held(np.zeros(1 << 18, dtype=np.uint8))
    halves = [docs.slice(0, 350).take(pa.array(range(349, -1, -1))), docs.slice(350)]  # as two tasks, in one of them copies come first
    blobs = [b for half in halves for b in jaccard_join._prefixes(4, 85, rarity, 1, 1000, jaccard_join.hash_bits(18_000, 18), Held(least))(iter([half]))]
    blobs = [x.as_py() for b in blobs for x in b.column("entries")]
    e = np.concatenate([jaccard_join._unpacked(x) for x in blobs])
    assert (e["fp"] == 0).all() == table and (len(e) == 200 * 45 and set(e["doc"].tolist()) == set(range(-200, 0)) or not table)
    if table:
        assert sum(map(len, blobs)) < 6 * len(e)
    found = jaccard_join._groups(85, rarity, 1000)(pa.table({"entries": pa.array(blobs, pa.binary())}))
    assert found.num_rows < 100
