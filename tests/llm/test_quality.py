"""Quality rules against SQL and by hand; the classifier by held-out accuracy."""

import re
from collections import Counter
from math import exp, log, log1p, sqrt

import duckdb
import numpy as np

from quarry.llm import pairwise_quality, quality_rules
from quarry.llm.queries import op4_quality_rules, op5_quality_classifier

SF = "/root/testdata/sf0.01"
NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines"]


def test_rules_like_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.execute(f"select {', '.join(NAMES)} from ({quality_rules.ORACLE})").fetchall()
    got = op4_quality_rules(spark, SF)
    assert got.columns == NAMES  # the contract's columns come first
    assert {tuple(r) for r in got.collect()} == set(want)


def test_null_and_odd_names_are_groups_of_their_own(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    marked = clean.replace(" ", " %% ")
    rows = [(k * 100 + i, f"{marked if k == 1 else clean} t{i}", lang, lang) for k, lang in enumerate((None, "null", "=", "\u0000", "")) for i in range(60)]
    rows += [(1000 + k, marked, lang, lang) for k, lang in enumerate((None, "null", "=", "\u0000", ""))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
    assert [kept[1000 + k] for k in range(5)] == [False, True, False, False, False]


def test_rules_keep_odd_rows(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{clean} t{i}", "en", "s", "x") for i in range(60)] + [(None, clean, "en", "s", "x"), (5, "short", "en", "s", "y"), (70, clean + " lang" * 3, None, None, "z"), (71, " ".join(f"w{i}" for i in range(400_000)), "en", "s", "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _kept string")
    kept = quality_rules.keep(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r._kept) for r in kept.collect()) == sorted([(i, "x") for i in range(60)] + [(5, "y"), (70, "z"), (71, "long")])


def test_rules_by_hand(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    texts = {1: clean, 2: None, 3: "", 4: "a b c " * 30, 5: clean.replace(" ", " %%% "), 6: "é#1 x\tb\n\nL l\nL l"}
    df = spark.createDataFrame([(k, t, "en", None, 1) for k, t in texts.items()] + [(10 + i, clean + f" tail{i}", "en", None, 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_words int")
    r = {x.doc_id: x for x in quality_rules.judge(df).collect()}
    assert r[1].kept and r[12].kept and not r[2].kept and r[2].base_failed and r[3].n_words == 0
    assert r[4].base_failed and r[4].n_repeat_words == 90
    assert not r[5].base_failed and not r[5].kept  # beyond its group's fence
    assert (r[6].n_words, r[6].word_chars, r[6].n_symbols, r[6].n_dup_lines, r[6].n_lines) == (6, 10, 1, 1, 3)
    assert quality_rules.judge(df.limit(0)).count() == 0
    assert quality_rules.keep(df).columns == df.columns


def brute_features(text):
    """The classifier's features by plain counting."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return [0.0] * len(pairwise_quality.FEATURES)
    n, of = len(words), lambda chars: sum(b in chars for b in raw)
    marks = bytes(c for c in range(33, 127) if not chr(c).isalnum())
    kinds = {"stops": b".?", "commas": b",;:", "exclamations": b"!", "bars": b"|", "hashes_stars": b"#*", "dollars_percents": b"$%&@", "angles_braces": b"<>{}[]()", "quotes": b"\"'`"}
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + k for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    noisy = kinds["exclamations"] + kinds["bars"] + kinds["hashes_stars"] + kinds["dollars_percents"]
    found = {k: of(x) / n for k, x in kinds.items()} | {
        "log_words": log1p(n), "chars_per_word": sum(map(len, words)) / n, "words_per_line": log1p(n / (1 + raw.count(b"\n"))), "distinct_words": len(set(words)) / n,
        "repeated_words": len(repeated) / n, "repeated_neighbours": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "upper": of(bytes(range(65, 91))) / len(raw), "digits": of(b"0123456789") / len(raw), "non_ascii": of(bytes(range(128, 256))) / len(raw), "space": of(b" \t\r\x0b\x0c") / len(raw),
        "other_marks": of(bytes(c for c in marks if not any(c in x for x in kinds.values()))) / n,
        "short_words": sum(len(w) <= 3 for w in words) / n, "long_words": sum(len(w) >= 15 for w in words) / n, "marked_ends": sum(w[-1] in noisy for w in words) / n,
    }
    return [found[f] for f in pairwise_quality.FEATURES]


def brute_scores(texts, labels, rounds=400, ridge=1e-3):
    """Bradley-Terry by loops: every (better, worse) pair pulls the worths of its two documents apart."""
    x = {d: brute_features(t) for d, t in texts.items()}
    taught = sorted((d, q) for d, q in labels if d in x and not pairwise_quality.is_held_out(d))
    columns = list(zip(*[x[d] for d, _ in taught], strict=True))
    mean = [sum(c) / len(c) for c in columns]
    scale = [s if (s := sqrt(sum((v - m) ** 2 for v in c) / len(c))) >= 1e-9 else 1.0 for c, m in zip(columns, mean, strict=True)]
    standard = lambda v: [min(6, max(-6, (a - m) / s)) for a, m, s in zip(v, mean, scale, strict=True)]
    z = [standard(x[d]) for d, _ in taught]
    good, bad = ([i for i, (_, q) in enumerate(taught) if q == want] for want in (1, 0))
    n, pick = min(60_000, len(good) * len(bad)), np.random.RandomState(7)
    over = (bad * -(-n // len(bad)))[:n]
    under = [int(i) for _ in range(-(-n // len(good))) for i in pick.permutation(good)][:n]
    pairs = Counter(zip(under, over, strict=True))
    w, pace = [0.0] * len(mean), [0.0] * len(mean)
    for _ in range(rounds):
        worth = [sum(a * b for a, b in zip(v, w, strict=True)) for v in z]
        pull = [0.0] * len(z)
        for (a, b), times in pairs.items():
            lose = times / (1 + exp(worth[a] - worth[b])) / n
            pull[a] += lose
            pull[b] -= lose
        for k in range(len(w)):
            pace[k] = 0.9 * pace[k] + sum(p * v[k] for p, v in zip(pull, z, strict=True)) - ridge * w[k]
            w[k] += 0.2 * pace[k]
    worth = [sum(a * b for a, b in zip(v, w, strict=True)) for v in z]
    ranked, k = sorted(worth), len(bad)
    threshold, middle = (ranked[k - 1] + ranked[k]) / 2, sum(worth) / len(worth)
    spread = sqrt(sum((v - middle) ** 2 for v in worth) / len(worth)) / 4
    of = lambda d: (sum(a * b for a, b in zip(standard(x[d]), w, strict=True)) - threshold) / spread + log(0.3 / 0.7)
    return {d: 1 / (1 + exp(-of(d))) for d in x}


def test_classifier_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    want = brute_scores(texts, labels)
    got = {r.doc_id: r for r in op5_quality_classifier(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[d].score - want[d]) < 2e-3 and got[d].predicted == (want[d] >= 0.3) for d in want)


def test_classifier_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in op5_quality_classifier(spark, SF).collect()]
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == pairwise_quality.is_held_out(r.doc_id) for r in rows)


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 5000), (3, "x " * 5000), (None, "y")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = pairwise_quality.score(docs, none).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5} and all(r.held_out is False for r in rows if r.doc_id is None)
    clash = spark.createDataFrame([(1, "a b", 0.1, True, "k")], "doc_id long, text string, score double, held_out boolean, _kept string")
    assert pairwise_quality.score(clash, none).first().score == 0.5
    assert pairwise_quality.keep(clash, none).columns == clash.columns
    long = spark.createDataFrame([(1, "word " * 1_000_000)], "doc_id long, text string")
    assert pairwise_quality.score(long, none).count() == 1
    assert pairwise_quality.score(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(2, 1), (3, 0), (3, None)], "doc_id long, quality int")
    assert pairwise_quality.score(docs, one).count() == 5


def test_classifier_learns_from_all_labels(spark):
    """Of many blocks: means, scales and the threshold are those of all labelled documents, and the verdicts near those of one block."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    measured = pairwise_quality.features(docs)
    x = {r.doc_id: r.features for r in measured.collect()}
    taught = [(r.doc_id, r.quality) for r in labels.orderBy("doc_id").collect() if r.doc_id in x and not pairwise_quality.is_held_out(r.doc_id)]
    z, y = np.array([x[d] for d, _ in taught], dtype=np.float32), np.array([q for _, q in taught])
    for block_rows, marks in ((60, y), (60, np.where(np.arange(len(y)) % 100 == 5, 1, 0))):  # the second: few of one label
        model = pairwise_quality.train(measured, spark.createDataFrame([(d, int(q)) for (d, _), q in zip(taught, marks, strict=True)], "doc_id long, quality int"), block_rows)
        mean, scale = pairwise_quality.moments(z)
        assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale)
        ranked, bad = np.sort(model.worth(z)), int((marks == 0).sum())
        assert np.isclose(model.threshold, (ranked[bad - 1] + ranked[bad]) / 2) and np.isclose(model.spread, ranked.std() / 4)
    many, one = (pairwise_quality.train(measured, labels, n) for n in (60, 20_000))
    assert ((many.score(z) >= 0.3) == (one.score(z) >= 0.3)).mean() > 0.97
