"""Quality classifier by Bradley-Terry pairwise ranking (operator 5).

Each labelled document of quality 1 is preferred to one of quality 0. The worth of a
document is linear in features of its text alone; the logistic loss of worth
differences over preference pairs gives the weights. A quantile of the worths of all
labelled documents, at the share of quality 0 among them, becomes the threshold, and the worth
is mapped so that the threshold scores ``CUT``.

Fitting uses every labelled document that isn't held out. They are dealt by hash of their ids to
blocks of about ``block_rows``; means and scales are those of all of them; each block's weights come
of preference pairs in which each of its documents stands, and the model has their mean, by the blocks'
documents. A quality with few documents goes to all blocks, so that none is without pairs. Up to
``block_rows`` labelled documents are one block. The driver gets sums and weights per block and the
two worths on either side of the threshold. Features are measured over whole texts and over all
documents; labels, lang, source and doc_id are no features.

Defined cases: null text counts as empty and is scored; labels that are null, or of
documents that don't exist, are ignored; without both labels the weights
are zero and every document scores 0.5; an id that is labelled twice counts as often; a
row of null doc_id is scored and not held out; repeated rows are scored each by itself;
very long texts are read whole, one at a time; an empty table gives an empty result; other
columns are ignored by ``score`` and survive in ``keep``, where a row of null doc_id, which
no verdict names, goes, and rows that repeat a doc_id stay if one of them is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.ranks import percentiles

from .quality_rules import repeated_words
from .storage import materialize, small_batches
from .textops import Words, counts_by_row, slices, string_buffer

CUT, FEW = 0.3, 50  # FEW: documents of a quality a block, below which all blocks get all of them
FEATURES = (
    "log_words", "chars_per_word", "words_per_line", "distinct_words", "repeated_words", "repeated_neighbours",
    "upper", "digits", "non_ascii", "space", "stops", "commas", "exclamations", "bars", "hashes_stars", "dollars_percents",
    "angles_braces", "quotes", "other_marks", "short_words", "long_words", "marked_ends",
)


def _classes() -> dict[str, np.ndarray]:
    def of(chars: bytes) -> np.ndarray:
        m = np.zeros(256, dtype=bool)
        m[list(chars)] = True
        return m

    marks = bytes(c for c in range(33, 127) if not chr(c).isalnum())
    named = {"stops": b".?", "commas": b",;:", "exclamations": b"!", "bars": b"|", "hashes_stars": b"#*", "dollars_percents": b"$%&@", "angles_braces": b"<>{}[]()", "quotes": b"\"'`"}
    rest = bytes(c for c in marks if not any(c in x for x in named.values()))
    return {k: of(v) for k, v in named.items()} | {"other_marks": of(rest), "upper": of(bytes(range(65, 91))), "digits": of(b"0123456789"), "space": of(b" \t\r\x0b\x0c"), "non_ascii": of(bytes(range(128, 256)))}


CLASSES = _classes()


def feature_rows(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text; all zero for a text without words."""
    words = Words(raw, offsets)
    n = words.per_row
    out = np.zeros((len(n), len(FEATURES)), dtype=np.float32)
    put = lambda name, x: out.__setitem__((slice(None), FEATURES.index(name)), x)
    size, some = np.diff(offsets), np.maximum(n, 1)
    chars = np.maximum(size, 1)
    for name, mask in CLASSES.items():
        put(name, counts_by_row(mask[raw], offsets) / (chars if name in ("upper", "digits", "non_ascii", "space") else some))
    lengths = words.stops - words.starts
    row = words.row_of_word()
    per = lambda x: np.bincount(row, weights=x, minlength=len(n)) / some
    put("log_words", np.log1p(n))
    put("chars_per_word", per(lengths))
    put("words_per_line", np.log1p(n / (1 + counts_by_row(raw == 10, offsets))))
    put("short_words", per(lengths <= 3))
    put("long_words", per(lengths >= 15))
    put("repeated_words", repeated_words(words) / some)
    if len(words.starts):
        h = words.hashes()
        own = h ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(own)
        fresh = np.ones(len(own), dtype=bool)
        fresh[1:] = own[order[1:]] != own[order[:-1]]
        put("distinct_words", np.bincount(row[order], weights=fresh, minlength=len(n)) / some)
        put("repeated_neighbours", per(np.concatenate([[False], (h[1:] == h[:-1]) & (row[1:] == row[:-1])])))
        last = raw[words.stops - 1]
        marked = CLASSES["exclamations"] | CLASSES["bars"] | CLASSES["hashes_stars"] | CLASSES["dollars_percents"]
        put("marked_ends", per(marked[last]))
    out[n == 0] = 0
    return out


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x = feature_rows(*string_buffer(batch.column(batch.schema.get_field_index("text"))))
        flat = pa.array(x.reshape(-1), pa.float32())
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, len(FEATURES)), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), values], names=[batch.schema.field(0).name, "features"])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; ``CUT`` at the threshold."""
        z = (self.worth(x) - self.threshold) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of each feature."""
    x = x.astype(np.float64)
    return x.mean(0), _sound(x.std(0))


def _sound(scale: np.ndarray) -> np.ndarray:
    return np.where(scale < 1e-9, 1.0, scale)


def weights(x: np.ndarray, y: np.ndarray, mean: np.ndarray, scale: np.ndarray, pairs: int = 60_000, rounds: int = 400, ridge: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights by gradient descent with momentum on the logistic loss of feature differences; both labels are there, and every document is in a pair."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    z = np.clip((x.astype(np.float64) - mean) / scale, -6, 6)
    pick = np.random.RandomState(seed)
    n = min(max(pairs, len(good), len(bad)), len(good) * len(bad))
    each = -(-n // len(bad))
    over = np.tile(bad, each)[:n]  # every rejected document loses about equally often
    under = np.concatenate([pick.permutation(good) for _ in range(-(-n // len(good)))])[:n]
    diff = z[under] - z[over]
    w, pace = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for _ in range(rounds):
        lose = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        pace = 0.9 * pace + diff.T @ lose / n - ridge * w
        w = w + 0.2 * pace
    return w


def fit(x: np.ndarray, y: np.ndarray) -> Model | None:
    """The model of one block."""
    bad = int((y == 0).sum())
    if not 0 < bad < len(y):
        return None
    mean, scale = moments(x)
    model = Model(mean, scale, weights(x, y, mean, scale), 0.0, 1.0)
    worth = model.worth(x)
    ranked = np.sort(worth)
    return placed(model, ranked[bad - 1], ranked[bad], worth.std())


def placed(model: Model, low: float, high: float, deviation: float) -> Model:
    """The threshold lies midway between the worths on either side of the quantile."""
    return replace(model, threshold=float((low + high) / 2), spread=float(max(deviation / 4, 1e-6)))


def remainder(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 5


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def features(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(measure, rows.select("doc_id").schema.add("features", T.ArrayType(T.FloatType()))), "quality-features")


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a block, in an order that its rows decide."""
    of = lambda t: t["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    table = table.take(np.lexsort(of(table).T)).sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    return of(table), table["quality"].to_numpy()


def train(measured: DataFrame, labels: DataFrame, block_rows: int = 20_000) -> Model | None:
    """Fit on all labelled documents that aren't held out, block by block."""
    marked = labels.where("quality in (0, 1)").where(remainder() != 0).select("doc_id", F.col("quality").cast("int").alias("quality"))
    taught = materialize(marked.join(measured, "doc_id").select("doc_id", "quality", "features"), "quality-taught")
    counts = {r.quality: r.n for r in taught.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    total = sum(counts.values())
    blocks = -(-total // block_rows)
    dealt = taught.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    few = [q for q, n in counts.items() if blocks > 1 and n < FEW * blocks]
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    whole = dealt.where(~F.col("quality").isin(few)).unionByName(dealt.where(F.col("quality").isin(few)).withColumn("block", everywhere)) if few else dealt

    def add(table: pa.Table) -> pa.Table:
        x = _rows(table)[0].astype(np.float64)
        mean = x.mean(0)
        return pa.table({"block": table["block"][:1], "n": pa.array([len(x)], pa.int64()), "mean": [mean], "squares": [((x - mean) ** 2).sum(0)]})

    sums = sorted(dealt.groupBy("block").applyInArrow(add, "block long, n long, mean array<double>, squares array<double>").collect())
    n, means = np.array([[r.n] for r in sums], dtype=np.float64), np.array([r.mean for r in sums])
    mean = (n * means).sum(0) / n.sum() if len(sums) > 1 else means[0]
    scale = _sound(np.sqrt((np.array([r.squares for r in sums]).sum(0) + (n * (means - mean) ** 2).sum(0)) / n.sum()))

    def learn(table: pa.Table) -> pa.Table:
        x, y = _rows(table)
        both = 0 < (y == 0).sum() < len(y)
        return pa.table({"block": table["block"][:1], "n": pa.array([len(y) if both else 0], pa.int64()), "weights": [weights(x, y, mean, scale) if both else np.zeros(x.shape[1])]})

    learnt = sorted(whole.groupBy("block").applyInArrow(learn, "block long, n long, weights array<double>").collect())
    n = np.array([[r.n] for r in learnt], dtype=np.float64)
    if not n.sum():
        return None
    model = Model(mean, scale, (n * np.array([r.weights for r in learnt])).sum(0) / n.sum(), 0.0, 1.0)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(model.worth(x), pa.float64())], names=["worth"])

    worths = materialize(taught.select("features").mapInArrow(judge, "worth double"), "quality-worths")
    low, high = percentiles(worths, ["worth"], [f"{counts[0]}/{total}", f"{counts[0] + 1}/{total}"]).first().worth
    return placed(model, low, high, worths.agg(F.stddev_pop("worth")).first()[0])


def score(docs: DataFrame, labels: DataFrame, block_rows: int = 20_000) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    measured = features(docs)
    model = train(measured, labels, block_rows)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, len(FEATURES)) if n else np.zeros((0, len(FEATURES)))
            s = model.score(x) if model else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = measured.mapInArrow(apply, measured.select("doc_id").schema.add("score", "double"))
    return scored.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be of quality, with all columns."""
    good = score(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(good, docs["doc_id"] == good["_kept"], "left_semi")
