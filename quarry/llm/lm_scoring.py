"""Cross-entropy difference of two bigram models (operator 7).

The target model is counted over good documents, the background model over all
documents; both share one vocabulary, all words of the corpus, and, the background scaled
to the target's size, one strength of smoothing. A document's score is the mean over its
tokens of the background loss less the target loss: the higher, the more it reads like
the target.

    p(w | v) = (c(v, w) + MU p(w)) / (c(v) + MU),   p(w) = (c(w) + 1) / (N + V + 1)

Documents are stored in slices of about ``SLICE_BYTES``. A slice adds up its own words and
pairs and sends each, once, with both counts to the bucket of its key; the bucket adds the
slices up and answers each with the totals, in the order that it asked in; the slice then
scores its documents. So the most frequent pair is one entry per slice and not one per
document, nothing is broadcast, and both kinds of tasks stay as large as they are when
the corpus grows. A document's own pairs are left out of the counts that score it.

Defined cases: null text counts as empty; a text of under two words has 0 tokens and
score 0; rows that repeat a doc_id are documents of their own; a row of null doc_id isn't
counted and scores null; a very long text is a slice by itself; without target documents
every score is 0; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import exchange_width, materialize, small_batches
from .textops import SLICE, U64, Words, ints, lower_ascii, mix, slices, string_buffer, whole

MU = 20.0
SLICE_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20  # of text, whose entries one bucket gets
PER_TASK = 4  # buckets, so that tasks are even though buckets are dealt by hash
GRAINS = 16
KINDS = ("words", "pairs")
SLICES = "slice long, bytes long, n_all long, n_target long, ids binary, good binary, ends binary, text binary"
ASKED = "bucket long, slice long, " + ", ".join(f"{k}_{c} binary" for k in KINDS for c in ("keys", "all", "target"))
TOLD = "slice long, bucket long, distinct long, " + ", ".join(f"{k}_{c} binary" for k in KINDS for c in ("all", "target"))


def _stored(limit: int):
    """Rows (doc_id, text, good) as slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, number = zstandard.ZstdCompressor(level=1).compress, TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", limit):
            raw, ends = string_buffer(batch.column(1))
            words = Words(raw, ends).per_row
            good = batch.column(2).to_numpy(zero_copy_only=False)
            row = [number, len(raw), int(words.sum()), int(words[good].sum()), batch.column(0).to_numpy().astype("<i8").tobytes(), good.tobytes(), ends.astype("<i8").tobytes(), pack(raw.tobytes())]
            kinds = [pa.int64()] * 4 + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in SLICES.split(", ")])
            number += 1

    return run


class Counted:
    """A slice's words and pairs: their keys by bucket, and which ones its tokens are.

    A key in its bucket has 48 bits. Buckets don't grow, so that two keys of a bucket hardly
    ever meet, however large the corpus."""

    def __init__(self, ends: bytes, text: bytes, buckets: int):
        offsets = np.frombuffer(ends, "<i8")
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)
        h, rows, at = [], [], 0
        while at < len(offsets) - 1:  # some documents at a time
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
            words = Words(lower_ascii(raw[offsets[at] : offsets[stop]]), offsets[at : stop + 1] - offsets[at])
            h.append(words.hashes())
            rows.append((words.row_of_word() + at).astype(np.int32))
            at = stop
        h, self.row = np.concatenate(h or [np.zeros(0, U64)]), np.concatenate(rows or [np.zeros(0, np.int32)])
        self.first = np.flatnonzero(self.row[1:] == self.row[:-1])  # a pair is its first word's place
        pair = mix(h[self.first] * U64(0x9FB21C651E98DF25) + h[self.first + 1])
        self.keys, self.which, self.bucket = {}, {}, {}
        for kind, key in zip(KINDS, (h, pair), strict=True):
            key, which = np.unique(key, return_inverse=True)
            bucket, key = (key % U64(buckets)).astype(np.int64), mix(key + U64(1)) >> U64(16)
            order = np.lexsort((key, bucket))
            rank = np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            self.keys[kind], self.bucket[kind], self.which[kind] = key[order], bucket[order], rank[which]


def _ask(buckets: int):
    """What each slice asks each bucket: its keys there, ascending, and its own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, good, ends, text in zip(*[batch.column(c).to_pylist() for c in ("slice", "good", "ends", "text")], strict=True):
                counted = Counted(ends, text, buckets)
                marked = np.frombuffer(good, bool)[counted.row].astype(np.float64)
                columns, asked = {}, np.unique(np.concatenate([counted.bucket[k] for k in KINDS]))
                for kind, weight in zip(KINDS, (marked, marked[counted.first]), strict=True):
                    key, which = counted.keys[kind], counted.which[kind]
                    counts = np.bincount(which, minlength=len(key)), np.bincount(which, weights=weight, minlength=len(key)).astype(np.int64)
                    begin, end = (np.searchsorted(counted.bucket[kind], asked, side=s) for s in ("left", "right"))
                    for name, x in zip(("keys", "all", "target"), (key, *counts), strict=True):
                        step = lambda v: np.diff(v, prepend=U64(0)) if name == "keys" else v  # noqa: E731, B023
                        columns[f"{kind}_{name}"] = pa.array([ints(step(x[a:b])) for a, b in zip(begin, end, strict=True)], pa.binary())
                fixed = [pa.array(asked, pa.int64()), pa.array(np.full(len(asked), number), pa.int64())]
                yield pa.RecordBatch.from_arrays(fixed + list(columns.values()), names=["bucket", "slice", *columns])

    return run


def _tell(table: pa.Table) -> pa.Table:
    """A bucket's totals for every slice that asked, and one row with the number of its words."""
    columns, distinct = {}, 0
    for kind in KINDS:
        keys = [np.cumsum(whole(x.as_py()), dtype=U64) for x in table[f"{kind}_keys"]]
        cut = np.cumsum([0, *map(len, keys)])
        key, which = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        if kind == "words":
            distinct = len(key)
        for name in ("all", "target"):
            own = np.concatenate([whole(x.as_py()) for x in table[f"{kind}_{name}"]])
            total = np.zeros(len(key), dtype=U64)
            np.add.at(total, which, own)
            total = total[which]
            columns[f"{kind}_{name}"] = pa.array([ints(total[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)] + [None], pa.binary())
    n = table.num_rows
    numbers = pa.array(table["slice"].to_pylist() + [None], pa.int64())
    return pa.table({"slice": numbers, "bucket": pa.array([table["bucket"][0].as_py()] * (n + 1), pa.int64()), "distinct": pa.array([None] * n + [distinct], pa.int64()), **columns})


def _scores(buckets: int, n_all: int, n_target: int, vocabulary: int):
    ratio = n_target / max(1, n_all)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right, out = right.sort_by("bucket"), []
        for row in left.to_pylist():
            counted = Counted(row["ends"], row["text"], buckets)
            total = {k: [np.concatenate([whole(x.as_py()) for x in right[f"{k}_{c}"]] or [np.zeros(0, U64)]).astype(np.float64) for c in ("all", "target")] for k in KINDS}
            ids, good = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["good"], bool)
            place, pair = counted.row[counted.first], counted.which["pairs"]
            _, at, own = np.unique((place.astype(np.int64) << 32) | pair, return_index=True, return_counts=True)  # a document's distinct pairs
            doc, pair = place[at], pair[at]
            v, w = (counted.which["words"][counted.first[at] + k] for k in (0, 1))
            loss = []
            for k, (size, scale) in enumerate(((n_all, ratio), (n_target, 1.0))):
                left_out = own * good[doc] if k else own
                base = (total["words"][k][w] + 1) / (size + vocabulary + 1)
                seen = scale * (total["pairs"][k][pair] - left_out)
                loss.append(np.log(scale * total["words"][k][v] + MU) - np.log(seen + MU * base))
            n = np.bincount(doc, weights=own, minlength=len(ids))
            score = np.bincount(doc, weights=own * (loss[0] - loss[1]), minlength=len(ids)) / np.maximum(n, 1) * (n_target > 0)
            out.append(pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n.astype(np.int64), pa.int64()), "score": pa.array(np.round(score, 9), pa.float64())}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    return run


def score(docs: DataFrame, good: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score. ``good`` has the doc_id of every document of the target domain."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = good.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("good", F.lit(True))
    # An id may repeat very often: documents are salted, with a mark for each grain of salt.
    marks = marks.withColumn("grain", F.explode(F.sequence(F.lit(0), F.lit(GRAINS - 1))))
    salted = rows.where("doc_id is not null").withColumn("grain", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(GRAINS)).cast("int"))
    flagged = salted.join(marks.hint("shuffle_hash"), ["doc_id", "grain"], "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    sliced = materialize(flagged.mapInArrow(_stored(SLICE_BYTES), SLICES), "lm-slices")
    sizes = sliced.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes", "n_all", "n_target")]).first()
    buckets = max(PER_TASK * exchange_width(spark), -(-sizes["bytes"] // BUCKET_BYTES))
    width = -(-buckets // PER_TASK)
    asked = sliced.mapInArrow(_ask(buckets), ASKED).repartition(width, "bucket")
    told = materialize(asked.groupBy("bucket").applyInArrow(_tell, TOLD), "lm-totals")
    vocabulary = told.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    home = lambda df: df.repartition(width, "slice").groupBy("slice")
    scored = home(sliced.drop("bytes", "n_all", "n_target")).cogroup(home(told.where("slice is not null").drop("distinct"))).applyInArrow(_scores(buckets, sizes["n_all"], sizes["n_target"], vocabulary), "doc_id long, n_tokens long, score double")
    return scored.union(rows.where("doc_id is null").selectExpr("doc_id", "0L", "cast(null as double)"))
