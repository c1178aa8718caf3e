"""Exact top-k search by aggregation without random access (operator 3).

Vectors become integers, ``floor(256 x)``, and a score is their inner product. The rows
are cut into shards; a shard keeps one list per component, sorted by magnitude. A block of
queries reads the lists from their heads, best first: at each level every list is read on
to where an entry's worth, its magnitude by the block's weight of the component, falls
below one common value. What was read counts as it is. The parts not read are bounded by
the lists' next entries, and by what is left of the query's and the vector's norms
(Cauchy-Schwarz), so every vector has a lower and an upper score for each query. Once at
most ``RESOLVE`` vectors, or an 8th of the shard, can still reach a query's k-th lower
score, no outsider qualifies: the query stops, and the few are scored in full, in integers.

The query set is stated (ids divisible by ``every``), so blocks of queries meet shards of
rows, each pair once. A task holds one shard and streams blocks; per pair at most k rows
go on. Nothing is broadcast or collected, and tasks grow with the rows.

Defined cases: a vector that is null, or has a null, NaN or infinite component, takes no
part, nor does a row of null id; vectors of different lengths are compared over the
shorter; an id that repeats makes separate candidates, and is never its own candidate; of
equal queries one is asked, and different vectors of one query's id are asked together;
equal scores rank by id; integers beyond a long are held at its ends, sums are exact at
any size, and a score beyond a long is shown as its end; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import exchange_width, materialize, small_batches

LEAST, LARGEST = -float(1 << 63), float((1 << 63) - 1024)  # doubles that fit a long
SHARD, BLOCK, RESOLVE = 16_384, 128, 64
SHARES = (0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)  # of all entries, at a level
SLACK = np.float32(1e-5)  # of sums in floating point, against lengths of 1 at most
FOUND = "query_id long, vec_id long, score long, key binary"


def packed(rows: DataFrame, groups: int, name: str, *place) -> DataFrame:
    """Rows (vec_id, v) in ``groups`` blobs by hash of ``place``: (``name``, ids, cells, width)."""

    def run(table: pa.Table) -> pa.Table:
        lists = table["v"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        width = max(1, int(sizes.max()))
        cells = np.zeros((len(lists), width), dtype="<i8")
        cells[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
        ids = table["vec_id"].to_numpy().astype("<i8")
        return pa.table({name: pa.array([table[name][0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "cells": pa.array([_squeeze(cells)], pa.binary()), "width": pa.array([width], pa.int32())})

    return rows.withColumn(name, F.pmod(F.xxhash64(*place), F.lit(groups))).groupBy(name).applyInArrow(run, f"{name} long, ids binary, cells binary, width int")


def _squeeze(cells: np.ndarray) -> bytes:
    small = cells.max(initial=0) < 32767 and cells.min(initial=0) > -32767
    return (b"s" if small else b"l") + cells.astype("<i2" if small else "<i8").tobytes()


def _open(blob: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(blob, dtype="<i2" if blob[:1] == b"s" else "<i8", offset=1).reshape(rows, width)


class Reading:
    """A block of queries on its way through a shard's lists: how far each is read, and what was read of every vector.

    Vectors are scaled by the longest, queries to length 1, so that no sum overflows."""

    def __init__(self, lists: Lists, queries: np.ndarray):
        self.lists = lists
        self.sizes = np.sqrt((queries * queries).sum(axis=1))
        self.queries = (queries / np.where(self.sizes > 0, self.sizes, 1)[:, None]).astype(np.float32)
        self.at = np.zeros(lists.width, dtype=np.int64)
        self.seen = np.zeros((len(lists.ids), lists.width), dtype=np.float32)  # entries read, at their vectors
        self.known = np.zeros_like(self.seen)  # 1 where an entry was read

    def read(self, share: float, asking: np.ndarray) -> None:
        """Read on, best first for those that still ask, until about ``share`` of all entries are read."""
        lists, n = self.lists, len(self.lists.ids)
        weight = np.sqrt((self.queries[asking].astype(np.float64) ** 2).mean(axis=0)) if share < 1 else np.ones(lists.width)
        worth = lists.marks * weight  # of some entries of each list
        level = np.partition(worth, i := int((1 - share) * (worth.size - 1)), axis=None)[i]
        for j in range(lists.width):
            begin, end = self.at[j], n
            if share < 1:
                end = lists.ascending[j].searchsorted(-level / weight[j], side="right") if weight[j] else 0
            if end > begin:
                rows = lists.order[j, begin:end]
                self.seen[rows, j], self.known[rows, j] = lists.entries[j, begin:end], 1
                self.at[j] = end

    def bounds(self, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper scores of all vectors for these queries, a row each; scaled."""
        lists, n = self.lists, len(self.lists.ids)
        q = self.queries[asking]
        score = q @ self.seen.T
        asked = np.maximum(0, (q * q).sum(axis=1)[:, None] - (q * q) @ self.known.T)
        left = np.maximum(0, lists.norms - np.einsum("ij,ij->i", self.seen, self.seen))
        following = np.array([-lists.ascending[j, a] if a < n else 0.0 for j, a in enumerate(self.at)])
        width = np.minimum(np.sqrt((asked + SLACK) * (left + SLACK)), (np.abs(q) @ following)[:, None]) + SLACK
        return score - width, score + width


class Lists:
    """A shard's lists, sorted by magnitude, as rows of ``order`` (whose), ``entries`` and ``ascending`` (magnitudes, negated)."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray):
        self.ids, self.whole = ids, cells.astype(np.int64)
        n, self.width = cells.shape
        columns = np.ascontiguousarray(cells.T).astype(np.float64)
        self.largest = float(np.abs(columns).max(initial=0))
        columns /= float(np.sqrt((columns * columns).sum(axis=0).max(initial=0))) or 1.0
        self.norms = (columns * columns).sum(axis=0).astype(np.float32)
        self.order = np.argsort(-np.abs(columns), axis=1, kind="stable")
        self.entries = np.take_along_axis(columns, self.order, axis=1).astype(np.float32)
        self.ascending = -np.abs(self.entries.astype(np.float64))
        self.marks = -self.ascending[:, np.linspace(0, n - 1, min(n, 64)).astype(np.int64)].T
        self.n_read = self.n_entries = 0

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
        """Per query the ids and scores of its k best here."""
        n, shared = len(self.ids), min(self.width, queries.shape[1])
        wide = np.zeros((len(queries), self.width), dtype=np.int64)
        wide[:, :shared] = queries[:, :shared]
        reading, asking = Reading(self, wide.astype(np.float64)), np.arange(len(queries))
        few = max(RESOLVE, k, n // 8)
        for share in SHARES:
            if n <= few:
                near = self.ids[None, :] != query_ids[asking][:, None]
            else:
                reading.read(share, asking)
                lower, upper = reading.bounds(asking)
                own = self.ids[None, :] == query_ids[asking][:, None]
                lower[own] = -np.inf
                near = ~own & (upper >= np.partition(lower, n - k, axis=1)[:, [n - k]])
            over = (near.sum(axis=1) <= few) | (share == 1)
            self.n_read, self.n_entries = self.n_read + int(over.sum()) * int(reading.at.sum()), self.n_entries + int(over.sum()) * n * self.width
            for i in np.flatnonzero(over):
                yield int(query_ids[asking[i]]), *self._resolve(wide[asking[i]], np.flatnonzero(near[i]), k)
            asking = asking[~over]
            if not len(asking):
                break

    def _resolve(self, query: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        cells, most = self.whole[near], float(np.abs(query.astype(np.float64)).max(initial=0)) * self.largest
        if most * max(1, len(query)) < 1 << 62:
            score = cells @ query
            best = np.lexsort((self.ids[near], -score))[:k]
            return self.ids[near][best], score[best].tolist()
        exact = [sum(x * y for x, y in zip(row, query.tolist(), strict=True)) for row in cells.tolist()]
        best = sorted(range(len(exact)), key=lambda i: (-exact[i], self.ids[near[i]]))[:k]
        return self.ids[near[best]], [exact[i] for i in best]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lists = None, None
        for batch in batches:
            for now, ids, cells, width, query_ids, query_cells, query_width in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard != now:
                    n = len(ids) // 8
                    shard, lists = now, Lists(np.frombuffer(ids, "<i8"), _open(cells, n, width))
                query_ids = np.frombuffer(query_ids, "<i8")
                rows = [], [], []
                for query_id, best, score in lists.top(query_ids, _open(query_cells, len(query_ids), query_width).astype(np.int64), k):
                    for out, x in zip(rows, ([query_id] * len(best), best.tolist(), score), strict=True):
                        out += x
                shown = [min(max(x, -(1 << 63)), (1 << 63) - 1) for x in rows[2]]
                keys = [(x + (1 << 159)).to_bytes(20, "big") for x in rows[2]]  # in the order of the scores, of any size
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(shown, pa.int64()), pa.array(keys, pa.binary())], names=["query_id", "vec_id", "score", "key"])

    return run


def search(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows of each query."""
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.transform("embedding", lambda x: F.greatest(F.lit(LEAST), F.least(F.lit(LARGEST), 256 * x.cast("double"))))
    v = F.transform(v, lambda x: F.floor(x).cast("long"))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where("vec_id is not null").where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    n, m = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    parts = min(blocks, -(-2 * exchange_width(spark) // shards))  # a few shards alone would leave tasks idle
    data = packed(rows, shards, "shard", "vec_id", F.monotonically_increasing_id())  # of the rows as read: ids and whole rows may repeat
    data = materialize(data, "topk-shards").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    queries = packed(asked, blocks, "block", "vec_id", "v").select(F.pmod("block", F.lit(parts)).alias("part"), F.col("ids").alias("query_ids"), F.col("cells").alias("query_cells"), F.col("width").alias("query_width"))
    sent = materialize(queries, "topk-queries").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    pairs = data.repartition(shards * parts, "shard", "part").join(sent.repartition(shards * parts, "shard", "part"), ["shard", "part"])
    found = pairs.select("shard", "ids", "cells", "width", "query_ids", "query_cells", "query_width").mapInArrow(_search(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ints q JOIN ints r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
) WHERE rank <= 5
"""
