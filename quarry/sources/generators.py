"""Generators of itemset transactions and of labelled clusters."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class SupportBatch:
    """Itemsets over items of one batch and the share of transactions that each is."""

    number: int
    shares: dict[tuple[int, ...], float] = field(default_factory=dict)

    @property
    def total(self) -> float:
        return sum(self.shares.values())


def support_batches(sizes: Sequence[int], low: float = 0.05, high: float = 0.1, union: float = 0.15, isolated: int = 2, stratified: bool = False, seed: int = 0) -> list[SupportBatch]:
    """One batch per itemset size: the full itemset has a support in [low, high]; its subsets share what is
    left up to ``union``, evenly weighted at random or by increasing strata; isolated items get the rest."""
    pick, next_item, out = random.Random(seed), 1, []
    for number, size in enumerate(sizes):
        items = tuple(range(next_item, next_item + size))
        next_item += size
        full = pick.uniform(low, high)
        batch = SupportBatch(number, {items: full})
        subsets = [c for k in range(1, size) for c in combinations(items, k)]
        if subsets:
            room = union - full
            if stratified:
                marks = sorted((i + pick.random()) / len(subsets) for i in range(len(subsets)))
                parts = [b - a for a, b in zip([0.0, *marks[:-1]], marks, strict=True)]
            else:
                parts = [pick.random() for _ in subsets]
                parts = [p / sum(parts) for p in parts]
            batch.shares |= {s: room * p for s, p in zip(subsets, parts, strict=True)}
        for _ in range(isolated):
            batch.shares[(next_item,)] = pick.uniform(0, low / 2)
            next_item += 1
        out.append(batch)
    return out


def truth(spark: SparkSession, batches: Sequence[SupportBatch]) -> DataFrame:
    """(itemset, proportion, batch) of what was planted."""
    return spark.createDataFrame([(list(s), float(p), b.number) for b in batches for s, p in b.shares.items()], "itemset array<int>, proportion double, batch int")


def count_for_bytes(size: int, batches: Sequence[SupportBatch]) -> int:
    """How many transactions of 4-byte items fill ``size`` bytes."""
    return int(size / sum(len(s) * p for b in batches for s, p in b.shares.items()) / 4)


def transactions(spark: SparkSession, batches: Sequence[SupportBatch], count: int, seed: int = 0) -> DataFrame:
    """(id, items): each batch draws for each transaction at most one of its itemsets, by a hash of both, so no
    permutation is collected and any part can be made alone. A transaction without an item gets item 0."""
    ids = spark.range(count)
    drawn = []
    for b in batches:
        u = F.pmod(F.xxhash64("id", F.lit(b.number), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
        upto, part = 0.0, F.array().cast("array<int>")
        for s, p in reversed(list(zip(b.shares, np.cumsum(list(b.shares.values())), strict=True))):
            part = F.when(u < float(p), F.array(*[F.lit(i) for i in s])).otherwise(part)
        drawn.append(part)
    items = F.concat(*drawn)
    return ids.select("id", F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(0))).alias("items"))


# Clusters.

Draw = Callable[[np.random.RandomState, int], np.ndarray]


def constant(value: float) -> Draw:
    return lambda r, n: np.full(n, value)


def uniform(low: float, high: float) -> Draw:
    return lambda r, n: r.uniform(low, high, n)


def gaussian(mean: float, deviation: float) -> Draw:
    return lambda r, n: r.normal(mean, deviation, n)


def gamma(shape: float, scale: float) -> Draw:
    return lambda r, n: r.gamma(shape, scale, n)


def eye(size: int) -> np.ndarray:
    return np.eye(size)


def rotation(size: int, a: int, b: int, angle: float) -> np.ndarray:
    """Rotation by an angle in the plane of two axes."""
    m = np.eye(size)
    m[a, a] = m[b, b] = np.cos(angle)
    m[a, b], m[b, a] = -np.sin(angle), np.sin(angle)
    return m


def axis_rotation(axis: Sequence[float], angle: float) -> np.ndarray:
    """Rotation about an axis in space."""
    x, y, z = np.array(axis, dtype=float) / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)


@dataclass
class Hyperplane:
    """Puts points on normal . x = offset by their last coordinate, then moves them along the normal by noise."""

    normal: Sequence[float]
    offset: float = 0.0
    noise: Draw = constant(0.0)

    def __call__(self, r: np.random.RandomState, x: np.ndarray) -> np.ndarray:
        n = np.asarray(self.normal, dtype=float)
        x = x.copy()
        x[:, -1] = (self.offset - x[:, :-1] @ n[:-1]) / n[-1]
        return x + self.noise(r, len(x))[:, None] * n / np.linalg.norm(n)


@dataclass
class Cluster:
    """A distribution per dimension, then mappings, matrices or functions, one after the other."""

    draws: Sequence[Draw]
    mappings: Sequence = ()

    def points(self, r: np.random.RandomState, n: int) -> np.ndarray:
        x = np.stack([d(r, n) for d in self.draws], axis=1) if n else np.zeros((0, len(self.draws)))
        for m in self.mappings:
            x = x @ m.T if isinstance(m, np.ndarray) else m(r, x)
        return x


def no_shift(count: int, dimensions: int) -> np.ndarray:
    return np.zeros((count, dimensions))


def grid_shift(count: int, dimensions: int, width: float, seed: int = 0) -> np.ndarray:
    """One random vector in each of ``count`` different cells of a grid."""
    r = np.random.RandomState(seed)
    side = int(np.ceil(count ** (1 / dimensions)))
    cells = np.stack(np.unravel_index(r.permutation(side**dimensions)[:count], [side] * dimensions), axis=1)
    return (cells + r.uniform(0.25, 0.75, (count, dimensions))) * width


def clusters(spark: SparkSession, kinds: Sequence[Cluster], counts: Sequence[int], shifts: np.ndarray, parts: int = 4, seed: int = 0) -> DataFrame:
    """(label, features): part p draws its share of every cluster with a seed of its own."""

    def draw(batches):
        for rows in batches:
            for p in rows["id"]:
                r = np.random.RandomState((seed * 1_000_003 + int(p)) % (1 << 32))
                for label, (kind, count) in enumerate(zip(kinds, counts, strict=True)):
                    n = count // parts + (int(p) < count % parts)
                    x = kind.points(r, n) + shifts[label]
                    yield pd.DataFrame({"label": np.full(n, label), "features": list(x)})

    return spark.range(parts).repartition(parts, "id").mapInPandas(draw, "label int, features array<double>")
