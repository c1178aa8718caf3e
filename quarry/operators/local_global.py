"""Local and global operations over blocks: itemsets, clustering, classification.

A local operation makes one small result per block; a global one integrates them. Both
are DataFrames, so the integration is distributed as well.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.blocks import BLOCK, BlockFrame

ITEMSETS = "block_id long, itemset string, support long"


# Itemsets.


def frequent_itemsets(baskets: Sequence[Sequence], least: int, most_items: int | None = 3) -> dict[tuple, int]:
    """Itemsets of up to ``most_items`` items (None: of any size) in ``least`` baskets or more, level by level."""
    least = max(least, 1)
    held: dict[tuple, set[int]] = {}
    for i, r in enumerate(baskets):
        for x in set(r):
            held.setdefault((x,), set()).add(i)
    level = {k: held[k] for k in sorted(held) if len(held[k]) >= least}
    found = {k: len(at) for k, at in level.items()}
    size = 2
    while level and (most_items is None or size <= most_items):
        alike: dict[tuple, list] = {}
        for k in level:
            alike.setdefault(k[:-1], []).append(k)
        level = {x + y[-1:]: at for group in alike.values() for x, y in combinations(group, 2) if len(at := level[x] & level[y]) >= least}
        found |= {k: len(at) for k, at in level.items()}
        size += 1
    return found


def name_of(items: Sequence) -> str:
    return "{" + ",".join(map(str, items)) + "}"


def local_itemsets(frame: BlockFrame, items: str, least: float, most_items: int | None = None) -> DataFrame:
    """Per block its frequent itemsets of two items or more; ``least`` counts baskets of one block, and under 1 it is a share of them."""

    def mine(block: int, rows: pd.DataFrame) -> pd.DataFrame:
        needed = least if least >= 1 else ceil(least * len(rows))
        found = {k: n for k, n in frequent_itemsets(rows[items].tolist(), needed, most_items).items() if len(k) > 1}
        return pd.DataFrame({"block_id": block, "itemset": [name_of(k) for k in found], "support": list(found.values())})

    return frame.local(mine, ITEMSETS, [items])


def vote_itemsets(local: DataFrame, n_blocks: int, share: float = 0.5) -> DataFrame:
    """Itemsets found in at least ``share`` of all blocks, with their mean support rounded down."""
    votes = local.groupBy("itemset").agg(F.sum("support").alias("total"), F.count("*").alias("votes"))
    return votes.where(F.col("votes") >= share * n_blocks).select("itemset", F.floor(F.col("total") / F.col("votes")).alias("support"))


def recount_itemsets(candidates: DataFrame, baskets: DataFrame, basket: str, item: str, least: float) -> DataFrame:
    """Exact shares of candidate itemsets over (basket, item) rows: a basket holds an itemset if it has all its items.

    A basket grows its own subsets, item by item in order, and only those stay that begin a candidate. So rows
    are what baskets hold, and not baskets by candidates.
    """
    parts = F.array_sort(F.split(F.regexp_replace("itemset", "[{}]", ""), ","))
    wanted = candidates.select("itemset").distinct().select("itemset", parts.alias("parts"))
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(k.alias("size"), F.concat_ws(",", F.slice("parts", 1, k)).alias("begun")))).alias("p")
    begun = wanted.select(prefix).select("p.*").distinct()
    rows = baskets.select(F.col(basket).alias("basket"), F.col(item).cast("string").alias("item")).distinct()
    total = rows.select("basket").distinct().count()
    known = rows.join(wanted.select(F.explode("parts").alias("item")).distinct(), "item", "left_semi")
    held = known.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("rest")).select("rest", F.lit(None).cast("string").alias("begun"))
    met = None
    for size in range(1, (wanted.agg(F.max(F.size("parts"))).first()[0] or 0) + 1):
        grown = held.select("begun", "rest", F.posexplode("rest").alias("at", "item"))
        grown = grown.select(F.concat_ws(",", "begun", "item").alias("begun"), F.expr("slice(rest, at + 2, size(rest))").alias("rest"))
        held = grown.join(begun.where(F.col("size") == size).select("begun"), "begun", "left_semi")
        counted = held.groupBy("begun").agg((F.count("*") / total).alias("support")).where(F.col("support") >= least)
        met = counted if met is None else met.union(counted)
    if met is None:
        return wanted.select("itemset", F.lit(0.0).alias("support"))
    return met.join(wanted.select("itemset", F.concat_ws(",", "parts").alias("begun")), "begun").select("itemset", "support")


# Clustering.


def kmeans(x: np.ndarray, k: int, rounds: int = 100, tolerance: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Lloyd's iterations from distant seeds; centres in lexicographic order."""
    pick = np.random.RandomState(seed)
    centres = x[[pick.randint(len(x))]]
    while len(centres) < min(k, len(x)):
        gap = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
        centres = np.vstack([centres, x[pick.choice(len(x), p=gap / gap.sum()) if gap.sum() > 0 else pick.randint(len(x))]])
    for _ in range(rounds):
        near = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
        done = np.abs(new - centres).max() <= tolerance
        centres = new
        if done:
            break
    return centres[np.lexsort(centres.T[::-1])]


def best_of_trials(x: np.ndarray, k: int = 2, trials: int = 5, rounds: int = 5, seed: int = 0) -> np.ndarray:
    """Of several short runs the one with the least squared distance to its first two centres."""
    runs = [kmeans(x, k, rounds, 1e-5, seed + t) for t in range(trials)]
    return min(runs, key=lambda c: ((x[:, None] - c[None, :2]) ** 2).sum(-1).min(1).sum())


CENTRES = "block_id long, place int, centre array<double>"


def local_centres(frame: BlockFrame, features: str, k: int = 2, method: Callable[..., np.ndarray] = kmeans, seed: int = 0) -> DataFrame:
    """Per block its k centres."""

    def run(block: int, rows: pd.DataFrame) -> pd.DataFrame:
        c = method(np.array(rows[features].tolist(), dtype=float), k, seed=seed)
        return pd.DataFrame({"block_id": block, "place": range(len(c)), "centre": [v.tolist() for v in c]})

    return frame.local(run, CENTRES, [features])


def global_centres(local: DataFrame, k: int = 2, seed: int = 0, method: Callable[..., np.ndarray] = kmeans) -> DataFrame:
    """Centres of the pooled local centres: k rows per block, a bounded number."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block_id", "place"])
        c = method(np.array(rows["centre"].tolist()), k, seed=seed)
        return pd.DataFrame({"block_id": -1, "place": range(len(c)), "centre": [v.tolist() for v in c]})

    return local.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, CENTRES)


def squared_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centre_distance(real: DataFrame, predicted: DataFrame, most: int = 100_000) -> DataFrame:
    """Sum over real centres (id, centre) of the least squared distance to a predicted one, of which there are ``most`` at most."""
    centres = [r.centre for r in predicted.select("centre").limit(most + 1).collect()]
    if len(centres) > most:
        raise ValueError(f"over {most} centres")
    told = predicted.sparkSession.sparkContext.broadcast(np.array(centres, dtype=float))

    @F.pandas_udf("double")
    def least(rows: pd.Series) -> pd.Series:
        x = np.array(rows.tolist(), dtype=float)
        return pd.Series([float(((told.value - v) ** 2).sum(axis=1).min()) if len(told.value) else None for v in x])

    return real.select(least("centre").alias("d")).agg(F.sum("d").alias("distance"))


def purity(labelled: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Share of rows predicted as labelled, of two classes whose names may be swapped."""
    p = F.avg((F.col(label) == F.col(predicted)).cast("int"))
    return labelled.agg(F.greatest(p, 1 - p).alias("purity"))


# Classification.


class Logistic:
    """Logistic regression, one against the rest, by gradient steps on standardised features."""

    def __init__(self, rounds: int = 150, ridge: float = 1e-3):
        self.rounds, self.ridge = rounds, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.classes = np.unique(y)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        z = self._z(x)
        self.w = np.zeros((z.shape[1], len(self.classes)))
        for _ in range(self.rounds):
            p = self._p(z)
            self.w -= 0.5 * (z.T @ (p - (y[:, None] == self.classes)) / len(z) + self.ridge * self.w)
        return self

    def _z(self, x):
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def _p(self, z):
        s = z @ self.w
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[self._p(self._z(x)).argmax(1)]


class Tree:
    """A Gini decision tree over quantile cuts; with ``features`` and a seed, of random features at each node."""

    def __init__(self, depth: int = 10, least: int = 10, features: int | None = None, seed: int = 0):
        self.depth, self.least, self.features, self.pick = depth, least, features, np.random.RandomState(seed)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self.classes, code = np.unique(y, return_inverse=True)
        self.root = self._grow(x, code, self.depth)
        return self

    def _grow(self, x, y, depth):
        count = np.bincount(y, minlength=len(self.classes))
        if not depth or len(y) < 2 * self.least or count.max() == len(y):
            return int(count.argmax())
        best = (1e-12, None, None)
        impurity = 1 - ((count / len(y)) ** 2).sum()
        columns = self.pick.permutation(x.shape[1])[: self.features] if self.features else range(x.shape[1])
        for j in columns:
            for cut in np.unique(np.quantile(x[:, j], np.linspace(0.1, 0.9, 9))):
                left = x[:, j] <= cut
                n = left.sum()
                if min(n, len(y) - n) < self.least:
                    continue
                a, b = np.bincount(y[left], minlength=len(count)), np.bincount(y[~left], minlength=len(count))
                gain = impurity - (n * (1 - ((a / n) ** 2).sum()) + (len(y) - n) * (1 - ((b / (len(y) - n)) ** 2).sum())) / len(y)
                if gain > best[0]:
                    best = (gain, j, cut)
        _, j, cut = best
        if j is None:
            return int(count.argmax())
        left = x[:, j] <= cut
        return j, cut, self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=int)

        def walk(node, rows):
            if isinstance(node, int):
                out[rows] = node
                return
            j, cut, a, b = node
            left = x[rows, j] <= cut
            walk(a, rows[left])
            walk(b, rows[~left])

        walk(self.root, np.arange(len(x)))
        return self.classes[out]


class Forest:
    """Trees over bootstrap samples and random features; the most voted class, the smaller of equals."""

    def __init__(self, trees: int = 20, depth: int = 5, seed: int = 0):
        self.trees, self.depth, self.seed = trees, depth, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        pick = np.random.RandomState(self.seed)
        wide = max(1, int(np.sqrt(x.shape[1])))
        self.members = []
        for t in range(self.trees):
            rows = pick.randint(len(x), size=len(x))
            self.members.append(Tree(self.depth, 5, wide, self.seed + t).fit(x[rows], y[rows]))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return majority(np.array([m.predict(x) for m in self.members]))


def majority(votes: np.ndarray) -> np.ndarray:
    classes = np.unique(votes)
    return classes[np.array([(votes == c).sum(0) for c in classes]).argmax(0)]


def local_models(frame: BlockFrame, features: str, label: str, make: Callable[[], object], order: str, test_share: float = 0.1) -> DataFrame:
    """Per block a model of its first rows and its accuracy on the last ``test_share`` of them."""
    import pickle

    def run(block: int, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        x, y = np.array(rows[features].tolist(), dtype=float), rows[label].to_numpy()
        cut = len(x) - max(1, int(len(x) * test_share))
        model = make().fit(x[:cut], y[:cut])
        accuracy = float((model.predict(x[cut:]) == y[cut:]).mean())
        return pd.DataFrame({"block_id": [block], "accuracy": [accuracy], "model": [pickle.dumps(model)]})

    return frame.local(run, "block_id long, accuracy double, model binary", [features, label, order])


def trimmed(models: DataFrame, tail: float = 0.1, by_score: bool = True) -> DataFrame:
    """Models between the tail-th lowest and highest accuracy; of under three, all. ``weight`` is the accuracy, or 1."""
    if not by_score:
        return models.withColumn("weight", F.lit(1.0))
    w = Window.partitionBy(F.lit(0))  # one row per block
    ranked = models.withColumns({"_n": F.count("*").over(w), "_up": F.row_number().over(w.orderBy("accuracy", "block_id"))})
    cut = F.greatest(F.lit(1), F.floor(F.col("_n") * tail))
    bounds = ranked.withColumns({"_low": F.max(F.when(F.col("_up") == cut + 1, F.col("accuracy"))).over(w), "_high": F.max(F.when(F.col("_up") == F.col("_n") - cut, F.col("accuracy"))).over(w)})
    kept = bounds.where((F.col("_n") < 3) | F.col("accuracy").between(F.col("_low"), F.col("_high")))
    return kept.withColumn("weight", F.col("accuracy")).drop("_n", "_up", "_low", "_high")


def vote_predictions(frame: BlockFrame, models: DataFrame, features: str, key: str, label: str, most: int = 1000) -> DataFrame:
    """(key, label, predicted): every row's majority over the members' predictions, ties to the smaller class.

    The members, one per trained block, are an ensemble of ``most`` at most; they travel to the rows.
    """
    import pickle

    found = models.select("model", "block_id").orderBy("block_id").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} models")
    members = frame.df.sparkSession.sparkContext.broadcast([r.model for r in found])

    def run(batches):
        ensemble = [pickle.loads(m) for m in members.value]
        for rows in batches:
            if len(rows):
                x = np.array(rows[features].tolist(), dtype=float)
                yield pd.DataFrame({BLOCK: rows[BLOCK], key: rows[key], label: rows[label], "predicted": majority(np.array([m.predict(x) for m in ensemble]))})

    df = frame.df.select(BLOCK, key, features, label)
    return df.mapInPandas(run, f"{BLOCK} long, {key} {df.schema[key].dataType.simpleString()}, {label} {df.schema[label].dataType.simpleString()}, predicted long")


def weighted_accuracy(predictions: DataFrame, label: str) -> DataFrame:
    """Accuracy per block, averaged by the blocks' sizes."""
    per = predictions.groupBy(BLOCK).agg(F.avg((F.col(label) == F.col("predicted")).cast("int")).alias("a"), F.count("*").alias("n"))
    return per.agg((F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
