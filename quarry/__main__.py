"""Block jobs from the command line: ``python -m quarry itemsets|cluster|classify ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from quarry.operators import local_global as lg
from quarry.operators.blocks import BlockStore, choose, split
from quarry.session import build_session


def parse(arguments: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quarry", description="Local and global operations over stored blocks.")
    p.add_argument("--master")
    p.add_argument("--conf", default="", help="k=v,k=v")
    p.add_argument("--seed", type=int, default=0)
    jobs = p.add_subparsers(dest="job", required=True)
    for name, text in (("itemsets", "frequent itemsets, voted over blocks"), ("cluster", "centres of pooled block centres"), ("classify", "an ensemble of block models")):
        j = jobs.add_parser(name, help=text)
        j.add_argument("source", help="a dataset of blocks")
        j.add_argument("target", help="where the result goes, as Parquet")
        j.add_argument("--sizes", type=lambda s: [int(x) for x in s.split(",")], required=True, help="numbers of blocks, one run each")
        if name == "itemsets":
            j.add_argument("--items", default="items")
            j.add_argument("--support", type=float, required=True, help="share of baskets")
            j.add_argument("--recount", action="store_true", help="recount exactly instead of voting")
        else:
            j.add_argument("--features", default="features")
        if name == "cluster":
            j.add_argument("--k", type=int, default=2)
            j.add_argument("--method", choices=("kmeans", "trials"), default="kmeans")
        if name == "classify":
            j.add_argument("--label", default="label")
            j.add_argument("--key", default="id")
            j.add_argument("--method", choices=("lr", "tree", "forest"), default="lr")
            j.add_argument("--predict", type=int, default=1, help="blocks to predict")
            j.add_argument("--tail", type=float, default=0.1)
            j.add_argument("--local-only", action="store_true", help="store the block models without integrating them")
    return p.parse_args(arguments)


def run(a: argparse.Namespace, spark=None) -> list[str]:
    """One result per size; returns their paths."""
    settings = {k.replace(".", "__"): v for k, v in (x.split("=", 1) for x in a.conf.split(",") if x)}
    spark = spark or build_session(master=a.master, **settings)
    frame, out = BlockStore(spark, a.source).open(a.source), []
    for turn, size in enumerate(a.sizes):
        if a.job == "classify":
            train, predict = split(frame.n_blocks, size, a.predict, a.seed + turn)
        else:
            train, predict = choose(frame.n_blocks, size, a.seed + turn), []
        some = frame.subset(train)
        if a.job == "itemsets":
            least = max(1, int(some.df.count() * a.support / size))
            local = lg.local_itemsets(some, a.items, least)
            if a.recount:
                rows = some.df.withColumn("basket", F.monotonically_increasing_id()).select("basket", F.explode(a.items).alias("item"))
                result = lg.recount_itemsets(local, rows, "basket", "item", a.support)
            else:
                result = lg.vote_itemsets(local, size)
        elif a.job == "cluster":
            method = {"kmeans": lg.kmeans, "trials": lg.best_of_trials}[a.method]
            result = lg.global_centres(lg.local_centres(some, a.features, a.k, method, a.seed), a.k, a.seed, method)
        else:
            make = {"lr": lg.Logistic, "tree": lg.Tree, "forest": lg.Forest}[a.method]
            result = lg.local_models(some, a.features, a.label, make, a.key)
            if not a.local_only:
                votes = lg.vote_predictions(frame.subset(predict), lg.trimmed(result, a.tail), a.features, a.key, a.label)
                result = lg.weighted_accuracy(votes, a.label)
        out.append(f"{a.target}/size={size}")
        result.write.mode("overwrite").parquet(out[-1])
    return out


if __name__ == "__main__":
    run(parse())
