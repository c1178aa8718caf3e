"""Random-sample blocks: a table as N blocks, each a random sample of the whole.

A block is a value of ``block_id``. Stored, it is a directory of its own, so a choice of
blocks is partition pruning: other blocks aren't read. Assignment is by a seeded random
number, or by a hash of the row's keys where the same blocks must come out again, on any
engine. Neither needs a count or an order of rows.
"""

from __future__ import annotations

import json
import math
import os
import random
import re
from collections.abc import Callable, Iterable, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import percentiles

BLOCK = "block_id"
DEFAULT_STATS = ("count", "mean", "stddev", "min", "25%", "50%", "75%", "max")
FEW_FILES = 50_000
WHOLE_FILE = 1 << 40


def keyed_block(n: int, *keys: str | Column) -> Column:
    """Block of a row by its keys: the first 32 bits of their joined text's MD5, modulo n."""
    joined = F.concat_ws("|", *[F.col(k) if isinstance(k, str) else k for k in keys])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long") % n


def random_block(n: int, seed: int = 0) -> Column:
    return F.least(F.floor(F.rand(seed) * n), F.lit(n - 1)).cast("long")


def choose(n_blocks: int, n: int, seed: int = 0) -> list[int]:
    """n different block ids by a seeded permutation."""
    if not 0 <= n <= n_blocks:
        raise ValueError(f"{n} of {n_blocks} blocks were asked for")
    return random.Random(seed).sample(range(n_blocks), n)


def split(n_blocks: int, train: int, predict: int, seed: int = 0) -> tuple[list[int], list[int]]:
    """Disjoint ids to train on and to predict."""
    if train + predict > n_blocks:
        raise ValueError("train and predict blocks exceed all blocks")
    ids = choose(n_blocks, train + predict, seed)
    return ids[:train], ids[train:]


class BlockFrame:
    """A DataFrame whose ``block_id`` says in which of ``n_blocks`` random samples a row is."""

    def __init__(self, df: DataFrame, n_blocks: int, block: str = BLOCK):
        self.df, self.n_blocks, self.block = df, n_blocks, block

    @classmethod
    def assign(cls, df: DataFrame, n: int, keys: Sequence[str] = (), seed: int = 0) -> BlockFrame:
        return cls(df.withColumn(BLOCK, keyed_block(n, *keys) if keys else random_block(n, seed)), n)

    def subset(self, blocks: int | Sequence[int] = 1, seed: int = 0) -> BlockFrame:
        """Some blocks, by number or by id."""
        ids = choose(self.n_blocks, blocks, seed) if isinstance(blocks, int) else list(blocks)
        if unknown := [i for i in ids if not 0 <= i < self.n_blocks]:
            raise ValueError(f"no such blocks: {unknown}")
        return BlockFrame(self.df.where(F.col(self.block).isin(ids)), len(ids), self.block)

    def reindexed(self, ids: Sequence[int]) -> DataFrame:
        """Blocks ``ids`` numbered anew by their place in the list."""
        place = F.create_map(*[x for i, b in enumerate(ids) for x in (F.lit(b), F.lit(i))])
        return self.subset(ids).df.withColumn("position", place[F.col(self.block).cast("int")])

    def collect(self, blocks: int | Sequence[int] = 1, seed: int = 0) -> list:
        return self.subset(blocks, seed).df.collect()

    def describe(self, blocks: int | Sequence[int] = 1, stats: Sequence[str] = DEFAULT_STATS, seed: int = 0) -> DataFrame:
        """Summary statistics of some blocks, as text, one row per statistic."""
        for s in stats:
            if s.endswith("%"):
                try:
                    share = float(s[:-1])
                except ValueError:
                    raise ValueError(f"{s} is no percentile") from None
                if not 0 <= share <= 100:
                    raise ValueError(f"{s} is outside 0% to 100%")
            elif s not in ("count", "mean", "stddev", "min", "max"):
                raise ValueError(f"{s} is no statistic")
        df, stats = self.subset(blocks, seed).df.drop(self.block), list(stats) or DEFAULT_STATS
        columns = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType))]
        shares, plain = ([s for s in dict.fromkeys(stats) if s.endswith("%") == is_share] for is_share in (True, False))
        if not shares or not columns:
            return df.summary(*stats)
        numbers = df.select(*[F.expr(f"try_cast(`{c}` as double)").alias(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(f"`{c}`") for c in columns])
        at = percentiles(numbers, columns, [str(Fraction(s[:-1]) / 100) for s in shares])
        rows = at.select(F.explode(F.array(*[F.struct(F.lit(s).alias("summary"), *[F.col(f"`{c}`")[i].cast("string").alias(c) for c in columns]) for i, s in enumerate(shares)])).alias("_row")).select("_row.*")
        rows = df.summary(*plain).unionByName(rows) if plain else rows
        places = F.create_map(*[x for s in dict.fromkeys(stats) for x in (F.lit(s), F.array(*[F.lit(i) for i, t in enumerate(stats) if t == s]))])
        place = "_place" + "_" * max(len(c) for c in columns)  # no column has this name
        return rows.withColumn(place, F.explode(places[F.col("summary")])).orderBy(place).drop(place)

    def map_rows(self, f: Callable[[Iterable[pd.DataFrame]], Iterable[pd.DataFrame]], schema: str, blocks: int | Sequence[int] | None = None, seed: int = 0) -> DataFrame:
        """f over the rows of some blocks in batches; a block may come in several pieces."""
        return (self if blocks is None else self.subset(blocks, seed)).df.mapInPandas(f, schema)

    def local(self, f: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str, columns: Sequence[str] | None = None) -> DataFrame:
        """Local operation: f once per block, on all its rows, which fit one task by the choice of N."""
        df = self.df.select(self.block, *columns) if columns else self.df
        return df.groupBy(self.block).applyInPandas(lambda key, rows: f(int(key[0]), rows), schema)

    def local_by_id(self, functions: dict[int, Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
        """Another function for each of the named blocks."""
        return self.subset(sorted(functions)).local(lambda i, rows: functions[i](rows), schema)


def mean_estimate(frame: BlockFrame, column: str, ids: Sequence[int], z: float = 1.96) -> DataFrame:
    """Mean of a column from some blocks, with the interval that their spread gives."""
    x = F.col(column).cast("double")
    s = frame.subset(ids).df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev(x).alias("sd"))
    half = z * F.col("sd") / F.sqrt("n")
    return s.select("n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def sum_estimate(frame: BlockFrame, column: str, ids: Sequence[int]) -> DataFrame:
    """Count and sum of the whole, scaled up from some blocks."""
    scale = frame.n_blocks / len(ids)
    return frame.subset(ids).df.agg((F.count("*") * scale).alias("count"), (F.sum(column) * scale).alias("sum"))


def count_bounds(frame: BlockFrame, ids: Sequence[int], keys: Sequence[str] = (), z: float = 1.96) -> DataFrame:
    """Count of the whole, per ``keys`` if any, from some blocks: low, count, high. Each row lies in those blocks
    with the chance p that the blocks are of all, so n rows there stand for n / p, give or take z sqrt(n (1 - p)) / p."""
    p = len(ids) / frame.n_blocks
    n, half = F.col("_n"), z * F.sqrt(F.col("_n") * (1 - p)) / p
    counted = frame.subset(ids).df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counted.select(*keys, F.greatest(n, n / p - half).alias("low"), (n / p).alias("count"), (n / p + half).alias("high"))


def sum_bounds(frame: BlockFrame, column: str, ids: Sequence[int], z: float = 1.96) -> DataFrame:
    """Sum of the whole from some blocks: low, sum, high, by the spread of the rows' parts of the sum, rows not chosen being 0."""
    p, x = len(ids) / frame.n_blocks, F.col(column).cast("double")
    s = frame.subset(ids).df.agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    half = z * F.sqrt(F.col("q") * (1 - p)) / p
    return s.select((F.col("s") / p - half).alias("low"), (F.col("s") / p).alias("sum"), (F.col("s") / p + half).alias("high"))


def share_for(size: int, total: int, miss: float = 1e-4) -> float:
    """A share of ``total`` rows, each drawn by itself, of which fewer than ``size`` come with a chance of ``miss`` at most (Chernoff's bound)."""
    share, slack = size / total, -math.log(miss) / total
    return min(1.0, max(1e-10, share + slack + math.sqrt(slack * slack + 2 * slack * share)))


def reservoir(df: DataFrame, size: int, keys: Sequence[str], total: int) -> DataFrame:
    """Exactly ``size`` rows, all sets of them alike likely: those of the least hashes of ``keys``. Rows beyond the
    share that holds ``size`` of them almost surely don't reach the sort; were they too few, all rows would."""
    place = F.md5(F.concat_ws("|", *keys))
    first = f"{min((1 << 32) - 1, int(share_for(size, total) * (1 << 32))):08x}"
    few = df.withColumn("_place", place).where(F.col("_place") <= first + "f" * 24)
    if few.count() < min(size, total):
        few = df.withColumn("_place", place)
    return few.orderBy("_place").limit(size).drop("_place")


# Block store.


def file_type(path: str) -> str:
    """A path's format by its suffix, text if it says none."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lstrip(".")
    return suffix if suffix in ("csv", "parquet", "json", "orc", "text") else "text"


def read_any(spark: SparkSession, path: str, kind: str | None = None, **options: str) -> DataFrame:
    return spark.read.format(kind or file_type(path)).options(**options).load(path)


class BlockReader:
    """Reads files so that one file is one partition, never cut and never packed with others.

    The two settings that see to that hold in a session of the reader's own.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark.newSession()
        for key in ("maxPartitionBytes", "openCostInBytes"):
            self.spark.conf.set(f"spark.sql.files.{key}", WHOLE_FILE)

    def load(self, path: str | list[str], kind: str | None = None, **options: str) -> DataFrame:
        """The files' rows; ``block_id`` numbers the files by full path, from a table of files that meets the rows."""
        df = self.spark.read.format(kind or file_type(path if isinstance(path, str) else path[0])).options(**options).load(path)
        listed = sorted(re.sub(":/+", ":/", f, count=1) for f in df.inputFiles())  # a scheme's slashes are written in two ways
        files = self.spark.createDataFrame([(f, i) for i, f in enumerate(listed)], f"_file string, {BLOCK} long")
        if len(listed) <= FEW_FILES:  # some MB at most; a shuffle would also take the rows out of their files' partitions
            files = F.broadcast(files)
        return df.withColumn("_file", F.regexp_replace("_metadata.file_path", "^([^:/]+):/+", "$1:/")).join(files, "_file", "left").drop("_file")

    def csv(self, path, **options):
        return self.load(path, "csv", **options)

    def json(self, path, **options):
        return self.load(path, "json", **options)

    def parquet(self, path, **options):
        return self.load(path, "parquet", **options)

    def orc(self, path, **options):
        return self.load(path, "orc", **options)

    def text(self, path, **options):
        return self.load(path, "text", **options)


class BlockStore:
    """Datasets of blocks under ``root/database/name``, with a small file about each."""

    ABOUT = "_blocks.json"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, database: str, name: str) -> str:
        return f"{self.root}/{database}/{name}"

    def convert(self, source: str | DataFrame, n: int, target: str, source_kind: str | None = None, target_kind: str | None = None, keys: Sequence[str] = (), seed: int = 0, files: int = 1) -> str:
        """Any table of a known format, as n blocks of another, of about ``files`` files each; a kind that is named alone holds for both."""
        kind_in = source_kind or target_kind
        kind_out = target_kind or source_kind or (file_type(target) if os.path.splitext(target)[1] else file_type(source) if isinstance(source, str) else "parquet")
        df = source if isinstance(source, DataFrame) else read_any(self.spark, source, kind_in)
        blocks = BlockFrame.assign(df, n, keys, seed).df
        # By range, for hashes of few block numbers collide; a block of several files is spread over as many tasks.
        grain = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files))
        blocks.withColumn("_grain", grain).repartitionByRange(n * files, BLOCK, "_grain").drop("_grain").write.mode("overwrite").format(kind_out).partitionBy(BLOCK).save(target)
        self._describe(target, kind_out, n)
        return target

    def create(self, source: str | DataFrame, n: int, database: str, name: str, kind: str = "parquet", keys: Sequence[str] = (), seed: int = 0) -> str:
        return self.convert(source, n, self.path(database, name), None, kind, keys, seed) if isinstance(source, DataFrame) else self.convert(source, n, self.path(database, name), file_type(source), kind, keys, seed)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place, jvm

    def _describe(self, target: str, kind: str, n: int) -> None:
        fs, place, jvm = self._fs(target)
        names = sorted((s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().startswith(f"{BLOCK}=")), key=lambda x: int(x.split("=")[1]))
        about = {"kind": kind, "count": n, "names": names, "locations": {x: f"{target}/{x}" for x in names}}
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{target}/{self.ABOUT}"), True)
        out.write(bytearray(json.dumps(about).encode()))
        out.close()

    def about(self, target: str) -> dict:
        """Format, number, names and places of a dataset's blocks."""
        fs, place, jvm = self._fs(f"{target}/{self.ABOUT}")
        stream = fs.open(place)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def open(self, target: str, schema=None) -> BlockFrame:
        about = self.about(target)
        reader = self.spark.read.format(about["kind"])
        df = (reader.schema(schema) if schema is not None else reader).load(target)
        return BlockFrame(df, about["count"])

    def take(self, target: str, names: Sequence[str]) -> DataFrame:
        """Named blocks as one frame of one partition."""
        return self.spark.read.format(self.about(target)["kind"]).option("basePath", target).load([f"{target}/{x}" for x in names]).coalesce(1)

    def take_each(self, target: str, names: Sequence[str]) -> list[DataFrame]:
        return [self.take(target, [x]) for x in names]

    def apply(self, target: str, names: Sequence[str], f: Callable, schema: str, transfer: Callable[[pd.DataFrame], object] | None = None) -> DataFrame:
        """f once, on all rows of the named blocks together, which fit one task by their choice; ``transfer`` makes of the rows what f takes."""
        run = f if transfer is None else lambda rows: f(transfer(rows))
        return self.take(target, names).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda rows: run(rows), schema)
