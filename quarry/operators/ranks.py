"""Exact percentiles of tables of any size, per group.

A sketch of a group's values bounds each percentile from both sides; then the values
below the bounds are only counted, and those between them, about a thousandth of the
rows and their ties, are counted by value. No task holds a group, and the sketch decides
no result: were a percentile outside its bounds, the query would raise an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY, SLACK = 10_000, 5e-4  # of the sketch; its error in rank is 1 / ACCURACY of the rows at most


def percentiles(df: DataFrame, columns: Sequence[str], shares: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per group of ``keys`` and column, an array with a value for each share (a decimal number, as text): the least of
    the column's values, nulls left out, that this share of them doesn't exceed. Null where a group has none."""
    named = [f"_k{i}" for i in range(len(keys))]
    df = df.select(*[F.col(f"`{k}`").alias(x) for k, x in zip(keys, named, strict=True)], *[F.col(f"`{c}`").alias(f"_v{i}") for i, c in enumerate(columns)])
    values = [f"_v{i}" for i in range(len(columns))]
    parts = [Fraction(s).limit_denominator(10**9) for s in shares]
    asked = F.array(*[F.lit(min(1.0, max(0.0, float(p) + d))) for d in (-SLACK, SLACK) for p in parts])
    bounds = df.groupBy(*[F.col(k).alias(f"{k}b") for k in named]).agg(*[x for v in values for x in (F.count(v).alias(f"{v}n"), F.percentile_approx(v, asked, ACCURACY).alias(f"{v}q"))])
    if named:
        met = [F.col(k).eqNullSafe(F.col(f"{k}b")) for k in named]
        rows = df.join(bounds, met)
    else:
        rows = df.crossJoin(F.broadcast(bounds))

    def met_by(i: int, k: int) -> Column:
        """A row's part in the k-th percentile of column i; null if it lies above."""
        v, low, high = F.col(values[i]), F.col(f"{values[i]}q")[k], F.col(f"{values[i]}q")[len(parts) + k]
        share = parts[k]
        target = F.expr(f"greatest(1L, ({values[i]}n * {share.numerator}L + {share.denominator - 1}L) div {share.denominator}L)")
        below = v < low
        own = [F.when(~below, v).alias(x) if x == values[i] else F.lit(None).cast(df.schema[x].dataType).alias(x) for x in values]
        return F.when(v <= high, F.struct(F.lit(i * len(parts) + k).alias("_i"), target.alias("_target"), below.alias("_below"), *own))

    each = [met_by(i, k) for i in range(len(values)) for k in range(len(parts))]
    counted = rows.select(*named, F.explode(F.array(*each)).alias("_p")).where("_p is not null").select(*named, "_p.*").groupBy(*named, "_i", "_target", "_below", *values).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*named, "_i").orderBy(F.desc("_below"), *values).rowsBetween(Window.unboundedPreceding, 0)
    reached = counted.withColumn("_to", F.sum("_n").over(order)).where("_to >= _target")
    first = reached.groupBy(*named, "_i").agg(F.max("_below").alias("_missed"), *[F.min(v).alias(v) for v in values])
    sound = lambda v, i: F.when(F.col("_i") == i, F.when(F.col("_missed"), F.raise_error(F.lit("a percentile lies below its bounds")).cast(df.schema[v].dataType)).otherwise(F.col(v)))
    found = first.groupBy(*named).agg(*[F.max(sound(v, i * len(parts) + k)).alias(f"{v}_{k}") for i, v in enumerate(values) for k in range(len(parts))])
    back = [F.col(f"{k}b").eqNullSafe(F.col(k)) for k in named]
    whole = bounds.join(found, back, "left") if named else bounds.crossJoin(found)

    def checked(v: str, k: int) -> Column:
        lost = F.col(f"{v}_{k}").isNull() & (F.col(f"{v}n") > 0)
        return F.when(lost, F.raise_error(F.lit("a percentile lies above its bounds")).cast(df.schema[v].dataType)).otherwise(F.col(f"{v}_{k}"))

    return whole.select(*[F.col(f"{k}b").alias(x) for k, x in zip(named, keys, strict=True)], *[F.array(*[checked(v, k) for k in range(len(parts))]).alias(c) for v, c in zip(values, columns, strict=True)])
