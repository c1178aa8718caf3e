"""Quality rules with thresholds that follow the data (operator 4).

Fixed base rules reject very short and very repetitive texts. Every further cutoff is
learned: each (lang, source) group keeps a mergeable quantile sketch of each measure,
and a document goes when a measure lies beyond the group's quartile fence.

The sketch is a histogram over logarithmic buckets (relative error below 1 %). Buckets
of two sketches add up, so partial sketches of tasks merge in any order, the sketches of
small groups merge upward into their language and then into the whole corpus, and its
size is bounded by the number of buckets whatever the number of rows. A hot source is
therefore no hot task: it arrives as partial counts.

Defined cases: null text counts as no words and fails the base rules; null lang or
source form groups of their own; repeated rows are judged alike, each by itself; very long
texts are read whole, one at a time; an empty table gives an empty result; other columns
are ignored by ``judge`` and survive in ``keep``, where a row of null doc_id, which no
verdict names, goes, and rows that repeat a doc_id stay if one of them is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, small_batches
from .textops import SPACE, Words, counts_by_row, mix, slices, string_buffer

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BUCKET_BASE = 1.02
BUCKET_UNIT = 0.001
MIN_GROUP = 50
FENCE = 3.0


@dataclass(frozen=True)
class Measure:
    """A ratio of two counts; ``slack`` is what a fence leaves free even if a group doesn't vary."""

    name: str
    over: str
    under: str
    slack: float
    low: bool = False


MEASURES = (
    Measure("symbols_per_word", "n_symbols", "n_words", 0.1),
    Measure("repeated_words", "n_repeat_words", "n_words", 0.35),
    Measure("repeated_lines", "n_dup_lines", "n_lines", 0.5),
    Measure("chars_per_word", "word_chars", "n_words", 2.0, low=True),
)
CONTRACT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*CONTRACT, "n_lines")


def measure_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row of (row_key..., text): the base counts of the whole text."""
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    for batch in slices(batches, "text"):
        text = batch.column(batch.schema.get_field_index("text"))
        raw, offsets = string_buffer(text)
        words = Words(raw, offsets)
        counts = {
            "n_words": words.per_row,
            "word_chars": counts_by_row(~SPACE[raw] & ((raw & 0xC0) != 0x80), offsets),
            "n_symbols": counts_by_row(symbol[raw], offsets),
            "n_repeat_words": repeated_words(words),
        }
        lines, again = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        whole = raw.tobytes()
        for i in np.flatnonzero(words.per_row):
            own = [x for x in whole[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
            lines[i], again[i] = len(own), len(own) - len(set(own))
        counts |= {"n_lines": lines, "n_dup_lines": again}
        keep = [i for i, f in enumerate(batch.schema) if f.name != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in keep] + [pa.array(counts[c], pa.int64()) for c in COUNTS],
            names=[batch.schema.field(i).name for i in keep] + list(COUNTS),
        )


def repeated_words(words: Words, size: int = 3) -> np.ndarray:
    """Words inside windows of ``size`` words that the row has twice or more."""
    value, at = words.windows(size)
    if not len(at):
        return np.zeros(len(words.per_row), np.int64)
    row = np.searchsorted(words.rows, at, side="right") - 1
    own = value ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words.starts) + 1, dtype=np.int64)
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + size, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return total[words.rows[1:]] - total[words.rows[:-1]]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratio(m: Measure) -> Column:
    return F.col(m.over) / F.when(F.col(m.under) > 0, F.col(m.under)).otherwise(1)


def bucket(x: Column) -> Column:
    return F.when(x <= BUCKET_UNIT, 0).otherwise(F.ceil(F.log(x / BUCKET_UNIT) / float(np.log(BUCKET_BASE)))).cast("int")


def bucket_value(b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(BUCKET_UNIT * F.pow(F.lit(BUCKET_BASE), b - 0.5))


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): a sketch per group and measure, over all rows with words."""
    one = counted.where("n_words > 0").groupBy("lang", "source", *[bucket(ratio(m)).alias(f"b{i}") for i, m in enumerate(MEASURES)]).count()
    pairs = F.array(*[F.struct(F.lit(m.name).alias("measure"), F.col(f"b{i}").alias("bucket")) for i, m in enumerate(MEASURES)])
    return one.select("lang", "source", "count", F.explode(pairs).alias("p")).groupBy("lang", "source", "p.measure", "p.bucket").agg(F.sum("count").alias("n"))


def merged(sketch: DataFrame) -> DataFrame:
    """The sketches with those of each language and of the corpus, as levels 0, 1 and 2."""
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("lang"), F.col("source").alias("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("lang"), F.lit(None).cast("string").alias("source")),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")),
    )
    return sketch.select(F.explode(levels).alias("g"), "measure", "bucket", "n").groupBy("g.level", "g.lang", "g.source", "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """Per level, lang and source: group size and the lower and upper fence of each measure."""
    group = ["level", "lang", "source", "measure"]
    up = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*group)
    ranked = merged(sketch).withColumns({"upto": F.sum("n").over(up), "size": F.sum("n").over(all_)})
    first = lambda q: bucket_value(F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("size")), F.col("bucket"))))
    q = ranked.groupBy(*group).agg(first(0.25).alias("q1"), first(0.75).alias("q3"), F.max("size").alias("size"))
    slack = F.create_map(*[x for m in MEASURES for x in (F.lit(m.name), F.lit(m.slack))])[F.col("measure")]
    wide = q.withColumns({"low": F.col("q1") - FENCE * (F.col("q3") - F.col("q1")) - slack, "high": F.col("q3") + FENCE * (F.col("q3") - F.col("q1")) + slack})
    return wide.groupBy("level", "lang", "source").agg(
        F.max("size").alias("size"),
        *[F.max(F.when(F.col("measure") == m.name, F.col(side))).alias(f"{m.name}_{side}") for m in MEASURES for side in ("low", "high")],
    )


def judge(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: the base counts, ``base_failed`` and ``kept``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias(key), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    schema = rows.drop("text").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    counted = materialize(rows.mapInArrow(measure_texts, schema), "quality-counts")
    limits = fences(sketches(counted))
    # A null key must meet its own group: names get a letter in front, and null is a word without it.
    named = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(c)))
    sides = [f"{m.name}_{s}" for m in MEASURES for s in ("low", "high")]
    level = lambda k: limits.where(F.col("level") == k)
    own = level(0).select(named("lang").alias("_lang"), named("source").alias("_source"), F.lit(0).alias("_all"), F.col("size").alias("_n0"), *[F.col(s).alias(f"{s}_0") for s in sides])
    lang = level(1).select(named("lang").alias("_lang"), F.col("size").alias("_n1"), *[F.col(s).alias(f"{s}_1") for s in sides])
    whole = level(2).select(F.lit(0).alias("_all"), *[F.col(s).alias(f"{s}_2") for s in sides])  # one row, by construction
    groups = own.join(lang, "_lang").join(whole, "_all")
    pick = lambda s: F.when(F.col("_n0") >= MIN_GROUP, F.col(f"{s}_0")).when(F.col("_n1") >= MIN_GROUP, F.col(f"{s}_1")).otherwise(F.col(f"{s}_2")).alias(s)
    groups = groups.select("_lang", "_source", *[pick(s) for s in sides])
    met = counted.withColumns({"_lang": named("lang"), "_source": named("source")}).join(groups, ["_lang", "_source"], "left")
    beyond = F.lit(False)
    for m in MEASURES:
        beyond = beyond | (ratio(m) > F.col(f"{m.name}_high"))
        if m.low:
            beyond = beyond | (ratio(m) < F.col(f"{m.name}_low"))
    more = [c for c in COUNTS if c not in CONTRACT]
    return met.select(key, *CONTRACT, base_failed().alias("base_failed"), (~base_failed() & ~F.coalesce(beyond, F.lit(True))).alias("kept"), *more)


def keep(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns."""
    good = judge(docs, key).where("kept").select(F.col(key).alias("_kept")).distinct()
    return docs.join(good, docs[key] == good["_kept"], "left_semi")


ORACLE = rf"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM base
), tri AS (
  SELECT doc_id, i, w[i] || chr(31) || w[i+1] || chr(31) || w[i+2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
), hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c >= 2
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hits) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
  SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words,
    coalesce(len(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM words w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
), ratios AS (
  SELECT *, unnest([
    {{'measure': 'symbols_per_word', 'slack': 0.1::DOUBLE, 'low': false, 'x': n_symbols::DOUBLE / greatest(n_words, 1)}},
    {{'measure': 'repeated_words', 'slack': 0.35::DOUBLE, 'low': false, 'x': n_repeat_words::DOUBLE / greatest(n_words, 1)}},
    {{'measure': 'repeated_lines', 'slack': 0.5::DOUBLE, 'low': false, 'x': n_dup_lines::DOUBLE / greatest(n_lines, 1)}},
    {{'measure': 'chars_per_word', 'slack': 2.0::DOUBLE, 'low': true, 'x': word_chars::DOUBLE / greatest(n_words, 1)}}], recursive := true)
  FROM counted
), buckets AS (
  SELECT lang, source, measure, slack, CASE WHEN x <= {BUCKET_UNIT}::DOUBLE THEN 0 ELSE ceil(ln(x / {BUCKET_UNIT}::DOUBLE) / {float(np.log(BUCKET_BASE))!r}::DOUBLE) END AS b
  FROM ratios WHERE n_words > 0
), levels AS (
  SELECT 0 AS level, lang, source, measure, slack, b FROM buckets
  UNION ALL SELECT 1, lang, NULL, measure, slack, b FROM buckets
  UNION ALL SELECT 2, NULL, NULL, measure, slack, b FROM buckets
), quart AS (
  SELECT level, lang, source, measure, slack, count(*) AS size,
    list_sort(list(b))[ceil(0.25::DOUBLE * count(*))::BIGINT] AS b1, list_sort(list(b))[ceil(0.75::DOUBLE * count(*))::BIGINT] AS b3
  FROM levels GROUP BY ALL
), q AS (
  SELECT *, CASE WHEN b1 = 0 THEN 0 ELSE {BUCKET_UNIT}::DOUBLE * pow({BUCKET_BASE}::DOUBLE, b1 - 0.5) END AS q1,
    CASE WHEN b3 = 0 THEN 0 ELSE {BUCKET_UNIT}::DOUBLE * pow({BUCKET_BASE}::DOUBLE, b3 - 0.5) END AS q3 FROM quart
), judged AS (
  SELECT r.doc_id, bool_or(x > q.q3 + {FENCE} * (q.q3 - q.q1) + r.slack OR (r.low AND x < q.q1 - {FENCE} * (q.q3 - q.q1) - r.slack)) AS beyond
  FROM ratios r
  LEFT JOIN quart g0 ON g0.level = 0 AND g0.lang IS NOT DISTINCT FROM r.lang AND g0.source IS NOT DISTINCT FROM r.source AND g0.measure = r.measure
  LEFT JOIN quart g1 ON g1.level = 1 AND g1.lang IS NOT DISTINCT FROM r.lang AND g1.measure = r.measure
  LEFT JOIN q ON q.measure = r.measure AND q.level = (CASE WHEN g0.size >= {MIN_GROUP} THEN 0 WHEN g1.size >= {MIN_GROUP} THEN 1 ELSE 2 END)
    AND (q.level = 2 OR q.lang IS NOT DISTINCT FROM r.lang) AND (q.level > 0 OR q.source IS NOT DISTINCT FROM r.source)
  GROUP BY r.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND NOT coalesce(beyond, true)) AS kept, n_lines
FROM counted JOIN judged USING (doc_id)
"""
