"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept, written as
Parquet and read again. The stages but the last return the columns of ``documents``.

Defined cases, of all stages: null text counts as empty (and fails the first stage's base
rules); null lang or source is a group of its own; very long texts are read whole; an empty
table gives an empty result; columns beyond those of ``documents`` survive, whatever their
names. Of rows that repeat a doc_id the first two stages keep all if they keep one, the
third keeps one, the fourth treats them as one document. A row of null doc_id, which no
verdict can name, goes in the first two stages; the others keep such rows as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import jaccard_join, packing, pairwise_quality, quality_rules, suffix_dedup
from quarry.llm.queries import table, tokenizer_path
from quarry.llm.storage import materialize


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go."""
    return quality_rules.keep(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking predicts to be of no quality go."""
    return pairwise_quality.keep(docs, table(spark, sf_dir, "labels"))


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return jaccard_join.keep(docs, size=5, percent=80)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 100 bytes are cut out of the texts."""
    return suffix_dedup.cleaned(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of token sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("ngram_jaccard_join", jaccard_join_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
