"""Language identification of pages by Bayesian evidence fusion (operator 8).

For each page and language the posterior is the product of

* the likelihood of its main text under a byte-trigram model of the language, tempered,
  for neighbouring trigrams aren't independent;
* the likelihood of the language that the markup declares, from counted confusions;
* a prior of its host, smoothed towards the prior of its domain, that towards the prior of
  its address suffix, and that towards all pages: grouped counts of the other pages'
  votes by text, each level with the weight of ``STRENGTH`` pages.

A page's own vote is left out of its priors. The text models are fitted on a bounded
sample, about ``sample_rows`` documents per language by hash of their id, and their tasks
send only the trigrams they saw; votes and confusions are counted over all pages. A host
arrives as partial counts. Priors of hosts of over a ``HOT``-th of all pages, fewer than
``HOT`` by that, are broadcast; those of others meet their pages in a join.

Defined cases: null html has no text and declares nothing; null url has no host and takes
the prior of all pages; without any text, declaration or vote the prior decides, ties by
name; documents of null lang or text teach nothing, nor do those whose lang isn't two or
three letters, with or without a region (its case doesn't matter); without labelled
documents the language is null; over ``MOST_LANGUAGES`` languages raise an error, for their
tables are broadcast;
very long pages are read whole; repeated rows are judged each by itself; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .page_text import host_of, main_text
from .storage import materialize, small_batches
from .textops import slices, string_buffer

BITS = 16
STRENGTH = 5.0
TEMPER = 0.3
SMOOTH = 0.5
HOT = 1024
MOST_LANGUAGES = 400
SLOTS = np.dtype([("slot", "<u2"), ("n", "<u4")])
HTML_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", re.I)
META_LANG = re.compile(r"<meta\b[^>]*?(?:content-language|og:locale)[\"']?[^>]*?\bcontent\s*=\s*[\"']?([a-zA-Z]{2,3})\b", re.I)


def trigram_counts(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Each lower-cased text's slots of byte trigrams, digits as one."""
    low = raw.astype(np.uint32)
    low[(low >= 48) & (low <= 57)] = 48
    slot = np.zeros(0, np.int64)
    if len(low) > 2:
        slot = (((low[:-2] << 16) | (low[1:-1] << 8) | low[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield slot[a : max(a, b - 2)]


def _count(languages: list[str]):
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << BITS), dtype=np.uint32)  # of a sample of bounded size
        for batch in slices(batches, "text"):
            for lang, slot in zip(batch.column(0).to_pylist(), trigram_counts(*string_buffer(pc.utf8_lower(batch.column(1)))), strict=True):
                np.add.at(total[place[lang]], slot, 1)
        some = [i for i in range(len(languages)) if total[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array([languages[i] for i in some], pa.string()), pa.array([_seen(total[i]) for i in some], pa.binary())], names=["lang", "counts"])

    return run


def _seen(total: np.ndarray) -> bytes:
    """Only the slots that occurred: what a task sends grows with its sample, not with the number of tasks."""
    at = np.flatnonzero(total)
    out = np.empty(len(at), dtype=SLOTS)
    out["slot"], out["n"] = at, total[at]
    return out.tobytes()


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << BITS, dtype=np.uint32)
    for x in table["counts"]:
        e = np.frombuffer(x.as_buffer(), SLOTS)
        total[e["slot"]] += e["n"]
    return pa.table({"lang": table["lang"][:1], "counts": pa.array([_seen(total)], pa.binary())})


def fit(docs: DataFrame, sample_rows: int = 3000) -> tuple[list[str], np.ndarray]:
    """The languages, by name, and their log probabilities of each trigram slot."""
    code = F.lower(F.regexp_extract(F.col("lang").cast("string"), r"^\s*([a-zA-Z]{2,3})(?:[-_][a-zA-Z0-9_-]*)?\s*$", 1))
    taught = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", code.alias("lang"), F.col("text").cast("string").alias("text")).where("lang <> ''")
    counted = taught.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    sizes = {r.lang: r["count"] for r in counted}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((0, 1 << BITS), np.float32)
    limit = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, sample_rows / n) * (1 << 32))))])
    sample = taught.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < limit[F.col("lang")]).select("lang", "text")
    counts = np.full((len(languages), 1 << BITS), SMOOTH)
    for r in sample.mapInArrow(_count(languages), "lang string, counts binary").groupBy("lang").applyInArrow(_add, "lang string, counts binary").collect():  # one row per language
        e = np.frombuffer(r.counts, SLOTS)
        counts[languages.index(r.lang), e["slot"]] += e["n"]
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def declared(page: str | None) -> str | None:
    m = HTML_LANG.search(page) or META_LANG.search(page) if page else None
    return m[1].lower() if m else None


def _weigh(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model.value
        for batch in slices(batches, "html"):
            pages = batch.column(2).to_pylist()
            raw, offsets = string_buffer(pc.utf8_lower(pa.array([main_text(p) for p in pages], pa.string())))
            text = np.zeros((len(pages), len(logs)))
            for i, slot in enumerate(trigram_counts(raw, offsets)):
                if len(slot):
                    text[i] = logs[:, slot].sum(axis=1, dtype=np.float64) * TEMPER
            text -= text.max(axis=1, keepdims=True, initial=0) if not len(logs) else text.max(axis=1, keepdims=True)
            has = np.diff(offsets) > 2
            vote = [int(v) if h else None for v, h in zip(text.argmax(axis=1), has, strict=True)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, text.size + 1, len(logs)), pa.int32()), pa.array(text.reshape(-1), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat, pa.array(vote, pa.int32()), pa.array([declared(p) for p in pages], pa.string())], names=["page_id", "url", "text", "vote", "declared"])

    return run


def identify(pages: DataFrame, docs: DataFrame, sample_rows: int = 3000) -> DataFrame:
    """page_id, url, lang, probability, text_lang (by text alone) and declared."""
    spark = pages.sparkSession
    small_batches(spark)
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    languages, logs = fit(docs, sample_rows)
    if not languages:
        none = F.lit(None).cast("string")
        return pages.select("page_id", "url", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"))
    k = len(languages)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema.fields[:2])
    seen = pages.mapInArrow(_weigh(spark.sparkContext.broadcast(logs)), f"{head}, text array<double>, vote int, declared string")
    host = F.coalesce(host_of(F.col("url")), F.lit(""))
    seen = materialize(seen.withColumn("host", host), "language-evidence")
    # A domain is a label and its address suffix, "co.uk" and the like counting as one suffix.
    domain, suffix = F.regexp_extract("host", r"([^.]*\.(?:(?:co|com|net|org|ac|gov|edu|ne|or|go)\.[^.]{2}|[^.]*))$", 1), F.regexp_extract("host", r"([^.]*)$", 1)
    votes = [F.count(F.when(F.col("vote") == i, 1)) for i in range(k)]
    hosts = seen.groupBy("host").agg(F.array(*votes).alias("n_host"), F.count("*").alias("pages")).withColumns({"domain": F.when(domain == "", F.col("host")).otherwise(domain), "suffix": suffix})
    total = lambda c, out: F.array(*[F.sum(F.col(c)[i]) for i in range(k)]).alias(out)
    domains = hosts.groupBy("domain", "suffix").agg(total("n_host", "n_domain"))
    suffixes = domains.groupBy("suffix").agg(total("n_domain", "n_suffix"))
    everything = suffixes.agg(total("n_suffix", "n")).first()  # one row
    most = seen.count() / HOT
    n_all = F.array(*[F.lit(int(x or 0)) for x in (everything.n or [0] * k)])
    priors = hosts.join(domains.drop("suffix"), "domain").join(suffixes, "suffix").select("host", "pages", "n_host", "n_domain", "n_suffix")
    # How often pages of each voted language declare each language: languages x declarations, a bounded table of named ones.
    spoken = F.when(F.col("declared").isin(languages), F.col("declared")).when(F.col("declared").isNotNull(), "other")
    confusion = {(r.vote, r.d): r["count"] for r in seen.where("vote is not null").withColumn("d", spoken).groupBy("vote", "d").count().collect()}
    names = [*languages, "other"]

    def told(i: int, d: str) -> float:
        heard = sum(confusion.get((i, x), 0) for x in names)
        true = 0.9 if d == languages[i] else 0.1 / k  # before any count: declarations are mostly right
        return float(np.log((confusion.get((i, d), 0) + STRENGTH * true) / (heard + STRENGTH)))

    table = F.create_map(*[x for d in names for x in (F.lit(d), F.array(*[F.lit(told(i, d)) for i in range(k)]))])
    own = lambda i: F.when(F.col("vote") == i, 1).otherwise(0)

    def smoothed(i: int) -> Column:
        size = F.when(F.col("vote").isNotNull(), 1).otherwise(0)
        value = F.lit(1.0 / k)
        for counts in (n_all, F.col("n_suffix"), F.col("n_domain"), F.col("n_host")):
            whole = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x) - size
            value = (counts[i] - own(i) + STRENGTH * value) / (whole + STRENGTH)
        return F.log(value)

    # A host may hold a third of all pages: fewer than HOT hosts have over a HOT-th, and their priors are broadcast.
    priors = materialize(priors, "language-priors")
    hot, cold = priors.where(F.col("pages") > most).drop("pages"), priors.where(F.col("pages") <= most).drop("pages")
    met = seen.join(F.broadcast(hot), "host").unionByName(seen.join(F.broadcast(hot.select("host")), "host", "left_anti").join(cold, "host")).withColumn("d", spoken)
    score = lambda i: smoothed(i) + F.col("text")[i] + F.when(F.col("d").isNull(), 0.0).otherwise(table[F.col("d")][i])
    ranked = met.withColumn("_all", F.array(*[F.struct(score(i).alias("log"), F.lit(-i).alias("back")) for i in range(k)])).withColumn("_top", F.array_max("_all"))
    mass = F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.exp(x["log"] - F.col("_top.log")))
    named = F.array(*[F.lit(x) for x in languages])
    return ranked.select("page_id", "url", F.get(named, -F.col("_top.back")).alias("lang"), (1 / mass).alias("probability"), F.get(named, F.col("vote")).alias("text_lang"), "declared")
