"""Exact substring deduplication by run-length compressed indexes (operator 2).

Every byte goes that a string of ``length`` bytes covers which also starts earlier: in a
document of smaller id, or in the same one before. The corpus can't stand in one index,
so it is cut by content:

1. every string of ``length`` bytes has an anchor, its least-hashed ``ANCHOR`` bytes, the
   same wherever the string occurs; an anchor's context is all strings it is anchor of;
2. anchors are dealt out by their hash. A context that occurred before goes whole; where
   an anchor has several contexts, the first of each is a variant of a repetitive family;
3. the families are shared out; each share builds run-length Burrows-Wheeler indexes
   (``run_index``) and streams matching statistics of later variants against earlier ones;
   matches of ``length`` bytes are marked;
4. marked ranges return to their documents, where they are merged and cut out.

Anchors of more than ``FAMILY`` variants don't fit one share, and in text of short period
variants overlap: their strings are dealt out one by one, by hash and with their places,
which is exact too and spreads them over all tasks. Repeats inside a
batch are settled there, so a passage in a third of all rows arrives once per batch.

Defined cases: null text counts as empty; texts under ``length`` bytes lose nothing; a row
with null doc_id is left whole and shows nothing to others; rows repeating a doc_id are one
document and get the same result; very long texts are read whole, one at a time; other
columns are ignored by ``remove_repeats``, and ``cleaned`` returns them as they are; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .run_index import earlier_windows
from .storage import exchange_width, free_name, materialize, small_batches, tidy
from .textops import BYTE_VALUES, U64, mix, powers, slices, string_buffer

LENGTH = 100
ANCHOR = 32
FAMILY = 256
SHARE_BYTES = 2 << 20
OTHER_VALUES = np.random.RandomState(77).randint(1, 2**63 - 1, size=256, dtype=np.int64).astype(U64) * U64(2) + U64(1)

#: A context's place: document, first and last byte, the anchor's distance from the first.
PLACE = np.dtype([("doc", "<i8"), ("start", "<u4"), ("stop", "<u4"), ("lead", "<u4")])
ENTRY = np.dtype([("h", "<u8"), ("c", "<u8"), *PLACE.descr])
RANGE = np.dtype([("doc", "<i8"), ("start", "<u4"), ("stop", "<u4")])
VARIANT = np.dtype([("h", "<u8"), ("rank", "<u4"), *PLACE.descr])
STRING = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("stop", "<u4")])
ENTRIES, RANGES, VARIANTS, CROWDED, TEXT = range(5)
DEALT = "bucket long, kind int, blob binary, bytes binary"


def spots(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of ``length`` bytes inside rows: positions, rows, and hashes of them."""
    n, span = len(raw), length - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, np.zeros(0, U64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(BYTE_VALUES[raw] * up[:-1], out=total[1:])
    h = mix((total[ANCHOR:] - total[:-ANCHOR]) * down[: n - ANCHOR + 1])
    last = np.repeat(offsets[1:], np.diff(offsets)) - length  # the row's last string starts here
    found = []
    step = 1 << 22
    for base in range(0, n - length + 1, step):
        part = h[base : base + step + span - 1]
        key = (part & U64(0xFFFFFFFFFF000000)) | np.arange(len(part), dtype=U64)  # ties to the left
        strings = min(step, n - length + 1 - base, len(part) - span + 1)
        pad = -len(key) % span
        key = np.concatenate([key, np.full(pad, ~U64(0))]).reshape(-1, span)
        upto = np.minimum.accumulate(key, axis=1).reshape(-1)
        since = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(since[:strings], upto[span - 1 : span - 1 + strings])
        valid = np.arange(base, base + strings) <= last[base : base + strings]
        at = (least[valid] & U64(0xFFFFFF)).astype(np.int64) + base
        found.append(at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else none)
    at = np.unique(np.concatenate(found))
    return at, np.searchsorted(offsets, at, side="right") - 1, h[at]


def merge(ranges: np.ndarray) -> np.ndarray:
    """Ranges by document and start, with overlapping and touching ones made one."""
    if not len(ranges):
        return ranges
    r = ranges[np.lexsort((ranges["start"], ranges["doc"]))]
    lift = r["stop"].astype(np.int64)
    doc = np.cumsum(np.concatenate([[True], r["doc"][1:] != r["doc"][:-1]]))
    big = np.int64(1) << 33
    reach = np.maximum.accumulate(lift + doc * big) - doc * big
    head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (r["start"][1:] > reach[:-1])])
    first = np.flatnonzero(head)
    out = r[first].copy()
    out["stop"] = reach[np.append(first[1:], len(r)) - 1]
    return out


def home(doc: np.ndarray, homes: int) -> np.ndarray:
    """The same bucket as ``home_column`` has for a document."""
    d = doc.astype(np.int64)
    return np.mod(d ^ (d >> 17) ^ (d >> 31), homes)


def home_column(homes: int) -> Column:
    d = F.coalesce(F.col("doc_id"), F.lit(0).cast("long"))
    return F.pmod(d.bitwiseXOR(F.shiftright(d, 17)).bitwiseXOR(F.shiftright(d, 31)), F.lit(homes))


def dealt(bucket: np.ndarray, kind: int, rows: np.ndarray) -> pa.RecordBatch:
    """Rows as one blob per bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    blobs = [rows[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(rows))[: len(cut)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), pa.array(np.full(len(cut), kind), pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(len(cut), pa.binary())], names=["bucket", "kind", "blob", "bytes"])


def together(table: pa.Table | pa.RecordBatch, kind: int, dtype: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(b.as_py(), dtype=dtype) for k, b in zip(table["kind"].to_pylist(), table["blob"], strict=True) if k == kind]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def as_table(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches([b for b in batches if b.num_rows] or batches[:1])


def ranges_of(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), dtype=RANGE)
    for name in RANGE.names:
        out[name] = rows[name]
    return out


def settled(rows: np.ndarray, *keys: str) -> tuple[np.ndarray, np.ndarray]:
    """The first row, by document and start, of each key; and the others, but for repeats of the very place."""
    rows = rows[np.lexsort((rows["start"], rows["doc"], *[rows[k] for k in reversed(keys)]))]
    if not len(rows):
        return rows, rows
    first = np.zeros(len(rows), dtype=bool)
    first[0] = True
    for k in keys:
        first[1:] |= rows[k][1:] != rows[k][:-1]
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    same_place = (rows["doc"] == rows["doc"][lead]) & (rows["start"] == rows["start"][lead])
    return rows[first], rows[~first & ~same_place]


def _anchors(length: int, buckets: int):
    reach = length - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            raw, offsets = string_buffer(batch.column(1))
            at, row, h = spots(raw, offsets, length)
            if not len(at):
                continue
            start, stop = np.maximum(offsets[row], at - reach), np.minimum(offsets[row + 1], at + length)
            up, down = powers(len(raw) + 1)
            total = np.zeros(len(raw) + 1, dtype=U64)
            np.cumsum(OTHER_VALUES[raw] * up[:-1], out=total[1:])
            e = np.empty(len(at), dtype=ENTRY)
            e["h"], e["doc"] = h, batch.column(0).to_numpy(zero_copy_only=False)[row]
            e["c"] = mix((total[stop] - total[start]) * down[start] + (at - start).astype(U64) * U64(1009) + (stop - start).astype(U64))
            e["start"], e["stop"], e["lead"] = start - offsets[row], stop - offsets[row], at - start
            fresh, again = settled(e, "h", "c")
            yield dealt((fresh["h"] % U64(buckets)).astype(np.int64), ENTRIES, fresh)
            again = merge(ranges_of(again))
            yield dealt(home(again["doc"], buckets), RANGES, again)

    return run


def _families(homes: int):
    def run(table: pa.Table) -> pa.Table:
        fresh, again = settled(together(table, ENTRIES, ENTRY), "h", "c")
        known = merge(np.concatenate([together(table, RANGES, RANGE), ranges_of(again)]))
        fresh = fresh[np.lexsort((fresh["start"], fresh["doc"], fresh["h"]))]
        head = np.concatenate([[True], fresh["h"][1:] != fresh["h"][:-1]]) if len(fresh) else np.zeros(0, bool)
        group = np.cumsum(head) - 1
        size = np.bincount(group)[group] if len(fresh) else group
        v = np.empty(len(fresh), dtype=VARIANT)
        for name in ("h", *PLACE.names):
            v[name] = fresh[name]
        v["rank"] = np.arange(len(fresh)) - np.flatnonzero(head)[group]
        # Contexts of one anchor that overlap in a document hold the same strings: only places tell these apart.
        tangled = np.zeros(len(fresh), dtype=bool)
        tangled[1:] = ~head[1:] & (fresh["doc"][1:] == fresh["doc"][:-1]) & (fresh["start"][1:] < fresh["stop"][:-1])
        one_by_one = (size > FAMILY) | (np.bincount(group, weights=tangled)[group] > 0 if len(fresh) else tangled)
        out = [dealt(home(known["doc"], homes), RANGES, known)]
        for kind, some in ((VARIANTS, (size > 1) & ~one_by_one), (CROWDED, (size > 1) & one_by_one)):
            out.append(dealt(home(v[some]["doc"], homes), kind, v[some]))
        return as_table(out)

    return run


def _spell(length: int, buckets: int):
    """Of a home bucket's documents and variants: the variants with their bytes, and crowded anchors' strings."""

    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        empty = dealt(np.zeros(0, np.int64), TEXT, np.zeros(0, VARIANT))
        variants, crowded = together(wanted, VARIANTS, VARIANT), together(wanted, CROWDED, VARIANT)
        if not len(variants) + len(crowded):
            return as_table([empty])
        raw, offsets = string_buffer(docs["text"])
        ids = docs["doc_id"].to_numpy(zero_copy_only=False) if not docs["doc_id"].null_count else np.array([-1 if x is None else x for x in docs["doc_id"].to_pylist()])
        order = np.argsort(ids, kind="stable")
        out = [empty]
        if len(variants):
            base = offsets[order[np.searchsorted(ids[order], variants["doc"])]]
            at = (variants["h"] % U64(buckets)).astype(np.int64)
            by = np.argsort(at, kind="stable")
            variants, at, base = variants[by], at[by], base[by]
            size = (variants["stop"] - variants["start"]).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(size)])
            spelled = raw[np.repeat(base + variants["start"] - upto[:-1], size) + np.arange(upto[-1])]
            cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            ends = np.append(cut[1:], len(at))
            blobs = [(variants[a:b].tobytes(), spelled[upto[a] : upto[b]].tobytes()) for a, b in zip(cut, ends, strict=True)]
            out.append(pa.RecordBatch.from_arrays([pa.array(at[cut], pa.int64()), pa.array(np.full(len(cut), TEXT), pa.int32()), pa.array([x for x, _ in blobs], pa.binary()), pa.array([x for _, x in blobs], pa.binary())], names=["bucket", "kind", "blob", "bytes"]))
        if len(crowded):
            base = offsets[order[np.searchsorted(ids[order], crowded["doc"])]]
            up, down = powers(len(raw) + 1)
            sums = []
            for values in (BYTE_VALUES, OTHER_VALUES):
                total = np.zeros(len(raw) + 1, dtype=U64)
                np.cumsum(values[raw] * up[:-1], out=total[1:])
                sums.append(total)
            count = (crowded["stop"] - crowded["start"]).astype(np.int64) - length + 1
            count = np.minimum(count, crowded["lead"].astype(np.int64) + 1)  # strings that hold the anchor
            upto = np.concatenate([[0], np.cumsum(count)])
            shift = np.arange(upto[-1]) - np.repeat(upto[:-1], count)
            s = np.empty(len(shift), dtype=STRING)
            begin = np.repeat(base + crowded["start"], count) + shift
            s["h"], s["c"] = (mix((t[begin + length] - t[begin]) * down[begin]) for t in sums)
            s["doc"], s["start"] = np.repeat(crowded["doc"], count), np.repeat(crowded["start"], count) + shift
            s["stop"] = s["start"] + length
            fresh, again = settled(s, "h", "c")
            out.append(dealt((fresh["h"] % U64(buckets)).astype(np.int64), ENTRIES, fresh))
            again = merge(ranges_of(again))
            out.append(dealt(home(again["doc"], buckets), RANGES, again))
        return as_table(out)

    return run


def _match(length: int, homes: int):
    """Of a share's families and strings: the ranges that occurred before."""

    def run(table: pa.Table) -> pa.Table:
        _, again = settled(together(table, ENTRIES, STRING), "h", "c")
        found = [together(table, RANGES, RANGE), ranges_of(again)]
        v = together(table, TEXT, VARIANT)
        if len(v):
            data = np.frombuffer(b"".join(b.as_py() for k, b in zip(table["kind"].to_pylist(), table["bytes"], strict=True) if k == TEXT), dtype=np.uint8)
            size = (v["stop"] - v["start"]).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            by = np.lexsort((v["rank"], v["h"]))
            v, size, begin = v[by], size[by], begin[by]
            head = np.flatnonzero(np.concatenate([[True], v["h"][1:] != v["h"][:-1]]))
            upto = np.cumsum(size)
            first = 0
            while first < len(v):  # whole families, about SHARE_BYTES at a time
                k = np.searchsorted(upto, upto[first] - size[first] + SHARE_BYTES)
                k = int(head[np.searchsorted(head, k, side="right") - 1]) if k < len(v) else len(v)
                if k <= first:
                    nxt = np.searchsorted(head, first, side="right")
                    k = int(head[nxt]) if nxt < len(head) else len(v)
                part = slice(first, k)
                hit = earlier_windows(data, begin[part], size[part], v["h"][part], length)
                i, p = np.nonzero(hit)
                r = np.empty(len(i), dtype=RANGE)
                r["doc"], r["start"] = v["doc"][part][i], v["start"][part][i] + p
                r["stop"] = r["start"] + length
                found.append(merge(r))
                first = k
        found = merge(np.concatenate(found))
        return as_table([dealt(home(found["doc"], homes), RANGES, found)])

    return run


def _cut(with_text: bool):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        ranges = merge(together(known, RANGES, RANGE))
        raw, offsets = string_buffer(docs["text"])
        whole = raw.tobytes()
        ids = docs["doc_id"].to_pylist()
        span = {int(d): (a, b) for d, a, b in _spans(ranges["doc"])}
        starts, stops = ranges["start"].tolist(), ranges["stop"].tolist()
        rows = []
        for i, d in enumerate(ids):
            text = whole[offsets[i] : offsets[i + 1]]
            a, b = span.get(d, (0, 0))
            removed, kept, at = 0, [], 0
            for k in range(a, b):
                kept.append(text[at : starts[k]])
                at = stops[k]
                removed += stops[k] - starts[k]
            rest = b"".join(kept) + text[at:] if b > a else text
            rows.append((d, len(text), removed, b - a, hashlib.sha256(rest).hexdigest(), _characters(text, starts[a:b], stops[a:b]) if with_text else None))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        types = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names[: 5 + with_text], columns, types, strict=False)})

    return run


def _characters(text: bytes, starts: list[int], stops: list[int]) -> str:
    """What is left as text: a character goes only if all its bytes go."""
    kept, at = [], 0
    for a, b in zip(starts, stops, strict=True):
        while a < b and (text[a] & 0xC0) == 0x80:
            a += 1
        while b > a and b < len(text) and (text[b] & 0xC0) == 0x80:
            b -= 1
        kept.append(text[at:a])
        at = max(at, b)
    return (b"".join(kept) + text[at:]).decode("utf-8", errors="replace")


def _spans(sorted_docs: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(sorted_docs):
        cut = np.flatnonzero(np.concatenate([[True], sorted_docs[1:] != sorted_docs[:-1]]))
        yield from zip(sorted_docs[cut], cut.tolist(), [*cut[1:].tolist(), len(sorted_docs)], strict=True)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text)."""
    if length <= ANCHOR:
        raise ValueError(f"length must be over {ANCHOR}")
    spark = docs.sparkSession
    small_batches(spark)
    tidy(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A home holds about 8 MB of text, a bucket about as much of anchors; rows are one blob per pair of them.
    buckets = max(exchange_width(spark), size // (16 << 20))
    homes = max(exchange_width(spark), size // (8 << 20)) | 1
    anchors = docs.where("doc_id is not null").mapInArrow(_anchors(length, buckets), DEALT)
    families = materialize(anchors.groupBy("bucket").applyInArrow(_families(homes), DEALT), "suffix-families")
    at_home = docs.withColumn("home", home_column(homes))
    spelled = at_home.groupBy("home").cogroup(families.where(f"kind in ({VARIANTS}, {CROWDED})").groupBy("bucket")).applyInArrow(_spell(length, buckets), DEALT)
    matched = spelled.groupBy("bucket").applyInArrow(_match(length, homes), DEALT)
    known = matched.union(families.where(f"kind = {RANGES}"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return at_home.groupBy("home").cogroup(known.groupBy("bucket")).applyInArrow(_cut(with_text), schema)


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` (and ``n_chars`` counted anew, if there); rows of null doc_id as they are."""
    doc, text = free_name(docs, "_doc"), free_name(docs, "_text")
    kept = remove_repeats(docs, length, with_text=True).where("n_removed > 0 and doc_id is not null").select(F.col("doc_id").alias(doc), F.col("kept_text").alias(text)).dropDuplicates([doc])
    out = docs.join(kept, docs["doc_id"] == kept[doc], "left")
    changed = {"text": F.when(F.col(doc).isNotNull(), F.col(text)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(doc).isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(changed).select(*docs.columns)
