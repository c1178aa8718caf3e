"""N-gram Jaccard self-join by rare-first prefix filtering (operator 6).

Each text is the set of its distinct word n-grams. All sets are ordered alike, rare
n-grams first; two sets of Jaccard similarity t or more then share an n-gram within
their first ``n - ceil(t n) + 1``. So only these prefixes are dealt out, by n-gram:

1. one pass counts documents per n-gram in a sketch, with about a slot per n-gram up to
   2**``MOST_BITS`` slots (counts of slots add up, and a byte keeps a count's logarithm; it
   only orders, so its collisions cost no result), and fingerprints sets;
2. a second pass emits prefix entries, in blobs per bucket, of which there are more the
   more entries there are; an n-gram travels as so many first bits of its hash as tell
   entries apart (two that agree in them make one group, which costs time and no result);
   of equal sets that of the least document is dealt out, as a table of their fingerprints
   tells; where it would be too large, entries carry the fingerprint and meet by it;
3. a member of an n-gram's group that passes the length and positional filters with no
   other one leaves it; every other is paired with the least one only; an n-gram that
   ``HOT`` documents or more may have is spread over buckets, whose least ones are paired
   with the least of all; pairs that pass the length and positional filters are verified
   once each, by the suffix filter and then by the whole intersection;
4. where members of a group are still in different components, they are paired with the
   one that has the fewest rare n-grams of its own, which of near copies is the one that
   most link to; after that all pairs across components that pass the filters are verified.

Step 4 makes the components exact: two linked documents share a prefix n-gram, so either
they are already connected or they are one of its pairs. A group of thousands of near
copies costs a star and not its square.

Defined cases: null or empty text has the empty set and links with nothing; a text of
fewer than n words is one n-gram, its whole sequence; equal sets link; repeated rows
share a component; a row of null doc_id links with nothing and its component is null;
very long texts are read whole, one at a time; an empty table gives an empty result;
other columns are ignored. ``keep`` keeps every row of null doc_id, and one of equal rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .storage import exchange_width, free_name, materialize, small_batches
from .textops import SLICE, U64, Words, ints, lower_ascii, mix, slices, string_buffer, whole

LEAST_BITS, PIECE_BITS, MOST_BITS = 18, 18, 25  # of the sketch, and of a piece of it
STEPS = 8  # of a count's logarithm, per octave
PART_BITS = 8
BUCKET_ENTRIES = 400_000
SPARE_BITS = 8  # of an n-gram's hash, beyond those that number the entries
HOT = 50_000
FILTER_BITS = 1 << 28
ENTRY = np.dtype([("h", "<u8"), ("doc", "<i8"), ("fp", "<u8"), ("n", "<i4"), ("pos", "<i4")])


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Each row's distinct n-gram hashes, ascending."""
    words = Words(lower_ascii(raw), offsets)
    value, at = words.windows(size)
    cut = np.searchsorted(at, words.rows)
    out = [value[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    short = np.flatnonzero((words.per_row > 0) & (words.per_row < size))
    h = words.hashes() if len(short) else None
    for i in short:
        v = np.array([words.per_row[i]], dtype=U64)
        for w in h[words.rows[i] : words.rows[i + 1]]:
            v = mix(v * U64(0xD6E8FEB86659FD93) + w)
        out[i] = v
    return [np.unique(x) if len(x) > 1 else x for x in out]


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _counts(slot: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending slots, as differences, and their counts."""
    slots = ints(np.diff(slot.astype(U64), prepend=U64(0)))
    return len(slots).to_bytes(4, "little") + slots + ints(n)


def _read_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = 4 + int.from_bytes(blob[:4], "little")
    return np.cumsum(whole(blob[4:cut]), dtype=U64).astype(np.int64), whole(blob[cut:]).astype(np.int64)


def _measure(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, waiting = [], 0

        def counted() -> pa.RecordBatch:
            """Of the slots seen, how often, a blob per piece of the sketch."""
            slot, n = np.unique(np.concatenate(seen), return_counts=True)
            piece = slot >> U64(PIECE_BITS)
            cut, end = (np.searchsorted(piece, np.unique(piece), side=x) for x in ("left", "right"))
            slot &= U64((1 << PIECE_BITS) - 1)
            none = pa.nulls(len(cut), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(cut), pa.binary()), pa.array(piece[cut].astype(np.int64)), pa.array([_counts(slot[a:b], n[a:b]) for a, b in zip(cut, end, strict=True)], pa.binary())], names=["doc_id", "n", "fp", "piece", "counts"])

        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets(*string_buffer(batch.column(1)), size)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.binary())], names=["doc_id", "n", "fp", "piece", "counts"])
            seen.append(np.concatenate(sets) >> U64(64 - bits))
            waiting += len(seen[-1])
            if waiting > 1_500_000:
                yield counted()
                seen, waiting = [], 0
        if waiting:
            yield counted()

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (piece, counts), each piece's blobs added up."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            of = total.setdefault(piece, np.zeros(1 << PIECE_BITS, dtype=np.int64))
            slot, n = _read_counts(blob.as_py())
            of[slot] += n
    for piece, of in total.items():
        slot = np.flatnonzero(of)
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([_counts(slot, of[slot])], pa.binary())], names=["piece", "counts"])


def _logarithms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _add(batches):
        slot, n = _read_counts(batch.column(1)[0].as_py())
        out = np.zeros(1 << PIECE_BITS, dtype=np.uint8)
        out[slot] = np.minimum(255, np.round(STEPS * np.log2(1.0 + n)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([out.tobytes()], pa.binary())], names=["piece", "counts"])


def document_counts(measured: DataFrame, bits: int) -> np.ndarray:
    """The sketch, summed in two steps: 2**``bits`` bytes, 32 MB at most, reach the driver."""
    counts, shape = measured.where("counts is not null").select("piece", "counts"), "piece long, counts binary"
    pieces, grain = 1 << (bits - PIECE_BITS), F.pmod(F.xxhash64("counts"), F.lit(8))  # a task holds some pieces
    parts = counts.repartition(max(exchange_width(measured.sparkSession), pieces // 4), "piece", grain).mapInArrow(_add, shape)
    out = np.zeros(1 << bits, dtype=np.uint8)
    for r in parts.repartition(max(1, pieces // 8), "piece").mapInArrow(_logarithms, shape).collect():
        out[r.piece << PIECE_BITS : (r.piece + 1) << PIECE_BITS] = np.frombuffer(r.counts, np.uint8)
    return out


def _rarity(order: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The logarithms of the n-grams' document counts."""
    return order[h >> U64(65 - len(order).bit_length())]


def _slot_counts(order: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.exp2(_rarity(order, h) / STEPS).astype(np.int64)


def hash_bits(entries: int, bits: int) -> int:
    """How many first bits of an n-gram's hash its entries keep; those of its slot in the sketch at least."""
    return min(64, max(bits, entries.bit_length() + SPARE_BITS))


def _repeated(classes: DataFrame) -> tuple[np.ndarray, ...] | None:
    """The fingerprints that several sets have, in two columns, ascending, and the least document of each: 24 MB at most, or nothing."""
    if classes.count() > FILTER_BITS >> 8:
        return None
    found = classes.where("class_id is not null").select("fp", "class_id").toArrow()
    prints = np.frombuffer(b"".join(found["fp"].to_pylist()), "<u8").reshape(-1, 2)
    order = np.argsort(prints[:, 0])
    return prints[order, 0], prints[order, 1], found["class_id"].to_numpy()[order]


def _least_of(least: tuple[np.ndarray, ...], fp: bytes, doc: int) -> int:
    """The least document whose set has this fingerprint."""
    a, b = np.frombuffer(fp, "<u8")
    i = int(np.searchsorted(least[0], a))
    return int(least[2][i]) if i < len(least[0]) and least[0][i] == a and least[1][i] == b else doc


def _prefixes(size: int, percent: int, rarity, buckets: int, hot: int, bits: int, repeated):
    """``repeated``: what ``_repeated`` returns; without it, entries carry their fingerprint."""
    mask = U64((1 << 64) - (1 << (64 - bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows, seen = [], 0, set()
        order, least = rarity.value, repeated.value
        for batch in slices(batches, "text", SLICE):
            ids = batch.column(0).to_pylist()
            for doc, s in zip(ids, shingle_sets(*string_buffer(batch.column(1)), size), strict=True):
                n = len(s)
                if not n or doc is None:
                    continue
                fp = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if least is not None and _least_of(least, fp, doc) != doc or fp in seen:  # one entry stands for the class of equal sets
                    continue
                seen.add(fp)
                p = n - least_overlap(n, percent) + 1
                first = s[np.argsort(_rarity(order, s), kind="stable")[:p]]
                e = np.empty(p, dtype=ENTRY)
                e["h"], e["doc"], e["fp"], e["n"], e["pos"] = first & mask, doc, int.from_bytes(fp[:8], "little") if least is None else 0, n, np.arange(p)
                kept.append(e)
                rows += p
            if rows > 400_000:
                yield _dealt(kept, buckets, order, hot)
                kept, rows = [], 0
                if len(seen) > 200_000:
                    seen = set()
        if kept:
            yield _dealt(kept, buckets, order, hot)

    return run


def _dealt(kept: list[np.ndarray], buckets: int, order: np.ndarray, hot: int) -> pa.RecordBatch:
    e = np.concatenate(kept)
    grain = np.where(e["fp"] > 0, e["fp"], mix(e["doc"].view(U64))) % (1 + _slot_counts(order, e["h"]) // U64(hot))  # equal sets stay together
    at = (((e["h"] >> U64(32)) * U64(buckets) >> U64(32)) + grain * U64(0x9E3779B97F4A7C15)) % U64(buckets)  # ranges: hashes begin alike
    order = np.lexsort((e["doc"], at))
    e, at = e[order], at[order].astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ends = np.append(cut[1:], len(at))
    return pa.RecordBatch.from_arrays([pa.array(at[cut], pa.int64()), pa.array([_packed(e[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary())], names=["bucket", "entries"])


def _packed(e: np.ndarray) -> bytes:
    """Entries column by column, documents as differences."""
    columns = [ints(np.diff(e[c].astype(U64), prepend=U64(0)) if c == "doc" else e[c]) for c in ENTRY.names]
    return b"".join(len(x).to_bytes(4, "little") + x for x in columns)


def _unpacked(blob: bytes) -> np.ndarray:
    columns = []
    while blob:
        end = 4 + int.from_bytes(blob[:4], "little")
        columns.append(whole(blob[4:end]))
        blob = blob[end:]
    e = np.empty(len(columns[0]), dtype=ENTRY)
    for c, x in zip(ENTRY.names, columns, strict=True):
        e[c] = np.cumsum(x, dtype=U64).view(np.int64) if c == "doc" else x
    return e


def passes(n1, n2, pos1, pos2, percent: int):
    """Length and positional filter: may sets of these sizes, first meeting at these positions, still link?"""
    need = -(-percent * (n1 + n2) // (100 + percent))
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (1 + np.minimum(n1 - pos1, n2 - pos2) - 1 >= need)


def _passes(n1: Column, n2: Column, pos1: Column, pos2: Column, percent: int) -> Column:
    """``passes`` over columns."""
    need = F.ceil(percent * (n1 + n2) / (100 + percent))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (F.least(n1 - pos1, n2 - pos2) >= need)


def partnered(group: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Which members pass both filters with another one of their group? Groups ascend from 0.

    Two pass if neither set is larger than the other one's position lets it be. So of the sets
    that are small enough for a member, the one that takes the largest must take the member.
    """
    most = np.maximum((100 + percent) * (n - pos) // percent - n, 0)
    bits = int(max(n.max(initial=0), most.max(initial=0))).bit_length()
    order = np.argsort(group << bits | n, kind="stable")
    sizes, takes = (group << bits | n)[order], (group << bits | most)[order]
    first = np.maximum.accumulate(takes)  # so far, in the group: a later group's are larger
    second = np.maximum.accumulate(np.minimum(takes, np.concatenate([takes[:1] * 0, first[:-1]])))
    end = np.searchsorted(sizes, takes, side="right") - 1
    own = takes >= sizes  # a member that takes its own size is the first or second itself
    out = np.empty(len(n), dtype=bool)
    out[order] = (end >= 0) & (np.where(own, second[end], first[end]) >= sizes)
    return out


FOUND = "h long, doc long, n int, pos int, centre long, passes boolean, spread boolean"


def _groups(percent: int, rarity, hot: int):
    def run(table: pa.Table) -> pa.Table:
        e = np.concatenate([_unpacked(x.as_py()) for x in table["entries"]])
        e = e[np.lexsort((e["pos"], e["n"], e["doc"], e["fp"], e["h"]))]
        new = {c: e[c][1:] != e[c][:-1] for c in ENTRY.names}
        e = e[np.concatenate([[True], new["h"] | new["fp"] | (e["fp"][1:] == 0) & (new["doc"] | new["n"])])]  # equal sets: the least document
        e = e[np.lexsort((e["doc"], e["h"]))]
        spread = _slot_counts(rarity.value, e["h"]) >= hot
        group = np.cumsum(np.concatenate([[True], e["h"][1:] != e["h"][:-1]])) - 1
        many = partnered(group, e["n"].astype(np.int64), e["pos"].astype(np.int64), percent) | spread
        e, spread = e[many], spread[many]
        head = np.concatenate([[True], e["h"][1:] != e["h"][:-1]])[: len(e)]
        c = e[np.flatnonzero(head)[np.cumsum(head) - 1]]
        ok = passes(e["n"].astype(np.int64), c["n"].astype(np.int64), e["pos"], c["pos"], percent)
        return pa.table({"h": e["h"].copy().view(np.int64), "doc": e["doc"], "n": e["n"], "pos": e["pos"], "centre": c["doc"], "passes": ok, "spread": spread})

    return run


def _overlap_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """Suffix filter: split both sets at the middle of one, again and again; halves meet only halves."""
    if not len(x) or not len(y):
        return 0
    if not depth:
        return min(len(x), len(y))
    pivot = y[len(y) // 2]
    i, j = int(np.searchsorted(x, pivot)), len(y) // 2
    met = int(i < len(x) and x[i] == pivot)
    return _overlap_bound(x[:i], y[:j], depth - 1) + met + _overlap_bound(x[i + met :], y[j + 1 :], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    n1, n2 = len(x), len(y)
    if not n1 or not n2 or 100 * min(n1, n2) < percent * max(n1, n2):
        return False
    need = -(-percent * (n1 + n2) // (100 + percent))
    if _overlap_bound(x, y) < need:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (n1 + n2 - common)


def _may_link(percent: int):
    """Suffix filter without the suffixes: sets meet only part by part, so the smaller counts bound the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = (np.frombuffer(b"".join(unpack(x.as_py()) for x in batch.column(c)), "<u2").reshape(batch.num_rows, -1) for c in ("parts_u", "parts_v"))
            n = sum(batch.column(c).to_numpy() for c in ("n_u", "n_v"))
            full = ((u == 65535) | (v == 65535)).any(axis=1)
            ok = full | ((100 + percent) * np.minimum(u, v).sum(axis=1, dtype=np.int64) >= percent * n)
            yield batch.select([0, 1]).filter(pa.array(ok))

    return run


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # rows of one centre mostly come together
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "packed_u", SLICE // 4):
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets = lambda packed: shingle_sets(*string_buffer(pa.array([unpack(x.as_py()) for x in packed], pa.binary())), size)
            left = sets(batch.column(2))
            fresh = [i for i in range(len(v)) if (v[i - 1] if i else last) != v[i]]
            right = dict(zip(fresh, sets(batch.column(3).take(pa.array(fresh, pa.int64()))), strict=True))
            good = []
            for i in range(len(v)):
                held = right.get(i, held)
                good.append(linked(left[i], held, percent))
            last = v[-1]
            yield batch.select([0, 1]).filter(pa.array(good))

    return run


def _bits(width: int):
    """Of slots whose eighths of the width come together: each eighth as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        eighths: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column(0).to_numpy()
            for e in np.unique(slot // (width // 8)):
                bits = eighths.setdefault(int(e), np.zeros(width // 8, dtype=bool))
                bits[slot[slot // (width // 8) == e] % (width // 8)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(eighths), pa.int64()), pa.array([np.packbits(b).tobytes() for b in eighths.values()], pa.binary())], names=["eighth", "bits"])

    return run


def parted(s: np.ndarray) -> np.ndarray:
    """How many of a set's n-grams fall into each part of the hash space."""
    return np.bincount((s >> U64(64 - PART_BITS)).astype(np.int64), minlength=1 << PART_BITS)


def _filter(ids: DataFrame) -> tuple[int, np.ndarray | None]:
    """The slots of the documents in ``ids`` as bits, at most 32 MB, and how many slots there are; no bits where they are too many for it."""
    width = max(1 << 16, 1 << (16 * ids.count()).bit_length())
    if width > FILTER_BITS:
        return width, None
    bits = np.zeros(width // 8, dtype=np.uint8)
    for r in ids.select(_slot("doc", width)).repartition(8, F.floor(F.col("slot") / (width // 8))).mapInArrow(_bits(width), "eighth long, bits binary").collect():
        bits[r.eighth * (width // 64) : (r.eighth + 1) * (width // 64)] = np.frombuffer(r.bits, dtype=np.uint8)
    return width, bits


def _slot(key: str, width: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(width)).alias("slot")


def _set_bits(batch: pa.RecordBatch, bits: np.ndarray | None) -> pa.RecordBatch:
    """The rows (id, value, slot) whose slot's bit is set."""
    if bits is None:
        return batch
    slot = batch.column(2).to_numpy()
    return batch.filter(pa.array((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1))


def texts_of(spark: SparkSession, docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, parts, packed) of the documents in ``ids``, and some more: a filter of at most 32 MB
    finds them without a shuffle of texts, and a join where they are too many for it. ``parts`` counts
    the set's n-grams by part of the hash space, ``packed`` is the compressed text."""
    docs = docs.where("doc_id is not null")
    width, bits = _filter(ids)
    if bits is None:
        docs = docs.join(ids.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
    shared = spark.sparkContext.broadcast(bits)
    docs = docs.select("doc_id", "text", _slot("doc_id", width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "text", SLICE):
            batch = _set_bits(batch, shared.value)
            if not batch.num_rows:
                continue
            raw, offsets = string_buffer(batch.column(1))
            whole, sets = raw.tobytes(), shingle_sets(raw, offsets, size)
            parts = [pack(np.minimum(parted(s), 65535).astype("<u2").tobytes()) for s in sets]
            packed = [pack(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(parts, pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "n", "parts", "packed"])

    return materialize(docs.mapInArrow(run, "doc_id long, n long, parts binary, packed binary"), "jaccard-texts")


def packed_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, packed) of the documents in ``ids``, and some more, before a shuffle: texts that no pair asks for don't travel."""
    width, bits = _filter(ids)
    if bits is None:
        return texts.select("doc_id", "packed")
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _set_bits(batch, shared.value).select([0, 1])

    return materialize(texts.select("doc_id", "packed", _slot("doc_id", width)).mapInArrow(run, "doc_id long, packed binary"), "jaccard-packed")


def link(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    letters = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (letters // 6).bit_length()))  # about a slot for each word
    measured = materialize(docs.mapInArrow(_measure(size, bits), "doc_id long, n long, fp binary, piece long, counts binary"), "jaccard-sets")
    own = measured.where("fp is not null")
    classes = own.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    classes = materialize(classes.where("copies > 1"), "jaccard-classes")
    rarity = spark.sparkContext.broadcast(document_counts(measured, bits)) if measured.where("counts is not null").take(1) else None
    if rarity is None:
        return own.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    entries = own.agg(F.sum(F.floor(F.col("n") * (100 - percent) / 100) + 1)).first()[0]
    buckets = max(4 * exchange_width(spark), -(-entries // BUCKET_ENTRIES))
    repeated = spark.sparkContext.broadcast(_repeated(classes))
    dealt = docs.mapInArrow(_prefixes(size, percent, rarity, buckets, HOT, hash_bits(entries, bits), repeated), "bucket long, entries binary").repartition(-(-buckets // 4), "bucket")
    found = materialize(dealt.groupBy("bucket").applyInArrow(_groups(percent, rarity, HOT), FOUND), "jaccard-groups")

    # The least ones of a hot n-gram's buckets and the least of all.
    local = found.where("spread and doc = centre").select("h", "doc", "n", "pos")
    least = local.groupBy("h").agg(F.min(F.struct("doc", "n", "pos")).alias("c"))
    hot = local.join(least, "h").where("doc != c.doc").select("h", F.col("doc").alias("u"), F.col("c.doc").alias("v"), _passes(F.col("n"), F.col("c.n"), F.col("pos"), F.col("c.pos"), percent).alias("passes"))
    met = found.where("doc != centre").select("h", F.col("doc").alias("u"), F.col("centre").alias("v"), "passes").union(hot)
    stars = materialize(met.groupBy("u", "v").agg(F.max("passes").alias("passes")), "jaccard-stars")
    texts = texts_of(spark, docs, found.select("doc").distinct(), size)
    first = materialize(verify(stars.where("passes").select("u", "v"), texts, size, percent), "jaccard-links")
    joined = components(first)

    # Members of a group in different components meet a second one first: the member that shares the rarest of its
    # n-grams, which has the least of its own and links to most. Then their pairs across components that are left.
    place = lambda df, key, out: df.join(joined.select(F.col("u").alias(key), F.col("v").alias("_to")), key, "left").withColumn(out, F.coalesce("_to", key)).drop("_to")
    apart = materialize(place(place(stars.select("u", "v"), "u", "cu"), "v", "cv").where("cu != cv").select("u", "v"), "jaccard-apart")
    if apart.take(1):
        open_groups = met.join(apart, ["u", "v"], "left_semi").select("h").distinct()  # those of several components
        own_ones = found.groupBy("doc").agg(F.min("pos").alias("alone"))
        member = found.join(open_groups, "h", "left_semi").select("h", "doc", "n", "pos").join(own_ones, "doc")
        member = materialize(place(member, "doc", "c"), "jaccard-members")
        best = member.groupBy("h").agg(F.min(F.struct("alone", "doc", "n", "pos", "c")).alias("b"))
        second = member.join(best, "h").where((F.col("c") != F.col("b.c")) & _passes(F.col("n"), F.col("b.n"), F.col("pos"), F.col("b.pos"), percent))
        second = second.select(F.greatest("doc", "b.doc").alias("u"), F.least("doc", "b.doc").alias("v")).distinct()
        tried = stars.where("passes").select("u", "v")
        second = materialize(second.join(tried, ["u", "v"], "left_anti"), "jaccard-pairs")
        links = first.union(materialize(verify(second, texts, size, percent), "jaccard-links"))
        joined = components(links)
        member = _mixed(materialize(place(member.drop("c"), "doc", "c"), "jaccard-members"))  # read twice
        other = member.select("h", *[F.col(x).alias(f"{x}2") for x in ("doc", "n", "pos", "c")])
        pairs = (
            member.join(other, "h").where("c < c2")
            .where(_passes(F.col("n"), F.col("n2"), F.col("pos"), F.col("pos2"), percent))
            .select(F.greatest("doc", "doc2").alias("u"), F.least("doc", "doc2").alias("v")).distinct()
        )
        pairs = pairs.join(tried.union(second), ["u", "v"], "left_anti")  # each pair once
        third = materialize(verify(pairs, texts, size, percent), "jaccard-links")
        if third.take(1):
            joined = components(links.union(third))
    # A class of equal sets went by one of its documents; its name, and its component's, is the least of all.
    # Copies of one text share a key: it is salted, with a class row for each grain of salt.
    salted = classes.select("fp", "class_id", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("salt"))
    named = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int")).join(salted, ["fp", "salt"], "left")
    named = materialize(named.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("class_id", "doc_id")).alias("class_id")), "jaccard-named")
    nodes = joined.union(joined.select(F.col("v").alias("u"), "v").distinct())
    nodes = materialize(nodes.join(named.select(F.col("doc_id").alias("u"), "class_id").distinct(), "u").select("class_id", "v"), "jaccard-nodes")
    least = nodes.groupBy("v").agg(F.min("class_id").alias("_to"))
    placed = named.join(nodes.join(least, "v").select("class_id", "_to"), "class_id", "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("_to", "class_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _mixed(member: DataFrame) -> DataFrame:
    """The members of n-grams whose members are in different components ``c``."""
    mixed = member.groupBy("h").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a != b").select("h")
    return materialize(member.join(mixed, "h", "left_semi"), "jaccard-members")


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) that link. Texts travel only for pairs whose part counts let them."""
    t = lambda k, *more: texts.select(F.col("doc_id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in more])
    counts = pairs.join(t("u", "n", "parts"), "u").join(t("v", "n", "parts"), "v").select("u", "v", "n_u", "n_v", "parts_u", "parts_v")
    pairs = materialize(counts.mapInArrow(_may_link(percent), "u long, v long"), "jaccard-candidates")
    packed = packed_of(texts, pairs.select(F.explode(F.array("u", "v")).alias("doc")).distinct())
    p = lambda k: packed.select(F.col("doc_id").alias(k), F.col("packed").alias(f"packed_{k}"))
    both = pairs.join(p("u"), "u").join(p("v"), "v").select("u", "v", "packed_u", "packed_v")
    return both.mapInArrow(_verify(size, percent), "u long, v long").distinct()


def keep(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """One document of each component, the one of least id, with all columns; of rows that repeat its id, the
    one whose text has the least hash. Rows of null doc_id all stay."""
    kept, place = free_name(docs, "_kept"), free_name(docs, "_place")
    firsts = link(docs, size, percent).where("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    named = docs.where("doc_id is not null")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    single = named.join(firsts, named["doc_id"].cast("long") == firsts[kept], "left_semi").withColumn(place, first).where(F.col(place) == 1).drop(place)
    return single.unionByName(docs.where("doc_id is null"))
