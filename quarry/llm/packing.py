"""Lexical retrieval packing (operator 10).

Documents become token ids, and sequences of ``WINDOW`` tokens are filled with lexically
close documents. Each task streams its rows through pools of bounded size. A pool has its
own BM25 inverted index (a shard): the seed is the first unused document, the index returns
its unused neighbours by the score of all its terms, and they fill the window greedily; the
document that overflows it is cut, and its rest seeds the next window. What is left when a
pool runs low waits for the next pool, and the rest of a task, under one window, is laid
out in sequences whose lengths are powers of two, which need no padding. So only whole
windows and powers of two occur, and no token of padding.

No row moves between tasks, so no key can be hot; memory is bounded by the pool (and by
the longest single document). Ids of sequences are unique: task, then running number.

Defined cases: null text counts as empty and yields its end token alone; a row of null
doc_id is packed like others, its pieces named null; a very long text is cut over as many
windows as it needs; repeated rows are packed each by itself; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .textops import kept, slices

WINDOW = 4096
END_ID = 2
POOL_TOKENS = 3_000_000
FIRST = 128  # neighbours that are put in order at first, the others when these are used
COMMON = 32  # a term is common if over one in so many documents has it
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_END = " end "  # no word has a space
_MARK = "\x02"
_SPECIAL = "<|"  # special tokens begin so, and are seen before letters get lower case
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # how the tokenizer cuts pieces
_LETTERS, _NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"  # of Latin-1, in lower case
_PIECES = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\n{_LETTERS}{_NUMBERS}]+")  # the same for such words in lines
_PLAIN = re.compile(r"[!-@\[-~\u00a1-\u00bf\u00d7\u00df-\u00ff]{0,100}")  # printable Latin-1 without upper case


def _byte_names() -> dict[int, str]:
    """Characters that byte-level vocabularies write for bytes: printable ones as they are, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)} | {b: chr(b) for b in shown}


_BYTES = _byte_names()


class Merges:
    """Byte-pair merges of many pieces at once: each round joins, in every piece, the first pair of the lowest rank.

    A block is a matrix with a column per piece and a row per byte between two empty rows. A
    joined symbol stands where its first byte was; ranks of pairs are in a table by hash.
    """

    BLOCK, BITS = 4096, 18
    GONE, NONE = np.uint32(0xFFFF), 1 << 22  # no symbol, no rank

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.symbol = np.array([[vocab[_BYTES[b] + x] for b in range(256)] for x in ("", end)], dtype=np.uint32)
        self.joined = np.array([vocab[a + b] for a, b in pairs], dtype=np.uint32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.uint32)
        held, size = {}, 1 << self.BITS
        for rank, slot in enumerate(self._slots(keys).tolist()):
            while slot in held:
                slot = (slot + 1) % size
            held[slot] = rank
        self.keys, self.ranks = np.full(size, 0xFFFFFFFF, dtype=np.uint32), np.full(size, self.NONE, dtype=np.int32)
        slots, ranks = np.array(list(held)), np.array(list(held.values()))
        self.keys[slots], self.ranks[slots] = keys[ranks], ranks
        left = np.repeat(self.symbol[0], 256)
        self.bytes = np.concatenate([self.rank(left, np.tile(x, 256)) for x in self.symbol])  # of pairs of bytes, then of those that end a piece

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> np.uint32(32 - self.BITS)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, ``NONE`` where they don't join."""
        key = left << np.uint32(16) | right
        slot = self._slots(key)
        held, out = self.keys[slot], self.ranks[slot]
        other = held != key
        out[other] = self.NONE
        rest = np.flatnonzero(other & (held != 0xFFFFFFFF))
        while len(rest):
            slot[rest] = (slot[rest] + np.uint32(1)) & np.uint32((1 << self.BITS) - 1)
            held = self.keys[slot[rest]]
            same = held == key[rest]
            out[rest[same]] = self.ranks[slot[rest[same]]]
            rest = rest[~same & (held != 0xFFFFFFFF)]
        return out

    def _block(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(starts), int(sizes.max())
        row = np.arange(width, dtype=np.int32)[:, None]
        byte = raw.take(starts + row, mode="clip")
        ends = (row == sizes - 1).astype(np.int32)
        sym = np.full((width + 2, n), self.GONE, dtype=np.uint32)
        sym[1:-1] = np.where(row < sizes, self.symbol[ends, byte], self.GONE)
        value = np.full((width + 2, n), self.NONE << 8, dtype=np.int32)  # rank and row of the pair that begins here
        value += np.arange(width + 2, dtype=np.int32)[:, None]
        ranks = self.bytes[(ends[1:] << 16) + (byte[:-1].astype(np.int32) << 8) + byte[1:]]
        value[1:-2] = np.where(row[1:] < sizes, ranks << 8, self.NONE << 8) + row[1:]
        place = np.arange((width + 2) * n, dtype=np.int32)
        after, before = place + np.int32(n), place - np.int32(n)
        flat, least = sym.reshape(-1), value.reshape(-1)
        while True:
            best = value.min(axis=0)
            column = np.flatnonzero(best < self.NONE << 8)
            if not len(column):
                break
            best = best[column]
            a = (best & 255) * n + column
            made, b, left = self.joined[best >> 8], after[a], before[a]
            right = after[b]
            flat[a], flat[b] = made, self.GONE
            after[a], before[right] = right, a
            ranks = self.rank(np.concatenate([flat[left], made]), np.concatenate([made, flat[right]])) << 8
            least[b] |= self.NONE << 8
            least[left] = ranks[: len(a)] + (least[left] & 255)
            least[a] = ranks[len(a) :] + (best & 255)
        sym = sym[1:-1].T
        there = sym != self.GONE
        return sym[there], there.sum(axis=1)

    def encode(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has. A piece has 1 to 254 bytes."""
        order = np.argsort(sizes, kind="stable")
        cuts = [order[i : i + self.BLOCK] for i in range(0, len(order), self.BLOCK)]
        found = [self._block(raw, starts[x], sizes[x].astype(np.int32)) for x in cuts]
        ids = np.concatenate([np.zeros(0, dtype=np.uint32), *[x for x, _ in found]])
        some = np.concatenate([np.zeros(0, dtype=np.int64), *[x for _, x in found]])
        many, first = np.empty_like(some), np.empty_like(some)
        many[order], first[order] = some, np.cumsum(some) - some
        at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(ids))
        return ids[at], many


class WordEncoder:
    """Token ids of texts, by the public tokenizer, with each distinct word encoded once.

    The tokenizer never joins across white space, so a text's ids are those of its pieces
    between spaces and line feeds, one after the other. It lower-cases, so texts of Latin-1
    characters, whose lower case depends on no neighbour, are lower-cased before the split
    (but for texts where a special token may stand, which only counts as it is written).
    The table of words outlives a task: a Python worker keeps it until it grows too large.
    """

    MOST, MOST_CHARS = 1_000_000, 16 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._ids(_MARK)
        with open(path) as f:
            parts = json.load(f)
        self.merges = Merges(parts["model"]) if self._known(parts) else None
        self._reset()

    @staticmethod
    def _known(parts: dict) -> bool:
        """Whether the tokenizer is one whose pieces ``_learn`` can cut and ``Merges`` can encode."""
        model, steps = parts["model"], [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        cutter = [(x["type"], x.get("pattern"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
        return (
            model["type"] == "BPE"
            and bool(end := model.get("end_of_word_suffix"))
            and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "ignore_merges"))
            and steps == ["NFC", "Replace", "Lowercase"]
            and cutter == [("Split", {"Regex": _CUT}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
            and all(x["content"].startswith(_SPECIAL) for x in parts["added_tokens"])
            and all(x in model["vocab"] for b in _BYTES.values() for x in (b, b + end))
            and max(model["vocab"].values()) < Merges.GONE
        )

    def _reset(self) -> None:
        self.codes, self.stored = _Codes(), 0
        self.ids, self.first, self.size = array("i", [END_ID]), array("i", [0]), array("i", [1])
        self.codes[_END] = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)

    def _learn(self, words: list[str]) -> None:
        """Encode new words: those that are cut into pieces here by the merges, others in one text with marks between."""
        plain, rest = [], []
        for i, w in enumerate(words):
            (plain if self.merges is not None and _PLAIN.fullmatch(w) and _SPECIAL not in w else rest).append(i)
        first, size = np.zeros(len(words), dtype=np.int32), np.zeros(len(words), dtype=np.int32)

        def store(which: list[int], found: np.ndarray, ends: np.ndarray) -> None:
            starts = np.concatenate([[0], ends[:-1]])
            first[which], size[which] = starts + len(self.ids), ends - starts
            self.ids.frombytes(found.astype(np.int32).tobytes())

        if plain:
            pieces = _PIECES.findall("\n".join([words[i] for i in plain]) + "\n")
            raw = np.frombuffer((" ".join(pieces) + " ").encode(), dtype=np.uint8)
            stops = np.flatnonzero(raw == 32)
            starts = np.concatenate([[0], stops[:-1] + 1])
            line, many = raw[starts] == 10, np.zeros(len(starts), dtype=np.int64)
            found, many[~line] = self.merges.encode(raw, starts[~line], (stops - starts)[~line])
            store(plain, found, np.cumsum(many)[line])
        if rest:
            if any(_MARK in words[i] for i in rest) or len(self.mark) != 1:
                parts = [self._ids(words[i]) for i in rest]
                store(rest, np.concatenate(parts), np.cumsum([len(x) for x in parts]))
            else:
                found = self._ids(f" {_MARK} ".join(words[i] for i in rest))
                cut = np.flatnonzero(found == self.mark[0])
                found = np.delete(found, cut)
                store(rest, found, np.append(cut - np.arange(len(cut)), len(found)))
        self.first.frombytes(first.tobytes())
        self.size.frombytes(size.tobytes())
        self.stored += sum(map(len, words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's closed by ``END_ID``, and the texts' offsets in them."""
        if len(self.codes) > self.MOST or self.stored > self.MOST_CHARS:
            self._reset()
        words: list[str] = []
        upto = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                if _SPECIAL not in t and _is_latin(t):
                    t = t.lower()
                words += t.replace("\n", " ").split(" ")
            words.append(_END)
            upto[i + 1] = len(words)
        code = np.fromiter(map(self.codes.__getitem__, words), dtype=np.int32, count=len(words))
        if fresh := self.codes.fresh:
            for at in range(0, len(fresh), 20_000):
                self._learn(fresh[at : at + 20_000])
            self.codes.fresh = []
        table, first, length = (np.frombuffer(x, dtype=np.int32) for x in (self.ids, self.first, self.size))
        first, length = first[code], length[code]
        total = np.zeros(len(code) + 1, dtype=np.int32)
        np.cumsum(length, out=total[1:])
        first -= total[:-1]
        at = np.repeat(first, length)
        at += np.arange(len(at), dtype=np.int32)
        return table[at].view(np.uint32), total[upto].astype(np.int64)


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Codes(dict):
    """Numbers words in order of appearance and remembers the new ones."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        code = self[word] = len(self)
        return code


class Shard:
    """A BM25 index over the token ids of a pool's documents: postings of rare terms, a matrix of common ones."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray):
        n = self.n = len(offsets) - 1
        sizes = np.diff(offsets)
        kind = np.uint32 if n <= 1 << 16 else np.uint64
        key, tf = np.unique((np.repeat(np.arange(n, dtype=kind), sizes) << kind(16)) | ids.astype(kind), return_counts=True)
        doc, term = (key >> kind(16)).astype(np.int32), (key & kind(0xFFFF)).astype(np.uint16)
        df = np.bincount(term, minlength=1 << 16)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean() if n else 1.0))
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        self.rows, self.term = np.searchsorted(doc, np.arange(n + 1)), term
        common = COMMON * df > n  # of such terms there are at most COMMON times a document's terms
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        at = common[term]
        self.dense, self.free = np.zeros((int(common.sum()), n), dtype=np.float32), np.arange(n)
        self.dense[self.column[term[at]], doc[at]] = weight[at]
        rare = ~at & (df[term] > 1)  # a term of one document leads nowhere
        doc, term, weight = doc[rare], term[rare], weight[rare]
        order = np.argsort(term, kind="stable")
        self.doc, self.by_term = doc[order], weight[order]
        self.terms = np.searchsorted(term[order], np.arange((1 << 16) + 1))

    def neighbours(self, seed: int, used: np.ndarray, first: int | None = None) -> np.ndarray:
        """Unused documents that share a term with the seed, by the score of all its terms, best first; ties to the earlier.

        With ``first``, only so many of them, and those that tie with the last.
        """
        terms = self.term[self.rows[seed] : self.rows[seed + 1]]
        column = self.column[terms]
        stay = ~used[self.free]
        if 4 * np.count_nonzero(stay) < 3 * len(stay):  # used documents leave the matrix
            self.dense, self.free = np.compress(stay, self.dense, axis=1), self.free[stay]
        met = np.zeros(len(self.free), dtype=np.float32)
        for row in column[column >= 0].tolist():
            met += self.dense[row]
        score = np.zeros(self.n, dtype=np.float32)
        score[self.free] = met
        rare = terms[column < 0].astype(np.int64)
        lists = [(a, b) for a, b in zip(self.terms[rare], self.terms[rare + 1], strict=True) if a < b]
        for a, b in lists:
            score[self.doc[a:b]] += self.by_term[a:b]
        found = np.flatnonzero((score > 0) & ~used)
        if first is not None and first < len(found):
            best = score[found]
            found = found[best >= np.partition(best, len(best) - first)[len(best) - first]]
        return found[np.argsort(-score[found], kind="stable")]


class Packer:
    """Fills windows from a growing pool of documents and emits pieces."""

    def __init__(self, first_sequence: int):
        self.sequence = first_sequence
        self.open: list[tuple] = []  # documents not yet placed: (doc_id, ids, start of the part that is left)
        self.out: list[list] = [[] for _ in range(7)]

    def _piece(self, doc, start: int, length: int, offset: int) -> None:
        doc_id, ids, _ = doc
        crc = zlib.crc32(ids[start : start + length].astype("<u4", copy=False).tobytes())
        for column, value in zip(self.out, (doc_id, start, length, crc, len(ids), self.sequence, offset), strict=True):
            column.append(value)

    def add(self, doc_ids: list, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.open += [(d, ids[offsets[i] : offsets[i + 1]], 0) for i, d in enumerate(doc_ids)]

    def pack(self) -> None:
        """Fill windows until less than one is left; that rest stays open."""
        docs = self.open
        left = sum(len(x[1]) - x[2] for x in docs)
        if left < WINDOW:
            return
        offsets = np.concatenate([[0], np.cumsum([len(x[1]) - x[2] for x in docs])])
        shard = Shard(np.concatenate([x[1][x[2] :] for x in docs]), offsets)
        used, start = np.zeros(len(docs), dtype=bool), [x[2] for x in docs]
        seed = turn = 0
        while left >= WINDOW:
            filled, queue, k, some = 0, None, 0, True
            now = seed
            while filled < WINDOW:
                doc = docs[now]
                used[now] = True
                length = min(len(doc[1]) - start[now], WINDOW - filled)
                self._piece(doc, start[now], length, filled)
                start[now] += length
                filled += length
                if start[now] < len(doc[1]):
                    break  # the window is full; what is left of this document seeds the next
                if queue is None and filled < WINDOW:
                    queue = shard.neighbours(seed, used, FIRST)
                while queue is not None and k < len(queue) and used[queue[k]]:
                    k += 1
                if queue is not None and k == len(queue) and some:
                    queue, k, some = shard.neighbours(seed, used), 0, False  # all the others
                if queue is not None and k < len(queue):
                    now = queue[k]
                else:
                    while turn < len(docs) and used[turn]:
                        turn += 1
                    if turn == len(docs):
                        now = -1
                        break
                    now = turn
            self.sequence += 1
            left -= filled
            if now >= 0 and start[now] < len(docs[now][1]):
                seed = now
            elif now < 0 or used[now]:
                while turn < len(docs) and used[turn]:
                    turn += 1
                seed = turn
            else:
                seed = now
        self.open = [(d[0], d[1], s) for d, s in zip(docs, start, strict=True) if s < len(d[1])]

    def close(self) -> None:
        """Lay the rest, under one window, out in sequences of 2048, 1024, ... tokens."""
        left = sum(len(x[1]) - x[2] for x in self.open)
        room, filled = 0, 0
        for doc in self.open:
            at = doc[2]
            while at < len(doc[1]):
                if not room:
                    room, filled = 1 << (left.bit_length() - 1), 0
                length = min(room, len(doc[1]) - at)
                self._piece(doc, at, length, filled)
                at, filled, room, left = at + length, filled + length, room - length, left - length
                if not room:
                    self.sequence += 1
        self.open = []

    def batch(self) -> pa.RecordBatch:
        columns, self.out = self.out, [[] for _ in range(7)]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of all documents: see ``SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"packing {tokenizer_path}"
        encoder = kept(name, lambda: WordEncoder(tokenizer_path))
        packer = Packer(TaskContext.get().partitionId() << 40)
        tokens = rows = 0
        for batch in slices(batches, "text", keep=name):
            ids, offsets = encoder.encode(batch.column(1).to_pylist())
            packer.add(batch.column(0).to_pylist(), ids, offsets)
            tokens, rows = tokens + len(ids), rows + batch.num_rows
            if tokens >= POOL_TOKENS or rows >= 50_000:
                packer.pack()
                yield packer.batch()
                tokens, rows = 0, len(packer.open)
        packer.pack()
        packer.close()
        yield packer.batch()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
