"""SentencePiece encoding and decoding over shared prefixes (operator 1).

A text is cut at its marked word starts, where no piece of the vocabulary reaches across.
The distinct words of a batch are sorted, which lays them out as a trie, and walked depth
first: the forward table of a prefix, one column per character, is kept while words
share it, and only new characters are worked out. Each prefix of a word has one best
segmentation, so a column holds its last piece and its score.

For a unigram model a column keeps the last piece of the highest total score (Viterbi).
The public model is a merge model (BPE), for which totals of scores don't give the
model's segmentation; there the column keeps the one last piece that agrees with the
prefix before it: two neighbouring pieces agree if merging their joined text gives just
these two. Exactly one does, and the walk over prefixes is the same.

Characters that the vocabulary lacks become their UTF-8 bytes' pieces. Decoding joins
pieces, turns marks into spaces and drops the one in front.

Defined cases: null text counts as empty and has no ids; very long texts and words are
walked like others, one text at a time at least; a row of null doc_id is encoded like
others; repeated rows are encoded each by itself; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import kept, slices

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and the kind of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            trainer = next((v for k, v in _fields(f.read()) if k == 2), b"")
        kind = next((v for k, v in _fields(trainer) if k == 3), UNIGRAM)
        count = own.vocab_size()
        pieces = [own.id_to_piece(i) for i in range(count)]
        normal = [i for i in range(count) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))]
        self._set({pieces[i]: i for i in normal}, {i: own.get_score(i) for i in normal}, kind, own.unk_id())
        self.bytes = [own.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        raw = [p.replace(MARK, " ").encode() for p in pieces]
        for i in range(count):
            if own.is_control(i):
                raw[i] = b""
            elif own.is_byte(i):
                raw[i] = bytes([int(pieces[i][3:5], 16)])
        self._texts(raw)

    def _set(self, ids: dict[str, int], scores: dict[int, float], kind: int, unknown: int) -> None:
        self.ids, self.scores, self.kind, self.unknown = ids, scores, kind, unknown
        self.longest = max(map(len, ids), default=1)
        self.worst = min(scores.values(), default=0.0) - 10.0
        self._agree: dict[tuple[str, str], bool] = {}

    def _texts(self, raw: list[bytes]) -> None:
        self.sizes = np.array([len(r) for r in raw], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def merged(self, text: str) -> list[str]:
        """A merge model's segmentation from its definition: the best-scored neighbours join, the left ones first."""
        part = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        agenda: list[tuple[float, int, str]] = []

        def propose(i: int) -> None:
            if i >= 0 and after[i] < len(part):
                both = part[i] + part[after[i]]
                if both in self.ids:
                    heapq.heappush(agenda, (-self.scores[self.ids[both]], i, both))

        for i in range(len(part)):
            propose(i)
        while agenda:
            _, i, both = heapq.heappop(agenda)
            j = after[i] if part[i] else len(part)
            if j >= len(part) or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, ""
            after[i] = after[j]
            if after[i] < len(part):
                before[after[i]] = i
            propose(before[i])
            propose(i)
        return [p for p in part if p]

    def agrees(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self._agree.get(key)
        if known is None:
            if len(self._agree) > 2_000_000:
                self._agree.clear()
            known = self._agree[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def segments(self, words: list[str]) -> Iterator[list[str]]:
        """Pieces of each of the sorted distinct words."""
        column = [("", 0.0)]  # last piece and score of each prefix of the word before
        last = ""
        ids, scores, agrees, longest = self.ids, self.scores, self.agrees, self.longest
        for word in words:
            if self.kind == BPE and word[1:2] == MARK:  # runs of marks score alike: only the definition tells
                yield self.merged(word)
                continue
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del column[shared + 1 :]
            last = word
            for end in range(shared + 1, len(word) + 1):
                if self.kind == BPE:
                    for start in range(max(0, end - longest), end):
                        piece = word[start:end]
                        if (piece in ids or start == end - 1) and agrees(column[start][0], piece):
                            break
                    column.append((piece, column[start][1] + scores.get(ids.get(piece, -1), self.worst)))
                else:
                    best = None
                    for start in range(max(0, end - longest), end):
                        piece = word[start:end]
                        if piece in ids or start == end - 1:
                            total = column[start][1] + scores.get(ids.get(piece, -1), self.worst)
                            if best is None or total > best[1]:
                                best = (piece, total)
                    column.append(best)
            out, at = [], len(word)
            while at:
                piece = column[at][0]
                out.append(piece)
                at -= len(piece)
            yield out[::-1]

    def numbers(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes[0] != self.unknown:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out


class Encoder:
    """Encodes batches of texts; words are remembered across the batches of a worker."""

    MOST, MOST_CHARS = 1_000_000, 24 << 20

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    @classmethod
    def of(cls, path: str) -> Encoder:
        return kept(f"pieces {path}", lambda: cls(Model(path)))

    def _reset(self) -> None:
        self.codes, self.stored, self.ids, self.ends = _Codes(), 0, array("i"), array("i", [0])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the texts' offsets in them."""
        if len(self.codes) > self.MOST or self.stored > self.MOST_CHARS:
            self._reset()
        words: list[str] = []
        upto = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                words += _cut(t)
            upto[i + 1] = len(words)
        code = np.fromiter(map(self.codes.__getitem__, words), dtype=np.int32, count=len(words))
        if fresh := self.codes.fresh:
            order = sorted(range(len(fresh)), key=fresh.__getitem__)
            found: list = [None] * len(fresh)
            for k, pieces in zip(order, self.model.segments([fresh[k] for k in order]), strict=True):
                found[k] = self.model.numbers(pieces)
            for x in found:
                self.ids.extend(x)
                self.ends.append(len(self.ids))
            self.stored += sum(map(len, fresh))
            self.codes.fresh = []
        table, ends = np.array(self.ids, dtype=np.int32), np.array(self.ends, dtype=np.int32)
        first = ends[code]
        length = ends[code + 1] - first
        total = np.zeros(len(code) + 1, dtype=np.int64)
        np.cumsum(length, out=total[1:])
        at = np.repeat(first - total[:-1], length)
        at += np.arange(len(at))
        return table[at], total[upto]


class _Codes(dict):
    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        code = self[word] = len(self)
        return code


def _cut(text: str) -> list[str]:
    """Marked words, line feeds and what follows them: no piece reaches across these."""
    if "  " in text or text[0] == " " or MARK in text:
        return CHUNK.findall(MARK + text.replace(" ", MARK))
    return [w for w in (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ") if w]


def decode(model: Model, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of ids; bytes that are no UTF-8 become replacement characters."""
    size = model.sizes[ids]
    upto = np.concatenate([[0], np.cumsum(size)])
    raw = model.data[np.repeat(model.begins[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
    out = []
    for a, b in zip(upto[offsets[:-1]], upto[offsets[1:]], strict=True):
        out.append(raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") if b > a else "")
    return out


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model_path)
        for batch in slices(batches, "text", keep=f"pieces {model_path}"):
            ids, offsets = encoder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of every row of ids; null ids give empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Encoder.of(model_path).model
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, lists)])
            ids = np.array([i for x in lists for i in x], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decode(model, ids, offsets), pa.string())], names=["doc_id", "text"])

    return tokens.selectExpr("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model_path)
        for batch in slices(batches, "text", keep=f"pieces {model_path}"):
            texts = batch.column(1).to_pylist()
            ids, offsets = encoder.encode(texts)
            back = decode(encoder.model, ids, offsets)
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            same = [(t or "") == b for t, b in zip(texts, back, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
