"""A run-length compressed index over many short strings, searched for many queries at once.

The Burrows-Wheeler transform of the strings, sorted group by group, is kept as runs;
text positions are sampled at the first and last row of each run only. Matching
statistics stream each query from its last character to its first: a step inside a run
of the wanted character keeps the match and extends it; otherwise the nearest runs of
that character above and below are tried, and the one whose sampled suffix agrees
longest with the query goes on. All queries of a batch take the same step together.
"""

from __future__ import annotations

import numpy as np

ALPHABET = 257  # a byte plus one; 0 ends a string


class RunIndex:
    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray):
        """Strings ``data[starts[i]:starts[i] + lengths[i]]``; ``groups`` ascending, from 0, none left out."""
        self.max_length = int(lengths.max(initial=0))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        n = int(begins[-1])
        own = np.repeat(np.arange(len(lengths)), lengths + 1)
        at = np.arange(n) - begins[own]
        text = np.zeros(n + 1, dtype=np.int16)
        inner = at < lengths[own]
        text[:-1][inner] = data[(starts[own] + at)[inner]].astype(np.int16) + 1
        self.text = text
        order = self._suffixes(text[:-1], begins[1:][own] - 1, groups[own])
        group = groups[own][order]
        before = np.where(at[order] > 0, text[order - 1], 0)
        symbol = group * ALPHABET + before
        head = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        length = np.diff(np.append(head, n))
        by = np.argsort(symbol[head], kind="stable")
        self.symbol, self.head, self.length = symbol[head][by], head[by], length[by]
        self.first_sample, self.last_sample = order[self.head], order[self.head + self.length - 1]
        total = np.cumsum(self.length) - self.length
        kind = np.flatnonzero(np.concatenate([[True], self.symbol[1:] != self.symbol[:-1]]))
        which = np.cumsum(np.concatenate([[True], self.symbol[1:] != self.symbol[:-1]])) - 1
        leading = group * ALPHABET + text[order]  # ascending: rows are sorted by group and first character
        self.target = np.searchsorted(leading, self.symbol[kind])[which] + total - total[kind][which]  # the row a run's head maps to
        self.rows = n + 1
        self.key = self.symbol * self.rows + self.head
        self.group_row = np.searchsorted(group, np.arange(int(groups.max(initial=-1)) + 1))

    @staticmethod
    def _suffixes(text: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Suffixes by group, then by characters up to their string's end, then by position: prefix doubling."""
        n = len(text)
        wide = np.concatenate([text.astype(np.int64), np.zeros(4, np.int64)])
        here = np.arange(n)
        key = group.astype(np.int64)
        for k in range(4):
            key = key * ALPHABET + np.where(here + k <= end, wide[k : k + n], 0)
        size = 4
        longest = int((end - here).max(initial=0)) + 1
        while True:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(fresh)
            if size >= longest or fresh.all():
                return order
            then = here + size
            inside = then <= end
            key = rank * (n + 1)
            key[inside] += rank[then[inside]]
            size *= 2

    def matching(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray, least: int) -> np.ndarray:
        """hit[i, p]: query i has at p a match of ``least`` characters or more within its group's strings."""
        q = len(starts)
        width = int(lengths.max(initial=0))
        query = np.zeros((q, width + 1), dtype=np.int16)
        cell = np.arange(width)[None, :] < lengths[:, None]
        query[:, :-1][cell] = data[(starts[:, None] + np.arange(width)[None, :])[cell]].astype(np.int16) + 1
        by = np.argsort(-lengths, kind="stable")
        query, size, base = query[by], lengths[by], groups[by] * ALPHABET
        row, match, place = self.group_row[groups[by]].copy(), np.zeros(q, np.int64), np.zeros(q, np.int64)
        hit = np.zeros((q, width), dtype=bool)
        runs = len(self.key)
        for t in range(width):
            n = int(np.searchsorted(-size, -t, side="left"))  # queries longer than t
            p = size[:n] - 1 - t
            symbol = base[:n] + query[np.arange(n), p]
            above = np.searchsorted(self.key, symbol * self.rows + row[:n], side="right") - 1
            has_above = (above >= 0) & (self.symbol[above] == symbol)
            step = row[:n] - self.head[above]
            inside = has_above & (step < self.length[above])
            new_row, new_match, new_place = self.target[above] + step, match[:n] + 1, place[:n] - 1
            if not inside.all():
                off = np.flatnonzero(~inside)
                up, below = above[off], above[off] + 1
                has_up = has_above[off]
                has_below = below < runs
                has_below[has_below] = self.symbol[below[has_below]] == symbol[off][has_below]
                lcp_up = self._agree(query, off, p, match, self.last_sample[up], has_up)
                lcp_below = self._agree(query, off, p, match, self.first_sample[np.minimum(below, runs - 1)], has_below)
                use_up = has_up & (~has_below | (lcp_up >= lcp_below))
                use_below = has_below & ~use_up
                new_row[off] = np.where(use_up, self.target[up] + self.length[up] - 1, np.where(use_below, self.target[np.minimum(below, runs - 1)], row[off]))
                new_match[off] = np.where(use_up, lcp_up + 1, np.where(use_below, lcp_below + 1, 0))
                new_place[off] = np.where(use_up, self.last_sample[up], self.first_sample[np.minimum(below, runs - 1)]) - 1
            row[:n], match[:n], place[:n] = new_row, new_match, new_place
            long = new_match >= least
            hit[np.flatnonzero(long), p[long]] = True
        out = np.empty_like(hit)
        out[by] = hit
        return out

    def _agree(self, query: np.ndarray, off: np.ndarray, p: np.ndarray, match: np.ndarray, sample: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """How far the text from each sample agrees with the query after p, as far as its match goes."""
        out = np.zeros(len(off), dtype=np.int64)
        most = match[off]
        todo = np.flatnonzero(valid & (most > 0))
        for part in np.array_split(todo, max(1, len(todo) // 20_000)):
            if not len(part):
                continue
            far = int(most[part].max())
            steps = np.arange(far)[None, :]
            a = self.text[np.minimum(sample[part][:, None] + steps, len(self.text) - 1)]
            b = query[off[part][:, None], np.minimum(p[off[part]][:, None] + 1 + steps, query.shape[1] - 1)]
            differ = (a != b) | (b == 0)
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), far)
            out[part] = np.minimum(first, most[part])
        return out


def earlier_windows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray, least: int) -> np.ndarray:
    """hit[i, p]: the ``least`` characters of string i at p occur in an earlier string of its group.

    ``groups`` ascending; a group's strings stand in order. Earlier strings grow an index by
    the logarithmic method: on each level, blocks of 2**level strings are indexed and the
    block after each is streamed against it, so every pair of strings meets exactly once.
    """
    n = len(starts)
    hit = np.zeros((n, int(lengths.max(initial=0))), dtype=bool)
    if not n:
        return hit
    head = np.concatenate([[True], groups[1:] != groups[:-1]])
    dense = np.cumsum(head) - 1
    sequence = np.arange(n) - np.flatnonzero(head)[dense]
    size = np.bincount(dense)[dense]
    level = 0
    while (size > (1 << level)).any():
        block = sequence >> level
        reference = (block % 2 == 0) & (size > ((block + 1) << level))
        streamed = block % 2 == 1
        pair = dense * (int(block.max()) + 2) + (block >> 1)
        kinds, group = np.unique(pair[reference], return_inverse=True)
        index = RunIndex(data, starts[reference], lengths[reference], group)
        own = index.matching(data, starts[streamed], lengths[streamed], np.searchsorted(kinds, pair[streamed]), least)
        hit[np.flatnonzero(streamed), : own.shape[1]] |= own
        level += 1
    return hit
