"""Prefix dynamic programming over many pre-tokens at once.

The same programming as ``bpe.PrefixTable``, byte position by byte position over
arrays: a step of all pre-tokens in the automaton of token beginnings, then the
tokens that end there, longest first, until one may follow the last token of
what stands before it. Pairs are judged from the whole tokens down: the piece
that was merged last is taken apart first, which looks at the same borders.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    from vertexloom.llm.bpe import Vocabulary

#: Judged pairs that are kept, as a power of two; a pair has one place and drives out what is there.
PAIRS_LOG = 18
NEVER = np.int64(1 << 60)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Numbers:
    """A map from numbers of 0 and above to numbers, both in arrays: open addressing, at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, absent: int):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, absent, values.dtype)
        left, at = np.arange(len(keys)), self._place(keys)
        while left.size:
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            lost = self.keys[at] != keys[left]
            self.values[at[~lost]] = values[left[~lost]]
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        there = self.keys[at]
        left = np.flatnonzero((there != keys) & (there >= 0))
        while left.size:
            at[left] = (at[left] + 1) & self.mask
            there = self.keys[at[left]]
            left = left[(there != keys[left]) & (there >= 0)]
        return self.values[at]


class Columns:
    """Arrays of a vocabulary, and encodings by them. Node 0 is the empty beginning."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        heads = sorted(v.heads, key=len)
        node = {h: i for i, h in enumerate(heads)}
        self.depth = np.fromiter(map(len, heads), np.int64, len(heads))
        self.token = np.fromiter((v.ranks.get(h, -1) for h in heads), np.int64, len(heads))
        above = np.fromiter((node[h[:-1]] for h in heads), np.int64, len(heads))
        byte = np.fromiter((h[-1] if h else 0 for h in heads), np.int64, len(heads))
        self.children = Numbers((above << 8 | byte)[1:], np.arange(1, len(heads)), -1)
        # The longest end that begins a token, and the longest that is one: shallow beginnings first.
        self.fail, self.up = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        starts = np.searchsorted(self.depth, np.arange(int(self.depth[-1]) + 2))
        for a, b in zip(starts[1:-1], starts[2:], strict=True):
            if self.depth[a] > 1:
                self.fail[a:b] = self.step(self.fail[above[a:b]], byte[a:b])
            self.up[a:b] = self.first(self.fail[a:b])
        size = max(v.bytes_of) + 1
        self.size = np.zeros(size, np.int64)
        for rank, b in v.bytes_of.items():
            self.size[rank] = len(b)
        #: Halves of tokens, -1 for none, and whether merging gives the token; -1 until it is asked for.
        self.left, self.right, self.made = np.full(size, -1), np.full(size, -1), np.full(size, -1, np.int8)
        pairs = ((v.ranks[b[:i]] << 32 | v.ranks[b[i:]], r) for b, r in v.ranks.items() for i in range(1, len(b)) if b[:i] in v.ranks and b[i:] in v.ranks)
        merged = np.fromiter(pairs, [("pair", np.int64), ("rank", np.int64)])
        self.merged = Numbers(merged["pair"], merged["rank"], int(NEVER))
        #: Numbers as objects, which all encodings share.
        self.ids = np.arange(size).astype(object)
        self.judged = np.full(1 << PAIRS_LOG, -1, np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The longest end, of what each node stands for and a byte, that begins a token."""
        out = self.children.get(node << 8 | byte)
        left = np.flatnonzero(out < 0)
        node = node[left]
        while left.size:
            out[left[node == 0]] = 0
            left, node = left[node > 0], self.fail[node[node > 0]]
            out[left] = found = self.children.get(node << 8 | byte[left])
            left, node = left[found < 0], node[found < 0]
        return out

    def first(self, node: np.ndarray) -> np.ndarray:
        """The node itself if it is a token, else its longest end that is one."""
        return np.where(self.token[node] >= 0, node, self.up[node])

    def know(self, tokens: np.ndarray) -> None:
        """Fill in the halves of tokens."""
        for t in np.unique(tokens[self.made[tokens] < 0]).tolist():
            self.left[t], self.right[t] = self.vocabulary.halves(t) or (-1, -1)
            self.made[t] = self.vocabulary.made(t)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each b may come right after a in an encoding."""
        key = a << 32 | b
        place = ((key.astype(np.uint64) * _SPREAD) >> np.uint64(64 - PAIRS_LOG)).astype(np.int64)
        kept = self.judged[place]
        out = (kept & 1).astype(bool)
        new = np.flatnonzero(kept >> 1 != key)
        if new.size:
            keys, which = np.unique(key[new], return_inverse=True)
            out[new] = self._judge(keys >> 32, keys & 0xFFFFFFFF)[which]
            self.judged[place[new]] = key[new] << 1 | out[new]
        return out

    def _judge(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, left = np.ones(len(x), bool), np.arange(len(x))
        x_used, y_used = np.full(len(x), NEVER), np.full(len(x), NEVER)
        while left.size:
            across = self.merged.get(x << 32 | y)
            # At equal ranks the leftmost pair is merged first.
            bad = (across < x_used) & (across <= y_used)
            out[left[bad]] = False
            self.know(x)
            self.know(y)
            x_made, y_made = np.where(self.left[x] < 0, -1, x), np.where(self.left[y] < 0, -1, y)
            go = ~bad & ((x_made >= 0) | (y_made >= 0))
            left, x, y, x_used, y_used, apart = left[go], x[go], y[go], x_used[go], y_used[go], (x_made > y_made)[go]
            x_used, y_used = np.where(apart, x, x_used), np.where(apart, y_used, y)
            x, y = np.where(apart, self.right[x], x), np.where(apart, y, self.left[y])
        return out

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The encodings of byte strings that are not empty, the longest first."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        last, node = np.empty(len(data), np.int64), np.zeros(len(pieces), np.int64)
        for at in range(int(sizes[0])):
            end = starts[: np.searchsorted(-sizes, -at)] + at
            node = self.step(node[: len(end)], data[end])
            ending = self.first(node)
            while end.size:
                if not ending.all():
                    raise AssertionError("no token ends this prefix")
                token, size = self.token[ending], self.depth[ending]
                self.know(token)
                good = size > at
                rest = np.flatnonzero(~good)
                good[rest] = self.follows(last[end[rest] - size[rest]], token[rest])
                good &= self.made[token] > 0
                last[end[good]] = token[good]
                bad = ~good
                end, ending = end[bad], self.up[ending[bad]]
        return self._back(last, starts, sizes)

    def _back(self, last: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, ...]]:
        """The tokens from each end back to its start."""
        steps, counts = [], np.zeros(len(starts), np.int64)
        left, end = np.arange(len(starts)), starts + sizes - 1
        while left.size:
            token = last[end]
            steps.append((left, token))
            counts[left] += 1
            end = end - self.size[token]
            more = end >= starts[left]
            left, end = left[more], end[more]
        stops = np.cumsum(counts)
        out = np.empty(int(stops[-1]), np.int64)
        for k, (which, token) in enumerate(steps, 1):
            out[stops[which] - k] = token
        ids = self.ids[out].tolist()
        return [tuple(ids[b - n : b]) for b, n in zip(stops.tolist(), counts.tolist(), strict=True)]
