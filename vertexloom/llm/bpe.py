"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

For every prefix of a pre-token's bytes there is exactly one token that can end
the prefix's encoding: the token ``t`` that is a suffix of the prefix and may
follow the last token of what stands before it. Storing that last token for
each prefix gives the encoding by walking back, lets bytes be appended without
looking at what is there, and lets an edit reuse all prefixes before it and,
once the stored tokens agree again for as long as a token can be, all after it.

Whether token ``b`` may follow token ``a`` is read from how the two are built:
in order of rank, the pieces at the common border grow on either side, and the
pair stands unless a merge across the border comes before the merges that use
these pieces up.

The pre-tokens that a slice of texts asks for and the cache lacks are encoded
together, by the same programming over arrays (``columns.py``).

Defined cases: a null text counts as empty and has no tokens; rows are
independent, so repeated rows, any length and extra columns are fine; an empty
table gives an empty result. Decoding joins the tokens' bytes; an id outside
the vocabulary raises an error. A vocabulary's tokens must come from merges in
order of rank: one that only a merge of higher rank leads to is taken as never
given, where the library may give it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain, islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.arrow import slices, with_columns
from vertexloom.llm.columns import Columns
from vertexloom.llm.pretokens import pretokens

#: Bounds of what a worker keeps: entries of a half of a cache, characters of a pre-token (longer ones are encoded each time).
PIECES, MAX_PIECE, PAIRS, FALLEN = 1 << 16, 64, 1 << 16, 1 << 15
#: Pre-tokens that arrays pay for: where fewer are as long, each is encoded by itself.
FEW = 64
LATE = 1 << 60


class Halves(dict):
    """A cache in two halves: when the new one is full it becomes the old one, and what is asked for again moves from the old to the new."""

    def __init__(self, find: Callable[[Any], Any], room: int):
        self.find, self.room, self.old = find, room, {}

    def __missing__(self, key: Any) -> Any:
        found = self.old.get(key)
        if found is None:
            found = self.find(key)
        self.keep({key: found})
        return found

    def keep(self, found: dict) -> None:
        """Add entries that are not in the new half, as many as it has room for."""
        if len(self) + len(found) > self.room:
            self.old = dict(self)
            self.clear()
        self.update(found if len(found) <= self.room else islice(found.items(), self.room))


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.heads = {b[:i] for b in ranks for i in range(len(b) + 1)}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.longest_end = Halves(self._fall, FALLEN)
        self.endings = Halves(self._ends, len(self.heads))
        self.follows = Halves(self._follows, PAIRS)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for single bytes and for tokens that merging never gives."""
        if token not in self._halves:
            parts = self._merged(self.bytes_of[token], token)
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def _merged(self, data: bytes, below: int) -> list[int]:
        """Tokens after all merges of rank less than ``below``, lowest rank and leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], LATE), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def made(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The pieces at one border of a token from single byte to whole: (piece, rank that uses it up)."""
        key = (token, right)
        if key not in self._edges:
            out, used = [], LATE
            while True:
                out.append((token, used))
                split = self.halves(token)
                if split is None:
                    break
                token, used = split[right], token
            self._edges[key] = out[::-1]
        return self._edges[key]

    def _fall(self, grown: bytes) -> bytes:
        """The longest end of ``grown`` that begins a token."""
        while grown not in self.heads:
            grown = grown[1:]
        return grown

    def _ends(self, head: bytes) -> tuple[tuple[int, int], ...]:
        """(size, token) of the tokens that end ``head`` and that merging gives, the longest first."""
        ends = ((len(head) - i, self.ranks.get(head[i:])) for i in range(len(head)))
        return tuple((n, t) for n, t in ends if t is not None and self.made(t))

    def _follows(self, pair: int) -> bool:
        """Whether b may come right after a in an encoding, for ``a << 32 | b``."""
        left, right = self.edge(pair >> 32, True), self.edge(pair & 0xFFFFFFFF, False)
        i = j = 0
        while True:
            (x, x_used), (y, y_used) = left[i], right[j]
            across = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
            # At equal ranks the leftmost pair is merged first.
            if across is not None and across < x_used and across <= y_used:
                return False
            if x_used == y_used == LATE:
                return True
            if x_used <= y_used:
                i += 1
            else:
                j += 1


class PrefixTable:
    """Last tokens of all prefixes of a byte string that can grow and change."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes at the end; stored tokens stay as they are."""
        self.data += data
        for token in self._lasts(len(self.last)):
            self.last.append(token)

    def splice(self, start: int, stop: int, new: bytes) -> int:
        """Replace ``data[start:stop]``; returns how many prefixes had to be looked at."""
        old_last, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old_last[:start]
        same = 0
        for end, token in enumerate(self._lasts(start), start + 1):
            self.last.append(token)
            before = end - 1 - shift
            same = same + 1 if end > start + len(new) and before >= stop and old_last[before] == self.last[-1] else 0
            if same >= self.vocabulary.longest:
                self.last += old_last[before + 1 :]
                return end - start
        return len(self.data) - start

    def _lasts(self, start: int) -> Iterator[int]:
        """Last tokens of the prefixes longer than ``start``, in order; each is to be stored before the next is taken."""
        v, data, last = self.vocabulary, self.data, self.last
        heads, longest_end, endings, follows = v.heads, v.longest_end, v.endings, v.follows
        head = b""
        for at in range(max(0, start - v.longest), len(data)):
            head += data[at : at + 1]
            if head not in heads:
                head = longest_end[head]
            if at < start:
                continue
            for size, token in endings[head]:
                if size > at or follows[last[at - size] << 32 | token]:
                    yield token
                    break
            else:
                raise AssertionError("no token ends this prefix")

    def tokens(self) -> list[int]:
        """The encoding, by walking back from the end."""
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Pieces(Halves):
    """Encodings of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(self.encode, PIECES)
        self.vocabulary = vocabulary

    @cached_property
    def columns(self) -> Columns:
        return Columns(self.vocabulary)

    def encode(self, piece: str) -> tuple[int, ...]:
        return self.encode_all([piece])[piece]

    def encode_all(self, new: list[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of different pre-tokens that are not empty: together as far as enough are as long, each longer one by itself."""
        data = [p.encode() for p in new]
        out = dict(zip(new, map(self.vocabulary.ranks.get, data), strict=True))
        parted = np.fromiter((w is None for w in out.values()), bool, len(new)).nonzero()[0]
        out = {p: (w,) for p, w in out.items() if w is not None}
        sizes = np.fromiter(map(len, data), np.int64, len(new))[parted]
        order = np.argsort(-sizes, kind="stable")
        long = int((sizes > sizes[order[FEW - 1]]).sum()) if len(order) >= FEW else len(order)
        order = parted[order].tolist()
        for i in order[:long]:
            out[new[i]] = tuple(PrefixTable(self.vocabulary, data[i]).tokens())
        if many := order[long:]:
            out.update(zip(map(new.__getitem__, many), self.columns.encode([data[i] for i in many]), strict=True))
        return out

    def texts(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of texts; what the cache lacks of all of them is encoded together."""
        split = [pretokens(t or "") for t in texts]
        asked = set(chain.from_iterable(split))
        known = dict(zip(asked, map(self.get, asked), strict=True))
        lacked = [p for p, ids in known.items() if ids is None]
        again = {p: ids for p, ids in zip(lacked, map(self.old.get, lacked), strict=True) if ids is not None}
        new = self.encode_all([p for p in lacked if p not in again])
        known |= again
        known |= new
        self.keep(again | {p: ids for p, ids in new.items() if len(p) <= MAX_PIECE})
        return [list(chain.from_iterable(map(known.__getitem__, s))) for s in split]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The cache for a rank file, one per process."""
    return Pieces(Vocabulary.read(path))


def encode_text(path: str, text: str | None) -> list[int]:
    """Ids of a text, each pre-token by itself."""
    return pieces(path).texts([text])[0]


def decode_ids(path: str, ids: Iterable[int]) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(map(pieces(path).vocabulary.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of the text column as array<int>; a column named ``ids`` is replaced."""
    keep = [f for f in docs.schema.fields if f.name != ids]
    names = [f.name for f in keep]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pieces(path).texts(batch.column(text).to_pylist())
            yield with_columns(batch, names, **{ids: pa.array(found, pa.list_(pa.int32()))})

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(encoded, _schema(keep, ids, "array<int>"))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of the ids column, as binary; null ids give null."""
    keep = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in keep]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [None if x is None else decode_ids(path, x) for x in batch.column(ids).to_pylist()]
            yield with_columns(batch, names, **{text: pa.array(found, pa.binary())})

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(decoded, _schema(keep, text, "binary"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens and digests of its ids and of what they decode to.

    Ids are encoded, written out, and decoded within one task, so only the
    digests leave it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = {i: str(i) for i in pieces(path).vocabulary.bytes_of}
        for batch in slices(batches):
            n, ids_sha, decoded_sha = [], [], []
            for ids in pieces(path).texts(batch.column("text").to_pylist()):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(written.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decode_ids(path, ids)).hexdigest())
            yield with_columns(batch, ["doc_id"], n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(ids_sha, pa.string()), decoded_sha256=pa.array(decoded_sha, pa.string()))

    return docs.select("doc_id", "text").mapInArrow(digested, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _schema(keep, name: str, kind: str):
    from pyspark.sql.types import StructType, _parse_datatype_string

    return StructType(list(keep)).add(name, _parse_datatype_string(kind))
