"""Language identification by prediction by partial matching.

For each language a byte context tree of variable order holds how often each
byte followed each context of up to ``ORDER`` bytes. A byte costs
``-log2`` of its share in the longest context that was seen; a context of
``n`` bytes, ``d`` of them different, gives a byte with count ``c`` the share
``c / (n + d)`` and the escape to the next shorter context ``d / (n + d)``;
below the empty context every byte has 1/256. The statistics are frozen once
learned, so a text's code length under a language is the sum of costs that
depend on ``ORDER + 1`` bytes each, and the language with the shortest code
is predicted. All of a text's bytes are scored, by table look-up: costs are
computed once for each different run of bytes and kept by the worker.

The trees are fitted on a bounded sample of the learning rows: per language
the texts whose hash is below what lets about ``MAX_BYTES`` pass, less where
many languages share ``TOTAL_BYTES``, and the text with the least hash always,
however long; so each language with a learning row is learned. If that leaves
more than ``MAX_RUNS`` different runs, those with the lowest counts go.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
languages with equal code lengths: the first in order; learning rows with null
text, id or language are not used; with no learning row at all every text is
``und``; equal rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.arrow import slices, with_columns
from vertexloom.functions.shared import broadcast_if_small, materialize

#: Longest context; a context and its byte fit 32 bits.
ORDER = 3
#: Bounds of the sample, for a language and for all, and of the model that driver and workers hold: 16 bytes a run.
MAX_BYTES, TOTAL_BYTES, MAX_RUNS = 8 << 20, 32 << 20, 8 << 20
#: Bytes scored at a time, and slots of the worker's table of costs; fewer with many languages, as each adds a cost to both.
CHUNK = 1 << 20
SLOT_BITS = 20
COSTS = 1 << 22
UNKNOWN = "und"
#: What stands before a text's first byte.
PAD = bytes(ORDER)


@dataclass
class Level:
    """Counts of one order of one language, as sorted arrays."""

    contexts: np.ndarray
    total: np.ndarray
    different: np.ndarray
    runs: np.ndarray  # context and byte
    counts: np.ndarray

    @classmethod
    def of(cls, runs: np.ndarray, counts: np.ndarray) -> Level:
        contexts, first = np.unique(runs >> 8, return_index=True)
        return cls(contexts, np.add.reduceat(counts, first), np.diff(np.append(first, len(runs))), runs, counts)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted array, and whether they are there."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Tree:
    """The context tree of a language, from counts of runs of ORDER + 1 bytes."""

    def __init__(self, runs: np.ndarray, counts: np.ndarray):
        self.levels = []
        for order in range(ORDER, -1, -1):
            short = runs & np.uint64((1 << 8 * (order + 1)) - 1)
            kept, place = np.unique(short, return_inverse=True)
            self.levels.append(Level.of(kept, np.bincount(place, weights=counts).astype(np.int64)))

    def costs(self, runs: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each run after the ones before it."""
        bits, open_ = np.zeros(len(runs)), np.arange(len(runs))
        for order, level in zip(range(ORDER, -1, -1), self.levels, strict=True):
            short = runs[open_] & np.uint64((1 << 8 * (order + 1)) - 1)
            at, known = find(level.contexts, short >> np.uint64(8))
            room = np.log2(level.total[at] + level.different[at])
            place, seen = find(level.runs, short)
            seen &= known
            bits[open_[seen]] += room[seen] - np.log2(level.counts[place[seen]])
            escaped = known & ~seen
            bits[open_[escaped]] += room[escaped] - np.log2(level.different[at[escaped]])
            open_ = open_[~seen]
        bits[open_] += 8.0
        return bits


def runs_of(texts: list[bytes], before: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts the run that ends with it, text after text; and each text's first place.

    ``before`` has the ORDER bytes ahead of each text.
    """
    before = before or [PAD] * len(texts)
    data = np.frombuffer(b"".join(chain.from_iterable(zip(before, texts, strict=True))), np.uint8).astype(np.uint64)
    runs = data.copy()
    for back in range(1, ORDER + 1):
        runs[back:] |= data[:-back] << np.uint64(8 * back)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    own = np.ones(len(data), bool)
    for k in range(ORDER):
        own[first + ORDER * np.arange(len(texts)) + k] = False
    return runs[own], first


def parts(texts: list[bytes], chunk: int) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """(place of the text, bytes before, bytes) that make up the texts, in lists of about ``chunk`` bytes."""
    out, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), chunk):
            piece = text[at : at + chunk]
            out.append((i, text[at - ORDER : at] if at else PAD, piece))
            size += len(piece)
            if size >= chunk:
                yield out
                out, size = [], 0
    if out:
        yield out


class Model:
    """Trees of all languages, with a table of the costs of the runs met last."""

    def __init__(self, learned: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(learned)
        self.trees = [Tree(*learned[x]) for x in self.languages]
        room = max(1 << ORDER + 1, COSTS // max(1, len(self.languages)))
        self.chunk, self.shift = min(CHUNK, room), np.uint64(64 - min(SLOT_BITS, room.bit_length() - 1))
        slots = 1 << 64 - int(self.shift)
        self.held = np.full(slots, 1 << 40, np.uint64)
        self.table = np.zeros((slots, len(self.languages)), np.float32)

    def run_costs(self, runs: np.ndarray) -> np.ndarray:
        """(runs, languages) bits."""
        slot = (runs * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        out = self.table[slot]
        lacking = np.flatnonzero(self.held[slot] != runs)
        if len(lacking):
            new, place = np.unique(runs[lacking], return_inverse=True)
            costs = np.stack([t.costs(new) for t in self.trees], axis=1).astype(np.float32)
            out[lacking] = costs[place]
            to = (new * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
            # Of runs with one slot the last stays, in both arrays.
            last = len(to) - 1 - np.unique(to[::-1], return_index=True)[1]
            self.held[to[last]], self.table[to[last]] = new[last], costs[last]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages) bits; texts of any length."""
        out = np.zeros((len(texts), len(self.languages)))
        for group in parts(texts, self.chunk):
            place, before, pieces = (list(x) for x in zip(*group, strict=True))
            runs, first = runs_of(pieces, before)
            np.add.at(out, place, np.add.reduceat(self.run_costs(runs), first, axis=0, dtype=np.float64))
        return out


def learned_runs(rows: DataFrame) -> DataFrame:
    """Rows (lang, run, n) from learning rows (lang, text): how often each run of ORDER + 1 bytes occurs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}
        for batch in slices(batches):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                runs, n = np.unique(runs_of(texts)[0], return_counts=True)
                sums.setdefault(lang, Counter()).update(dict(zip(runs.tolist(), n.tolist(), strict=True)))
        for lang, counter in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counter), pa.string()), pa.array(list(counter), pa.int64()), pa.array(list(counter.values()), pa.int64())],
                names=["lang", "run", "n"],
            )

    return rows.select("lang", "text").mapInArrow(counted, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))


def sample(rows: DataFrame, max_bytes: int = MAX_BYTES, total_bytes: int = TOTAL_BYTES) -> DataFrame:
    """Of the learning rows (doc_id, lang, text), with text and language, about ``max_bytes`` of text per language, by a hash of id and text."""
    hashed = rows.withColumn("_hash", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    sizes = hashed.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("size"), F.min("_hash").alias("least"))
    sizes = materialize(sizes, "langid-sizes")
    each = min(max_bytes, total_bytes // max(1, sizes.count()))
    most = F.lit((1 << 63) - 1)
    passing = F.when(F.col("size") <= each, most).otherwise(F.greatest("least", (F.lit(each) / F.col("size") * F.lit(2.0**63)).cast("long")))
    limits = broadcast_if_small(sizes.select(F.col("lang").alias("_lang"), passing.alias("_limit")))
    return hashed.join(limits, F.col("lang") == F.col("_lang")).filter(F.col("_hash") <= F.col("_limit")).select(*rows.columns)


def learn(rows: DataFrame, max_bytes: int = MAX_BYTES, max_runs: int = MAX_RUNS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language, runs in order and their counts, ``max_runs`` at most."""
    usable = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    found = materialize(learned_runs(sample(usable, max_bytes)), "langid-runs")
    total = found.count()
    if total > max_runs:
        least = 0
        for r in found.groupBy("n").count().orderBy("n").toLocalIterator():
            if total <= max_runs:
                break
            total, least = total - r["count"], r["n"]
        found = found.filter(F.col("n") > least)
    got = found.toArrow()
    langs = got["lang"].combine_chunks().dictionary_encode()
    place, runs, n = langs.indices.to_numpy(), got["run"].to_numpy().astype(np.uint64), got["n"].to_numpy().astype(np.float64)
    order = np.lexsort((runs, place))
    cuts = np.searchsorted(place[order], np.arange(len(langs.dictionary) + 1))
    return {lang: (runs[own], n[own]) for lang, a, b in zip(langs.dictionary.to_pylist(), cuts, cuts[1:], strict=False) for own in [order[a:b]]}


_model: dict[str, Model] = {}


def predict(docs: DataFrame, learned: dict[str, tuple[np.ndarray, np.ndarray]], keep: list[str]) -> DataFrame:
    """The kept columns, lang_pred and score.

    The score is the probability of the predicted language given the whole
    text, all languages being equally likely before.
    """
    shared, shared_id = docs.sparkSession.sparkContext.broadcast(learned), uuid.uuid4().hex
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model.get(shared_id)
        if model is None:
            _model.clear()
            model = _model[shared_id] = Model(shared.value)
        for batch in slices(batches, 128):
            asked = [t if has else None for t, has in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_letter").to_pylist(), strict=True)]
            langs, scores = [UNKNOWN] * len(asked), [0.0] * len(asked)
            some = [i for i, t in enumerate(asked) if t is not None]
            if some and model.languages:
                bits = model.code_lengths([asked[i] for i in some])
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
                for i, b, s in zip(some, best, share, strict=True):
                    langs[i], scores[i] = model.languages[b], float(s)
            yield with_columns(batch, keep, lang_pred=pa.array(langs, pa.string()), score=pa.array(scores, pa.float64()))

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    return docs.select(*keep, "text", letter).mapInArrow(predicted, ", ".join([*fields, "lang_pred string", "score double"]))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def identify(docs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Held-out rows and those without id are not learned from."""
    fold = remainder(F.col("doc_id"), 4)
    learned = learn(docs.filter(fold != 2).select("doc_id", "lang", "text"), max_bytes)
    return predict(docs.withColumn("held_out", F.coalesce(fold == 2, F.lit(False))), learned, ["doc_id", "held_out"])
