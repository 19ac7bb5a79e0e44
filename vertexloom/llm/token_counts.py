"""Token counts by a two-tier lookup on the map side.

Texts are split into pre-tokens where they are read. The first tier is a
broadcast table from frequent pre-tokens to their numbers of tokens; what it
lacks is encoded by the tokenizer library and kept in a cache of the worker,
the second tier. No pre-token is ever shuffled, and neither tier changes a
result: the table only saves time.

The table is filled from a bounded sample: about ``SAMPLE_ROWS`` whole texts,
drawn row by row in one scan. Few tasks split them, each hands the driver its
``SUMMARY_SIZE`` most frequent pre-tokens, and the driver adds these up and
keeps ``TABLE_SIZE``. The texts of all documents are split once.

Defined cases: a null text counts as empty and has 0 tokens; texts that hold
the string of a special token are encoded by the library as a whole; rows are
independent, so repeated rows, any length and extra columns are fine; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.arrow import slices, with_columns
from vertexloom.llm.pretokens import pretokens

#: Bounds of both tiers: entries of the broadcast table and of a worker's cache, and characters of each; longer pre-tokens are in neither.
TABLE_SIZE, CACHE_SIZE, MAX_PIECE = 1 << 16, 1 << 18, 64
#: The sample: texts, and tasks that split them.
SAMPLE_ROWS, SAMPLE_TASKS = 8192, 8
#: Different pre-tokens that a task of the sample counts at a time, and that it hands on.
COUNTED_SIZE, SUMMARY_SIZE = 1 << 18, 1 << 14


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """A tokenizer file, loaded once per process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def lengths(path: str, pieces: list[str]) -> list[int]:
    """Numbers of tokens, as the library gives them."""
    return [len(e) for e in tokenizer(path).encode_batch(pieces, add_special_tokens=False)]


def lightened(seen: Counter) -> Counter:
    """The counter without its rarer half: the median count is taken off all."""
    off = sorted(seen.values())[len(seen) // 2]
    return Counter({p: n - off for p, n in seen.items() if n > off})


def summaries(texts: DataFrame) -> DataFrame:
    """Rows (piece, n): the most frequent pre-tokens of each task, at most SUMMARY_SIZE.

    A full counter loses a count near the middle off all, so a frequent one stays.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                seen.update(p for p in pretokens(text or "") if len(p) <= MAX_PIECE)
                if len(seen) > COUNTED_SIZE:
                    seen = lightened(seen)
        top = seen.most_common(SUMMARY_SIZE)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    return texts.mapInArrow(counted, "piece string, n long")


def frequent_lengths(docs: DataFrame, path: str, size: int = TABLE_SIZE, sample_rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """The first tier: the most frequent pre-tokens of the sample, at most ``size``."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    texts = docs.select("text").sample(fraction=share, seed=1).repartition(SAMPLE_TASKS)
    sums: Counter = Counter()
    for r in summaries(texts).toLocalIterator():
        sums[r["piece"]] += r["n"]
    pieces = [p for p, _ in sums.most_common(size)]
    return dict(zip(pieces, lengths(path, pieces), strict=True))


class Lengths:
    """Both tiers in a worker."""

    def __init__(self, path: str, table: dict[str, int]):
        self.path, self.table, self.cache = path, table, {}
        added = tokenizer(path).get_added_tokens_decoder().values()
        self.special = [t.content for t in added]

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.cache) > CACHE_SIZE:
            self.cache.clear()
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        split = [[] if i in whole else pretokens(t) for i, t in enumerate(texts)]
        missed = list({p for s in split for p in s if p not in self.table and p not in self.cache})
        found = dict(zip(missed, lengths(self.path, missed), strict=True))
        self.cache.update((p, n) for p, n in found.items() if len(p) <= MAX_PIECE)
        table, cache = self.table, self.cache
        out = [sum(table.get(p) or cache.get(p) or found[p] for p in s) for s in split]
        for i in whole:
            out[i] = lengths(self.path, [texts[i]])[0]
        return out


_tiers: dict[str, Lengths] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    table, table_id = spark.sparkContext.broadcast(frequent_lengths(docs, path)), uuid.uuid4().hex
    kind = docs.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiers = _tiers.get(table_id)
        if tiers is None:
            _tiers.clear()
            tiers = _tiers[table_id] = Lengths(path, table.value)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = tiers.counts(texts)
            yield with_columns(
                batch,
                ["doc_id", "n_bytes"],
                n_tokens=pa.array(n, pa.int64()),
                over_limit=pa.array([x > limit for x in n], pa.bool_()),
            )

    narrow = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return narrow.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
