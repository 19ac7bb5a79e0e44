"""Mixing sources to target weights by repetition rates.

Tokens (words) are summed per source, a target per source is water-filled from
the weights, and the rate ``target / size`` says how often each document of
the source is emitted: ``floor(rate)`` times for sure, and once more when a
hash-seeded Bernoulli draw with probability ``rate - floor(rate)`` succeeds.

Defined cases: a null text has size 0; null is a source of its own, the last
in order; a source of size 0 has target 0 and its documents are emitted 0
times; documents with equal or null ids are drawn for by their texts as well,
and rows equal in source, id and text by their number among each other, so
each row has a draw of its own; an empty table gives an empty result.
Everything is DataFrame code that runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.index import dense_index
from vertexloom.functions.shared import broadcast_if_small, materialize
from vertexloom.llm.ordinals import with_ordinal
from vertexloom.llm.words import word_count

#: What a row's draw is decided by, beside the seed; the first for the target alone.
KEYS = ["source", "doc_id", "digest"]


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size).

    Sources in code point order, null last, take the weights in turn. ``share``
    times all sizes is divided by weight; no target exceeds ``most`` times its
    source's size, and what is cut off is divided again among the rest.

    The level that sources get per unit of weight only rises as capped sources
    leave the sharing, so it is raised until no further source is capped. Each
    round is one aggregation; sources are never brought into one task.
    """
    ordered = dense_index(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = ordered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    total, open_weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level = float(total or 0) * float(share), 0.0
    left = budget
    while open_weight:
        level = left / open_weight
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        capped, rest = table.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if rest == open_weight:
            break
        left, open_weight = budget - capped, rest
    # With all capped no level is left to hold any source below its cap.
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight")) if open_weight else F.col("cap")
    return table.select("source", "source_size", target.alias("target"))


def draw(key: Column, seed: int) -> Column:
    """A double in [0, 1) decided by a key and the seed: 48 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def copies(rate: Column, key: Column, seed: int) -> Column:
    """How often a document is emitted: floor(rate), once more by the draw."""
    return (F.floor(rate) + (draw(key, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def mixing_plan(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Texts are scanned once; narrow rows (id, source, size, digest) are written
    to the shared folder and read for the totals, the repeats and the result.
    """
    narrow = _narrow(docs)
    return _joined(with_ordinal(narrow, KEYS), _targets(narrow, weights, share, most)).select(
        "doc_id", "source", "size", "source_size", "target", copies(_rate(), _key(), seed).alias("copies")
    ).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed corpus: every row of ``docs``, all its columns, as often as its copies say. Only rows with repeats are shuffled."""
    narrow = _narrow(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), "source", "doc_id", _digest())
    return (
        _joined(with_ordinal(rows, KEYS, narrow), _targets(narrow, weights, share, most))
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies(_rate(), _key(), seed).cast("int"))))
        .select(*[F.col(f"d.`{c}`") for c in docs.columns])
    )


def _digest() -> Column:
    return F.md5(F.col("text").cast("binary")).alias("digest")


def _narrow(docs: DataFrame) -> DataFrame:
    return materialize(docs.select("source", "doc_id", word_count(F.col("text")).alias("size"), _digest()), "mix-sizes")


def _targets(narrow: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    return materialize(source_targets(totals, weights, share, most), "mix-targets")


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def _key() -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("digest", F.lit("")), F.col("ordinal").cast("string"))


def _joined(rows: DataFrame, targets: DataFrame) -> DataFrame:
    t = targets.withColumnRenamed("source", "_source")
    return rows.join(broadcast_if_small(t), rows["source"].eqNullSafe(t["_source"])).drop("_source")
