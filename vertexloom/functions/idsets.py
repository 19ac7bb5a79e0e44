"""Sets of ids as bits, so that a large one can still be handed to every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.shared import broadcast_if_small, is_broadcast, materialize

#: A row has SPAN ids in words of 64 bits.
WORDS, SPAN = 4, 256


def id_bits(ids: DataFrame, column: str = "id") -> DataFrame:
    """The ids >= 0 of a column as a written table: row ``span`` has those from SPAN * span on, a bit each. Ids may repeat."""
    id_, bit = F.col(column), F.call_function("shiftleft", F.lit(1).cast("long"), F.col(column).bitwiseAND(F.lit(63)).cast("int"))
    words = [F.bit_or(F.when(_word(id_) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"bits{i}") for i in range(WORDS)]
    return materialize(ids.filter(id_.isNotNull()).groupBy(F.shiftright(id_, 8).alias("span")).agg(*words), "id-bits")


def among(rows: DataFrame, column: str, ids: DataFrame, bits: DataFrame | None = None) -> DataFrame:
    """The rows whose ``column`` is one of ``ids`` (id).

    Where the ids' bits are small enough to be broadcast, the rows stay where
    they are; else both sides are shuffled.
    """
    bits = broadcast_if_small(id_bits(ids) if bits is None else bits)
    if not is_broadcast(bits):
        return rows.join(ids.select(F.col("id").alias("_id")), F.col(column) == F.col("_id"), "left_semi")
    own = F.col(column)
    of = F.coalesce(*(F.when(_word(own) == i, F.col(f"bits{i}")) for i in range(WORDS)))
    found = rows.join(bits, F.shiftright(own, 8) == F.col("span"))
    return found.filter(F.getbit(of, own.bitwiseAND(F.lit(63)).cast("int")) == 1).select(*rows.columns)


def _word(id_: Column) -> Column:
    return F.shiftright(id_, 6).bitwiseAND(F.lit(WORDS - 1))
