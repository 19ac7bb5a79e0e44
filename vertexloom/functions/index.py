"""Dense numbers in a total order, without ordering everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from vertexloom.functions.shared import broadcast_if_small, materialize


def dense_index(df: DataFrame, order: list[Column | str], name: str, first: int = 0, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... (plus ``first``) in the given order, and without the columns ``drop``.

    Rows are range-partitioned and sorted, each partition numbers its own, and
    the partitions' counts, a few bytes each on the driver, give the offsets.
    """
    low = (1 << 33) - 1
    place = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).drop(*drop)
    ordered = materialize(ordered.withColumns({"_part": F.shiftright(place, 33).cast("int"), "_place": place.bitwiseAND(F.lit(low))}), "indexed")
    counts = {r["_part"]: r["n"] for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], first
    for part in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(part, 0)
    table = F.split(F.lit(",".join(map(str, offsets or [first]))), ",").cast("array<bigint>")
    return ordered.withColumn(name, F.get(table, F.col("_part")) + F.col("_place")).drop("_part", "_place")


def file_index(df: DataFrame, piece: list[str], place: str, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... by ``piece`` (a file, or a block of one) and then ``place``, whose values in a piece have no gaps.

    Rows stay where they are read: only the pieces' sizes reach the driver.
    ``df`` is read twice.
    """
    def at(row: Row) -> list:
        return [row[c].encode() if isinstance(row[c], str) else row[c] for c in piece]

    sizes = sorted(df.groupBy(*piece).agg(F.min(place).alias("_first"), F.count("*").alias("_n")).collect(), key=at)
    shifts, total = [], 0
    for r in sizes:
        shifts.append((*(r[c] for c in piece), total - r["_first"]))
        total += r["_n"]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*piece).schema)
    table = broadcast_if_small(df.sparkSession.createDataFrame(shifts, f"{kind}, _shift long"))
    return df.join(table, piece).withColumn(name, F.col(place) + F.col("_shift")).drop("_shift")
