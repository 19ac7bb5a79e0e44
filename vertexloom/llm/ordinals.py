"""Numbers that tell equal rows apart, without gathering equal rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions.shared import broadcast_if_small, materialize


def with_ordinal(rows: DataFrame, keys: list[str], counted: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``ordinal`` (long): 0, 1, ... among the rows that are equal in ``keys``, nulls being equal.

    ``counted`` is a written table with the keys of the same rows, ``rows``
    itself by default. Only repeated rows are moved: each partition of them
    numbers its own, and counts per key and partition, summed before, give the
    offsets, so a key with any share of the rows stays spread. Which of the
    rows with equal keys has which number is not fixed.
    """
    hashed = F.xxhash64(*(F.col(f"`{k}`") for k in keys)).alias("_h")
    counts = (rows if counted is None else counted).select(hashed).groupBy("_h").agg(F.count("*").alias("n"))
    repeated = materialize(counts.filter("n > 1").select("_h"), "repeated")
    if repeated.isEmpty():
        return rows.withColumn("ordinal", F.lit(0).cast("long"))
    found, hits = rows.withColumns({"_h": hashed, "_part": F.spark_partition_id()}), broadcast_if_small(repeated)
    single = found.join(hits, "_h", "left_anti").withColumn("ordinal", F.lit(0).cast("long"))
    some = materialize(found.join(hits, "_h", "left_semi"), "repeated-rows")
    by_key = [F.col(f"`{k}`") for k in keys]
    sizes = some.groupBy(*by_key, "_part").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("offset", F.sum("n").over(Window.partitionBy(*by_key).orderBy("_part")) - F.col("n"))
    offsets = offsets.select(*(F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_part").alias("_of"), "offset")
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same &= F.col(f"`{k}`").eqNullSafe(F.col(f"_key{i}"))
    place = F.row_number().over(Window.partitionBy(*by_key, "_part").orderBy(F.lit(0)))
    numbered = some.withColumn("_place", place).join(offsets, same)
    numbered = numbered.withColumn("ordinal", F.col("offset") + F.col("_place") - 1)
    return single.select(*rows.columns, "ordinal").unionByName(numbered.select(*rows.columns, "ordinal"))
