"""What the walks over the graph share: the edges a step may take, and its starts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.model import IN, OUT, PropertyGraph

#: Direction codes of k-hop and walk requests.
DIRECTIONS = {1: (OUT,), 2: (IN,), 3: (OUT, IN)}


def passes(column: str, names: Sequence[str]) -> Column:
    """Whether a name is listed; an empty list lets everything pass."""
    return F.col(column).isin(list(dict.fromkeys(names))) if names else F.lit(True)


#: Vertices up to which a step asks for their edges by id, which skips all other blocks.
FEW = 1000


def few_ids(rows: DataFrame) -> list[int] | None:
    """The ids of rows (id), cheap to scan, if they are few."""
    ids = [r["id"] for r in rows.select("id").limit(FEW + 1).collect()]
    return ids if len(ids) <= FEW else None


def step_edges(graph: PropertyGraph, directions: Sequence[int], relations: Sequence[str], far_labels: Sequence[str], ids: Sequence[int] | None = None) -> DataFrame:
    """Edge rows that a step may take, from the vertices ``ids`` if given; all tests reach the Parquet scan."""
    edges = graph.edges if ids is None else graph.edges_of(ids)
    return edges.filter(F.col("dir").isin(list(directions)) & passes("rel", relations) & passes("dst_label", far_labels))


def starts(graph: PropertyGraph, pks: Sequence[str]) -> DataFrame:
    """Vertices of a request's keys, one row each however often a key is named; unknown keys have none."""
    return graph.vertices_named(pks)


def one_count(df: DataFrame, value: Column, name: str = "count") -> DataFrame:
    """One row with a count as long."""
    return df.agg(F.coalesce(value, F.lit(0)).cast("long").alias(name))


def constant_count(graph: PropertyGraph, value: int, name: str = "count") -> DataFrame:
    return graph.spark.range(1).select(F.lit(value).cast("long").alias(name))
