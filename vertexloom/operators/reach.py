"""k-hop neighbourhoods and walk counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.idsets import among
from vertexloom.functions.shared import materialize
from vertexloom.model import PropertyGraph
from vertexloom.operators.steps import DIRECTIONS, constant_count, few_ids, one_count, passes, starts, step_edges

WEIGHT = "decimal(38,0)"


def khop(graph: PropertyGraph, pks: Sequence[str], k: int, direction: int, relations: Sequence[str] = (), labels: Sequence[str] = ()) -> DataFrame:
    """Rows (id): vertices within k steps, with the starts that pass.

    A start must have a listed vertex label, a step an edge row with a listed
    far label and relation, so the labels prune paths.
    """
    reached = starts(graph, pks).filter(passes("label", labels)).select("id")
    if k <= 0 or direction not in DIRECTIONS or not pks:
        return reached.limit(0)
    # Each level is written, so that none is planned or run again by the next.
    frontier = reached = materialize(reached, "khop-reached")
    for _ in range(k):
        ids = few_ids(frontier)
        if ids == []:
            break
        edges = step_edges(graph, DIRECTIONS[direction], relations, labels, ids).select("src", "dst")
        if ids is None:
            edges = among(edges, "src", frontier)
        met = edges.select(F.col("dst").alias("id")).distinct()
        frontier = materialize(met.join(reached, "id", "left_anti"), "khop-frontier")
        reached = reached.unionByName(frontier)
    return reached


def khop_count(graph: PropertyGraph, pks: Sequence[str], k: int, direction: int, relations: Sequence[str] = (), labels: Sequence[str] = ()) -> DataFrame:
    """One row with the number of vertices that ``khop`` gives."""
    if k <= 0 or direction not in DIRECTIONS or not pks:
        return constant_count(graph, 0)
    return one_count(khop(graph, pks, k, direction, relations, labels), F.count("*"))


def walk_count(
    graph: PropertyGraph, pks: Sequence[str], k: int, direction: int, relations: Sequence[str] = (), labels: Sequence[str] = (), distinct: bool = False
) -> DataFrame:
    """One row with the number of walks of exactly k steps, or of the different vertices where they end.

    Walks are never written out: a level holds each vertex once, with the
    number of walks that end there. Starts count as often as they are named, a
    relation listed twice doubles its edges; edge labels are tested, start
    labels are not. The number is a long: one of 2**63 or more raises an error.
    """
    if k <= 0 or direction not in DIRECTIONS or not pks:
        return constant_count(graph, 0)
    level = starts(graph, pks)
    if distinct:
        level = level.select("id")
    else:
        named = Counter(pks)
        times = F.coalesce(*(F.when(F.col("pk") == p, F.lit(n)) for p, n in named.items())) if max(named.values()) > 1 else F.lit(1)
        level = level.select("id", times.cast(WEIGHT).alias("w"))
    listed = Counter(relations)
    times = F.lit(1)
    if listed and max(listed.values()) > 1:
        times = F.coalesce(*(F.when(F.col("rel") == r, F.lit(n)) for r, n in listed.items()))
    level = materialize(level, "walk-level")
    for step in range(1, k + 1):
        ids = few_ids(level)
        edges = step_edges(graph, DIRECTIONS[direction], relations, labels, ids).select("src", "dst", times.cast("int").alias("times"))
        if ids is None:
            edges = among(edges, "src", level.select("id"))  # no other edges go into the join's shuffle
        met = level.join(edges, level["id"] == edges["src"])
        if distinct:
            level = met.select(F.col("dst").alias("id")).distinct()
        else:
            level = met.groupBy(F.col("dst").alias("id")).agg(F.sum((F.col("w") * F.col("times")).cast(WEIGHT)).cast(WEIGHT).alias("w"))
        if step < k:
            level = materialize(level, "walk-level")
    return one_count(level, F.count("*") if distinct else F.sum("w"))
