"""One-hop neighbours and common neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.model import IN, OUT, GraphError, PropertyGraph
from vertexloom.operators.lookups import vertex_by_pk
from vertexloom.operators.steps import constant_count, few_ids, one_count, starts, step_edges


def one_hop(graph: PropertyGraph, pk: str, direction: int = 2, relation: str | None = None) -> DataFrame:
    """Rows (dir, edge): each edge of a vertex written in its true direction as ``pk:label -> [rel] -> pk:label``.

    ``direction`` is 0 for outgoing, 1 for incoming, 2 for both; a self-loop
    has two rows then. The vertex's own label comes from the vertex, the
    other's from the edge row. No relation or an empty one: all relations.
    """
    if direction not in (0, 1, 2):
        raise GraphError("direction must be 0, 1 or 2")
    own = vertex_by_pk(graph, pk).select(F.col("id").alias("src"), F.col("pk").alias("own_pk"), F.col("label").alias("own_label"))
    ids = [r["src"] for r in own.collect()]
    rows = step_edges(graph, (OUT, IN) if direction == 2 else (direction,), [relation] if relation else [], [], ids)
    # Few far ends are looked up by id; those of a hub are joined.
    met = few_ids(rows.select(F.col("dst").alias("id")).distinct())
    far = (graph.vertices if met is None else graph.vertices_of(met)).select(F.col("id").alias("dst"), F.col("pk").alias("far_pk"))
    return (
        rows.join(F.broadcast(own), "src")  # one row: keys are unique
        .join(far, "dst")
        .select("dir", F.when(F.col("dir") == OUT, F.format_string("%s:%s -> [%s] -> %s:%s", "own_pk", "own_label", "rel", "far_pk", "dst_label"))
                .otherwise(F.format_string("%s:%s -> [%s] -> %s:%s", "far_pk", "dst_label", "rel", "own_pk", "own_label")).alias("edge"))
    )


def common_neighbours(graph: PropertyGraph, pks: Sequence[str], relations: Sequence[str] = ()) -> DataFrame:
    """One row with the number of vertices that are neighbours, in either direction, of every vertex named.

    Fewer than two names give 0; a name given twice counts as a second name of
    the same set.
    """
    if len(pks) < 2:
        return constant_count(graph, 0)
    seeds = starts(graph, pks).select(F.col("id").alias("src"))
    rows = step_edges(graph, (OUT, IN), relations, [], [r["src"] for r in seeds.collect()]).select("src", "dst")
    shared = rows.groupBy("dst").agg(F.count_distinct("src").alias("n")).filter(F.col("n") == len(set(pks)))
    return one_count(shared, F.count("*"))
