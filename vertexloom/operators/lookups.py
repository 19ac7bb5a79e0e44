"""Names, keys and ids; scans and adjacency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.model import PropertyGraph, UnknownName


def labels(graph: PropertyGraph) -> DataFrame:
    """All label names, of vertices and of edge rows."""
    return graph.vertices.select(F.col("label").alias("name")).union(graph.edges.select("dst_label")).distinct()


def relations(graph: PropertyGraph) -> DataFrame:
    """All relation names."""
    return graph.edges.select(F.col("rel").alias("name")).distinct()


def keys(spark: SparkSession, pks: Sequence[str]) -> DataFrame:
    """Rows (place, pk) for keys named in a request."""
    if not pks:
        return spark.createDataFrame([], "place long, pk string")
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(p) for p in pks])).alias("place", "pk")).withColumn("place", F.col("place").cast("long"))


def vertex_ids(graph: PropertyGraph, pks: Sequence[str]) -> DataFrame:
    """Rows (place, pk, id), in any order: a row for each key asked for, id null if there is no such vertex."""
    asked = keys(graph.spark, pks)
    found = graph.vertices_named(pks) if pks else graph.vertices.limit(0)
    return asked.join(found.select("pk", "id"), "pk", "left").select("place", "pk", "id")


def vertex_by_pk(graph: PropertyGraph, pk: str) -> DataFrame:
    """The vertex with a key: at most one row (id, pk, label)."""
    return graph.vertices_named([pk])


def vertex_by_id(graph: PropertyGraph, id_: int) -> DataFrame:
    """The vertex with an id: at most one row (id, pk, label)."""
    return graph.vertices_of([id_])


def adjacency(graph: PropertyGraph, pk: str, direction: int, relation: str | None = None) -> DataFrame:
    """Edge rows of a vertex in one direction, of one relation if given. The vertex's id is looked up first, so only its block is read."""
    rows = graph.edges_of([r["id"] for r in vertex_by_pk(graph, pk).collect()]).filter(F.col("dir") == direction)
    return rows if relation is None else rows.filter(F.col("rel") == relation)


def resolve(graph: PropertyGraph, vertices: Sequence[str] = (), label_names: Sequence[str] = (), relation_names: Sequence[str] = ()) -> None:
    """Raise UnknownName for any vertex, label or relation that the graph doesn't have."""
    for kind, asked, column in (
        ("vertex", vertices, lambda x: graph.vertices_named(x).select("pk")),
        ("label", label_names, lambda x: labels(graph).filter(F.col("name").isin(x))),
        ("relation", relation_names, lambda x: graph.edges.filter(F.col("rel").isin(x)).select("rel").distinct()),
    ):
        if asked:
            known = {r[0] for r in column(sorted(set(asked))).collect()}
            for name in asked:
                if name not in known:
                    raise UnknownName(f"no {kind} {name!r}")
