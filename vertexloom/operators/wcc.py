"""Weakly connected components under label and relation filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.idsets import among
from vertexloom.functions.shared import materialize
from vertexloom.model import OUT, PropertyGraph
from vertexloom.operators.components import component_count, connected_components
from vertexloom.operators.steps import one_count, passes, step_edges


def weak_components(graph: PropertyGraph, relations: Sequence[str] = (), labels: Sequence[str] = ()) -> DataFrame:
    """Rows (id, component), component being the least id.

    Active are vertices with a listed label and the far ends of qualifying
    edges: outgoing, from a vertex with a listed label, of a listed relation,
    with a listed label in the edge row, and no self-loop. A far end is active
    by the edge row's label, whatever its own.
    """
    own, edges = _active(graph, relations, labels)
    tied = connected_components(edges)
    alone = own.join(tied, own["id"] == tied["node"], "left_anti")
    return tied.select(F.col("node").alias("id"), "component").unionByName(alone.select("id", F.col("id").alias("component")))


def weak_component_count(graph: PropertyGraph, relations: Sequence[str] = (), labels: Sequence[str] = ()) -> DataFrame:
    """One row with the number of components; nobody is given a component for it."""
    own, edges = _active(graph, relations, labels)
    if graph.blocked is None:
        edges = materialize(edges, "components")
    tied, nodes = component_count(edges)
    alone = own if nodes is None else own.join(nodes, own["id"] == nodes["node"], "left_anti")
    return one_count(alone, F.count("*") + F.lit(tied), "component_count")


def _active(graph: PropertyGraph, relations: Sequence[str], labels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Vertices (id) with a listed label, and qualifying edges (a, b)."""
    own = graph.vertices.filter(passes("label", labels)).select("id")
    edges = step_edges(graph, (OUT,), relations, labels).filter(F.col("src") != F.col("dst")).select("src", "dst")
    if labels:
        edges = among(edges, "src", own)
    return own, edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
