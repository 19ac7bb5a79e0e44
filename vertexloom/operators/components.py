"""Connected components by contraction.

Each round ties every node to the first node among itself and its neighbours,
by value in even rounds and by a hash in odd ones, and puts that node in its
place in all edges. Edges within a node that came of it go, repeated ones are
merged, so edges and nodes shrink by a factor from round to round, whatever
the order of the nodes, and all rounds together cost little more than the
first. A round is one aggregation with partial sums on the map side and two
joins against one row per node, whose skewed keys adaptive execution splits;
its tables are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.shared import discard, materialize

MAX_ROUNDS = 100


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of ``edges``, rows (a, b) of any one orderable type.

    ``component`` is the smallest node of the component. Self-loops, repeated
    edges, both directions and nulls may occur: an edge with a null end is
    ignored, and a node that only has self-loops gets no row.
    """
    pairs = materialize(edges.select("a", "b"), "components")
    rounds = list(_rounds(pairs))
    discard(pairs)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    found = rounds.pop()
    while rounds:
        up, found = found, rounds.pop()
        above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
        found = materialize(found.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "components")
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")


def component_count(edges: DataFrame) -> tuple[int, DataFrame | None]:
    """The number of components among the nodes of ``edges`` (a, b), as above, and a table (node) of these; edges must be cheap to read twice.

    A component is done in the round that leaves one node of it, which is in
    no edge of the next round, so the rounds' numbers of nodes give the count.
    """
    done, nodes = 0, None
    for found in _rounds(edges):
        before = found.count()
        done += found.select("root").distinct().count() - (0 if nodes is None else before)
        nodes = found.select("node") if nodes is None else nodes
    return done, nodes


def _rounds(edges: DataFrame) -> Iterator[DataFrame]:
    """Written tables (node, root) of the rounds: each node with edges, and the one that takes its place."""
    edges = edges.filter(F.col("a") != F.col("b")).select("a", "b")
    last = None
    for i in range(MAX_ROUNDS):
        found = materialize(_tied(edges, i), "components")
        if found.isEmpty():
            discard(found, *([last] if last else []))
            return
        yield found
        edges = materialize(_contracted(edges, found), "components")
        if last:
            discard(last)
        last = edges
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _tied(edges: DataFrame, i: int) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))))
    if i % 2 == 0:
        return both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root"))
    rank = F.xxhash64("near", F.lit(i))
    first = both.groupBy("node").agg(F.min_by("near", rank).alias("near"), F.min(rank).alias("rank"))
    return first.select("node", F.when(F.col("rank") < F.xxhash64("node", F.lit(i)), F.col("near")).otherwise(F.col("node")).alias("root"))


def _contracted(edges: DataFrame, found: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        edges = edges.join(found.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
    apart = edges.filter(F.col("a_root") != F.col("b_root"))
    return apart.select(F.greatest("a_root", "b_root").alias("a"), F.least("a_root", "b_root").alias("b")).distinct()
