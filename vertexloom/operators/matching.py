"""Counting homomorphisms of a pattern by summing its variables out one by one.

A pattern edge is a relation of different pairs with weight 1. To sum a
variable out, the relations that hold it are joined on what they share, any
other relation that lies within the joined variables is joined as well, which
closes cycles early, and weights are multiplied and summed over what is left.
Trees thus never have their matches written out, parts without connection
multiply, and only cycles need wider joins. When only cycles are left, the
relations are cut down to the pairs that the others can go on from and written,
and each variable to go is the one whose join is smallest by measured degrees;
what is left of its join is written and measured again.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.idsets import among, id_bits
from vertexloom.functions.shared import materialize
from vertexloom.model import IN, OUT, PropertyGraph
from vertexloom.operators.steps import constant_count
from vertexloom.plans.patterns import Pattern, PatternEdge

WEIGHT = "decimal(38,0)"


def match_count(graph: PropertyGraph, pattern: Pattern) -> DataFrame:
    """One row with the number of mappings of variables to vertices that satisfy the pattern.

    Different variables may map to one vertex. A pattern edge asks for some
    edge of a listed relation; a pattern edge from a variable to itself asks
    for a self-loop.
    """
    if pattern.empty():
        return constant_count(graph, 0)
    if not pattern.nodes:
        return constant_count(graph, 1)
    wanted = sorted({x for names in pattern.nodes.values() for x in names})
    per_label = {r["label"]: r["count"] for r in graph.vertices.filter(F.col("label").isin(wanted)).groupBy("label").count().collect()}
    sizes = {v: sum(per_label.get(x, 0) for x in set(names)) for v, names in pattern.nodes.items()}
    labels = {v: frozenset(names) for v, names in pattern.nodes.items() if any(v in (e.source, e.target) for e in pattern.edges)}
    bits = {names: id_bits(graph.vertices.filter(F.col("label").isin(list(names)))) for names in set(labels.values())}
    factors = [_relation(graph, pattern, e, {v: bits[names] for v, names in labels.items()}) for e in pattern.edges]
    held = {v for e in pattern.edges for v in (e.source, e.target)}
    total = 1
    for v in pattern.nodes:
        if v not in held:
            total *= sizes[v]
    if total == 0:
        return constant_count(graph, 0)
    written: list[DataFrame] = []
    rows: dict[str, float] = {}
    while held:
        around = {v: {c for f in factors if v in f.columns for c in f.columns} - {v, "w"} for v in held}
        fewest = min(map(len, around.values()))
        if fewest >= 2:
            if not written:
                factors = _reduced(factors)
            factors = [f if any(f is g for g in written) else materialize(f, "match-relation") for f in factors]
            written = factors
            for v in held:
                if v not in rows:
                    rows[v] = _joined_rows(factors, v)
            best = min(held, key=lambda v: (len(around[v]), rows[v], v))
        else:
            # Fewest neighbours first, then most candidates, so that small sides stay.
            best = min(held, key=lambda v: (len(around[v]), -sizes[v], v))
        factors = _without(factors, best)
        held = held - {best}
        rows = {v: n for v, n in rows.items() if v not in around[best]}
    weights = [f.select("w") for f in factors]
    product = reduce(lambda a, b: a * b, [F.coalesce(F.col(f"w{i}"), F.lit(0)).cast(WEIGHT) for i in range(len(weights))], F.lit(total).cast(WEIGHT))
    # Each is the one row of a part of the pattern.
    rows = graph.spark.range(1).select(F.lit(1).alias("one"))
    for i, w in enumerate(weights):
        rows = rows.join(F.broadcast(w.agg(F.sum("w").alias(f"w{i}")).withColumn("one", F.lit(1))), "one")
    return rows.select(product.cast("long").alias("count"))


def _relation(graph: PropertyGraph, pattern: Pattern, edge: PatternEdge, candidates: Mapping[str, DataFrame]) -> DataFrame:
    """Different pairs of a pattern edge between candidates, as columns named by its variables, and w."""
    direction = OUT if edge.direction == "OUT" else IN
    rows = graph.edges.filter((F.col("dir") == direction) & F.col("rel").isin(list(set(edge.relations)))).select("src", "dst")
    for end, var in (("src", edge.source), ("dst", edge.target)):
        rows = among(rows, end, graph.vertices.filter(F.col("label").isin(list(set(pattern.nodes[var])))).select("id"), candidates[var])
    if edge.source == edge.target:
        rows = rows.filter(F.col("src") == F.col("dst")).select(F.col("src").alias(edge.source))
    else:
        rows = rows.select(F.col("src").alias(edge.source), F.col("dst").alias(edge.target))
    if len(set(edge.relations)) > 1:
        rows = rows.distinct()  # of one relation a pair has one edge row
    return rows.withColumn("w", F.lit(1).cast(WEIGHT))


def _reduced(factors: list[DataFrame]) -> list[DataFrame]:
    """The relations without rows that find no partner in another that shares a variable; each is written first."""
    factors = [materialize(f, "match-relation") for f in factors]
    met = {(i, c): f.select(F.col(c).alias("id")) for i, f in enumerate(factors) for c in f.columns if c != "w"}
    bits = {k: id_bits(ids) for k, ids in met.items()}
    out = []
    for i, f in enumerate(factors):
        for j, g in enumerate(factors):
            if f.columns != g.columns:
                for c in f.columns:
                    if (j, c) in met and i != j:
                        f = among(f, c, met[j, c], bits[j, c])
        out.append(f)
    return out


def _joined_rows(factors: list[DataFrame], var: str) -> float:
    """How many rows the join of a variable's relations has at most: the sum of products of its degrees."""
    degrees = [f.groupBy(var).agg(F.count("*").alias(f"n{i}")) for i, f in enumerate(factors) if var in f.columns]
    joined = reduce(lambda a, b: a.join(b, var), degrees)
    product = reduce(lambda a, b: a * b, [F.col(c).cast("double") for c in joined.columns if c != var])
    return joined.agg(F.sum(product)).first()[0] or 0.0


def _without(factors: list[DataFrame], var: str) -> list[DataFrame]:
    """The relations after a variable is summed out."""
    own = sorted((f for f in factors if var in f.columns), key=lambda f: len(f.columns))
    rest = [f for f in factors if var not in f.columns]
    joined = own[0]
    for f in own[1:]:
        joined = _join(joined, f)
    inside = [f for f in rest if len(f.columns) > 1 and set(f.columns) <= set(joined.columns)]
    for f in inside:
        joined = _join(joined, f)
    keys = [c for c in joined.columns if c not in (var, "w")]
    summed = joined.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.sum("w").cast(WEIGHT).alias("w")) if keys else joined.agg(F.sum("w").cast(WEIGHT).alias("w"))
    return [f for f in rest if not any(f is g for g in inside)] + [summed]


def _join(a: DataFrame, b: DataFrame) -> DataFrame:
    shared = [c for c in a.columns if c in b.columns and c != "w"]
    out = a.withColumnRenamed("w", "_w").join(b, shared)
    return out.withColumn("w", (F.col("w") * F.col("_w")).cast(WEIGHT)).drop("_w")
