"""Edge lists to graphs: first label wins for a vertex, last row wins for an edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.index import dense_index
from vertexloom.functions.shared import materialize
from vertexloom.model import EDGE_LIST, EDGES, IN, OUT, PropertyGraph


def edge_list(df: DataFrame, order: list[str]) -> DataFrame:
    """A numbered edge list from any DataFrame with its five columns, in the order of the columns given."""
    return dense_index(df.select(*dict.fromkeys([*EDGE_LIST, *order])), order, "row_no").select("row_no", *EDGE_LIST)


def first_seen(raw: DataFrame) -> DataFrame:
    """Rows (pk, label, seen): each vertex with the label and place of its first occurrence; a row's start comes before its end."""
    ends = F.array(
        F.struct(F.col("start_pk").alias("pk"), F.col("start_label").alias("label"), (F.col("row_no") * 2).alias("seen")),
        F.struct(F.col("end_pk").alias("pk"), F.col("end_label").alias("label"), (F.col("row_no") * 2 + 1).alias("seen")),
    )
    met = raw.select(F.inline(ends))
    # Numbers alone can be kept per key by hashing; a struct would have all rows of a split sorted before they are shuffled.
    met = met.groupBy("pk", "label").agg(F.min("seen").alias("seen"))
    return met.groupBy("pk").agg(F.min(F.struct("seen", "label")).alias("first")).select("pk", "first.label", "first.seen")


def last_written(rows: DataFrame, *names: str) -> DataFrame:
    """Rows (src, dir, rel, dst, dst_label, seen) with ``names``: both views of each edge of rows (src, rel, dst, row_no, start_label, end_label), the last row's far label.

    The row that is last for one view is so for the other, hence they part only
    when it is found. ``names`` are columns of the start and the end, which
    change places in the second view.
    """
    kept = rows.groupBy("src", "rel", "dst", *names).agg(F.max(F.struct("row_no", "start_label", "end_label")).alias("last"))
    near, far = names[: len(names) // 2], names[len(names) // 2 :]

    def view(src: str, direction: int, dst: str, label: str, given: tuple[str, ...]) -> Column:
        return F.struct(
            F.col(src).alias("src"), F.lit(direction).cast("byte").alias("dir"), "rel", F.col(dst).alias("dst"), F.col(f"last.{label}").alias("dst_label"), F.col("last.row_no").alias("seen"),
            *(F.col(a).alias(b) for a, b in zip(given, names, strict=True)),
        )

    return kept.select(F.inline(F.array(view("src", OUT, "dst", "end_label", (*near, *far)), view("dst", IN, "src", "start_label", (*far, *near)))))


def build(raw: DataFrame) -> PropertyGraph:
    """A graph from a numbered edge list; nulls become empty strings."""
    return merge(None, raw)


def merge(graph: PropertyGraph | None, raw: DataFrame) -> PropertyGraph:
    """The graph with an edge list added: known vertices keep id and label, rows of known edges take the new far label."""
    raw = raw.fillna("", list(EDGE_LIST))
    met, start = first_seen(raw), 0
    if graph:
        last = graph.vertices.agg(F.max("id")).first()[0]
        start = 0 if last is None else last + 1
        met = met.join(graph.vertices.select("pk"), "pk", "left_anti")
    new = dense_index(met, ["seen"], "id", start).select("id", "pk", "label")
    vertices = materialize(graph.vertices.unionByName(new), "vertices") if graph else new
    ids = vertices.select("id", "pk")
    # Ids take the place of keys in the rows as they came; each row is joined once for both views.
    rows = (
        raw.join(ids.select(F.col("pk").alias("start_pk"), F.col("id").alias("src")), "start_pk")
        .join(ids.select(F.col("pk").alias("end_pk"), F.col("id").alias("dst")), "end_pk")
    )
    if not graph:
        named = last_written(rows.withColumnsRenamed({"start_pk": "src_pk", "end_pk": "dst_pk"}), "src_pk", "dst_pk")
        return PropertyGraph(vertices, last_written(rows).select(*EDGES.names), named=named.select("src_pk", "dir", "rel", "dst_pk", "dst_label"))
    edges = graph.edges.withColumn("seen", F.lit(-1).cast("long")).unionByName(last_written(rows))
    edges = edges.groupBy("src", "dir", "rel", "dst").agg(F.max(F.struct("seen", "dst_label")).alias("last")).select("src", "dir", "rel", "dst", "last.dst_label")
    return PropertyGraph(vertices, edges)
