"""The graph: vertices, directed edges stored from both ends, and what can go wrong."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, LongType, StringType, StructField, StructType

#: Values of the column ``dir``: an edge row seen from its start, or from its end.
OUT, IN = 0, 1

#: Columns of an edge list.
EDGE_LIST = ("start_pk", "start_label", "rel", "end_pk", "end_label")

RAW = StructType([StructField("row_no", LongType()), *(StructField(c, StringType()) for c in EDGE_LIST)])
VERTICES = StructType([StructField("id", LongType()), StructField("pk", StringType()), StructField("label", StringType())])
EDGES = StructType(
    [StructField("src", LongType()), StructField("dir", ByteType()), StructField("rel", StringType()), StructField("dst", LongType()), StructField("dst_label", StringType())]
)


class GraphError(ValueError):
    """A request or an input that the engine refuses."""


class UnknownName(GraphError):
    """A vertex, label or relation that the graph doesn't have."""


@dataclass(frozen=True)
class PropertyGraph:
    """``vertices`` (id, pk, label), one row per pk; ``edges`` (src, dir, rel, dst, dst_label), two rows per edge.

    A vertex's label is that of its first occurrence. An edge row has the label
    that its own input row gave the far end, which may differ from the vertex's.

    A stored graph also has ``by_pk``, the vertices in order of pk, and tables
    ``blocked`` of vertices and edges with their column ``block``, the vertex's
    (start's) id divided by ``block_size``, by which their files are parted. A
    graph just made from an edge list has ``named``: its edge rows with keys in
    place of ids (src_pk, dir, rel, dst_pk, dst_label), as the import had both.
    """

    vertices: DataFrame
    edges: DataFrame
    by_pk: DataFrame | None = None
    blocked: tuple[DataFrame, DataFrame] | None = None
    block_size: int = 0
    named: DataFrame | None = None

    @property
    def spark(self):
        return self.vertices.sparkSession

    def vertices_named(self, pks: Sequence[str]) -> DataFrame:
        """Vertices with the keys of a request; the files' order lets a scan skip the others."""
        return (self.vertices if self.by_pk is None else self.by_pk).filter(F.col("pk").isin(list(dict.fromkeys(pks))))

    def vertices_of(self, ids: Sequence[int]) -> DataFrame:
        """The vertices with a few ids: only their blocks are listed and read."""
        return self._of(0, "id", VERTICES, ids)

    def edges_of(self, ids: Sequence[int]) -> DataFrame:
        """The edge rows of a few vertices: only their blocks are listed and read."""
        return self._of(1, "src", EDGES, ids)

    def _of(self, table: int, column: str, schema: StructType, ids: Sequence[int]) -> DataFrame:
        own = F.col(column).isin(list(ids))
        if self.blocked is None:
            return (self.vertices, self.edges)[table].filter(own)
        blocks = sorted({i // self.block_size for i in ids})
        return self.blocked[table].filter(F.col("block").isin(blocks) & own).select(*schema.names)
