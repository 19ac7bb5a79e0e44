"""Graphs as versioned Parquet tables.

A version is written whole and then entered in the table of commits; readers
open the newest version entered, so a failed import leaves no trace, and a
reader keeps its snapshot while a new version is written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from vertexloom.model import EDGES, VERTICES, GraphError, PropertyGraph
from vertexloom.operators.ingest import merge

#: Ids of a block at least, and blocks at most.
BLOCK, MAX_BLOCKS = 1 << 14, 4096


class GraphStore:
    """A folder with ``vertices``, ``keys`` and ``edges`` by version, and ``commits``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int | None:
        """The newest version, None before the first."""
        try:
            return self.spark.read.schema("version int").parquet(f"{self.path}/commits").agg(F.max("version")).first()[0]
        except AnalysisException:
            return None

    def save(self, graph: PropertyGraph) -> int:
        """Write a new version.

        Vertices are written by id and by pk, edges by start, each in ranges of
        rows, so that a hub's edges are spread over tasks and files. Ids are
        dense; a block is a run of ``BLOCK`` of them, longer where that made
        more than ``MAX_BLOCKS``.
        """
        new = (self.version() or 0) + 1
        vertices = graph.vertices.select(*VERTICES.names)
        size = max(BLOCK, -(-vertices.count() // MAX_BLOCKS))
        vertices.repartitionByRange("pk").sortWithinPartitions("pk").write.mode("overwrite").parquet(f"{self.path}/keys/v{new}")
        block = F.floor(F.col("id") / size).cast("int").alias("block")
        vertices.select("*", block).repartitionByRange("block", "id").sortWithinPartitions("block", "id").write.mode("overwrite").partitionBy("block").parquet(f"{self.path}/vertices/v{new}")
        block = F.floor(F.col("src") / size).cast("int").alias("block")
        order = ("dir", "block", "src", "rel", "dst")
        edges = graph.edges.select(*EDGES.names, block).repartitionByRange(*order).sortWithinPartitions(*order)
        edges.write.mode("overwrite").partitionBy("dir", "block").parquet(f"{self.path}/edges/v{new}")
        self.spark.range(1).select(F.lit(new).alias("version"), F.lit(size).cast("long").alias("block_size")).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return new

    def open(self, version: int | None = None) -> PropertyGraph:
        """The newest version, or the one asked for."""
        version = version or self.version()
        if version is None:
            raise GraphError(f"no graph at {self.path}")
        read = self.spark.read
        size = read.schema("version int, block_size long").parquet(f"{self.path}/commits").filter(F.col("version") == version).agg(F.max("block_size")).first()[0]
        if size is None:
            raise GraphError(f"no version {version} at {self.path}")
        vertices, edges = (self.spark.read.schema(StructType([*s.fields, StructField("block", IntegerType())])).parquet(f"{self.path}/{n}/v{version}") for n, s in (("vertices", VERTICES), ("edges", EDGES)))
        keys = self.spark.read.schema(VERTICES).parquet(f"{self.path}/keys/v{version}")
        return PropertyGraph(vertices.select(*VERTICES.names), edges.select(*EDGES.names), keys, (vertices, edges), size)

    def add(self, raw: DataFrame) -> PropertyGraph:
        """Merge a numbered edge list into the newest version, save that as the next, and open it."""
        self.save(merge(self.open() if self.version() else None, raw))
        return self.open()
