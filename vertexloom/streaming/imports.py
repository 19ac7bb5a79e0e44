"""Continuous import: edge-list files that arrive in a folder are merged into a store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vertexloom.model import EDGE_LIST
from vertexloom.operators.ingest import edge_list
from vertexloom.sources.store import GraphStore


def follow(spark: SparkSession, folder: str, store: GraphStore, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Merge Parquet edge lists that arrive in ``folder``, each with EDGE_LIST and an order column ``row_no``.

    Batches follow each other in the order of arrival, and a batch that is
    repeated after a failure leaves the graph as it was: merging is idempotent.
    """
    schema = "row_no long, " + ", ".join(f"{c} string" for c in EDGE_LIST)

    def merged(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.add(edge_list(batch, ["row_no"]))

    writer = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(merged).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
