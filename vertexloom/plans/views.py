"""Edge lists over relational tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.index import dense_index
from vertexloom.functions.shared import scratch_path
from vertexloom.model import EDGE_LIST, PropertyGraph
from vertexloom.sources.store import GraphStore


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event ties its user to the user of the next event: dense, with self-loops, duplicates and labels that disagree.

    The next event is found by a join on dense places, not by a window over all events.
    """
    events = dense_index(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type"), ["event_id"], "place")
    after = events.select((F.col("place") - 1).alias("place"), F.col("user_id").alias("next_user"))
    return events.join(after, "place").select(
        F.col("event_id").alias("row_no"),
        F.concat(F.lit("u"), "user_id").alias("start_pk"),
        F.concat(F.lit("L"), (F.col("user_id") % 3).cast("string")).alias("start_label"),
        F.col("event_type").alias("rel"),
        F.concat(F.lit("u"), "next_user").alias("end_pk"),
        F.concat(F.lit("L"), (F.col("event_id") % 3).cast("string")).alias("end_label"),
    )


def order_edges(spark: SparkSession, sf_dir: str, quantity: int | None = None) -> DataFrame:
    """Orders tied to the parts of their lines: all lines, with hubs and a giant component, or large ones only, sparse and with many components."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if quantity is not None:
        lines = lines.filter(F.col("l_quantity") >= quantity)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return dense_index(lines.select(*order, "l_returnflag"), order, "row_no", 1, ("l_suppkey", "l_extendedprice")).select(
        "row_no",
        F.concat(F.lit("o"), "l_orderkey").alias("start_pk"),
        F.concat(F.lit("O"), (F.col("l_orderkey") % 3).cast("string")).alias("start_label"),
        F.col("l_returnflag").alias("rel"),
        F.concat(F.lit("p"), "l_partkey").alias("end_pk"),
        F.concat(F.lit("P"), (F.col("l_linenumber") % 3).cast("string")).alias("end_label"),
    )


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema as a graph: customers PLACED orders that CONTAIN parts, suppliers SUPPLY parts, all live in nations IN regions."""
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def tie(df: DataFrame, a: str, a_key: str, a_label: str, rel: str, b: str, b_key: str, b_label: str) -> DataFrame:
        return df.select(
            F.concat(F.lit(a), F.col(a_key)).alias("start_pk"), F.lit(a_label).alias("start_label"), F.lit(rel).alias("rel"), F.concat(F.lit(b), F.col(b_key)).alias("end_pk"), F.lit(b_label).alias("end_label")
        )

    lines = read("lineitem")
    rows = [
        tie(read("orders"), "c:", "o_custkey", "Customer", "PLACED", "o:", "o_orderkey", "Order"),
        tie(lines, "o:", "l_orderkey", "Order", "CONTAINS", "p:", "l_partkey", "Part"),
        tie(lines, "s:", "l_suppkey", "Supplier", "SUPPLIES", "p:", "l_partkey", "Part"),
        tie(read("customer"), "c:", "c_custkey", "Customer", "LIVES_IN", "n:", "c_nationkey", "Nation"),
        tie(read("supplier"), "s:", "s_suppkey", "Supplier", "BASED_IN", "n:", "s_nationkey", "Nation"),
        tie(read("nation"), "n:", "n_nationkey", "Nation", "IN_REGION", "r:", "n_regionkey", "Region"),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return dense_index(out, list(EDGE_LIST), "row_no")


VIEWS = {
    "events": event_edges,
    "orders": order_edges,
    "orders50": lambda spark, sf_dir: order_edges(spark, sf_dir, 50),
    "orders48": lambda spark, sf_dir: order_edges(spark, sf_dir, 48),
    "star": star_edges,
}

_stored: dict[tuple[str, str, str], GraphStore] = {}


def stored_graph(spark: SparkSession, sf_dir: str, view: str) -> PropertyGraph:
    """The graph of a view, imported once per application into the shared folder and opened from there."""
    key = (spark.sparkContext.applicationId, sf_dir, view)
    if key not in _stored:
        store = GraphStore(spark, scratch_path(spark, f"graph-{view}"))
        store.add(VIEWS[view](spark, sf_dir))
        _stored[key] = store
    return _stored[key].open()
