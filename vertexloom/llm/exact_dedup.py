"""Exact deduplication with streaming keyed state.

Rows arrive as narrow records: digest of the normalised text, id, and a
locator of the content, file and place in it. A streaming aggregation keyed by
digest keeps, without expiry and on disk (RocksDB, checkpointed to the shared
folder), the row that stays and the number of rows seen. On hits, digests that
a call meets again or more than once, full bytes are checked before the call
decides anything: the rows of such digests are fetched by their locators, and
the least and greatest text of each digest must agree. Where they do not, the
digest has collided and its rows are grouped by digest and text instead.

With a ``state`` folder the state outlives the call: a later call brings new
documents only, which are held against all that came before, and a row that
came before (same file and place) is not counted again. Fetching needs the
files that came before to be still there when their digests are hit.

Texts are equal when identical after lower-casing A-Z; the row with the
largest doc_id stays. Defined cases: null counts as empty text; a null id is
smaller than any other; of rows with equal text and id the one with the
greatest locator stays; repeated rows count one by one, from whatever frame
(see ``located``); extra columns are kept or ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vertexloom.functions.arrow import slices, with_columns
from vertexloom.functions.shared import broadcast_if_small, exists, materialize, scratch_path
from vertexloom.llm.rows import located, without

#: State is on disk; a task closes its store when it has committed, so open stores don't add up in an executor's memory and disk.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
FILES_PER_TRIGGER = 1000


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def arrivals(rows: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """Rows (doc_id, _file, _row, digest, sha256) of located rows. The digest is the start of the SHA-256."""
    keep, docs = ["doc_id", "_file", "_row"], rows.select("d.doc_id", "d.text", "_file", "_row")
    fields = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            shas = [hashlib.sha256((t or b"").lower()).digest() for t in texts]
            yield with_columns(batch, keep, digest=pa.array([s[:digest_bytes] for s in shas], pa.binary()), sha256=pa.array(shas, pa.binary()))

    return docs.select(*keep, "text").mapInArrow(digested, ", ".join([*fields, "digest binary, sha256 binary"]))


def _own() -> Column:
    return F.struct("doc_id", "_file", "_row")


def run_stream(spark: SparkSession, path: str, checkpoint: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Bring the state in ``checkpoint`` up to date with the arrivals in ``path``; rows (digest, keep, group_size).

    A later call with the same checkpoint takes in only files that are new.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())  # the settings are for the stream alone
    for k, v in STATE_SETTINGS.items():
        own.conf.set(k, v)
    schema = spark.read.parquet(path).schema
    rows = own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    state = rows.groupBy("digest").agg(F.max(_own()).alias("keep"), F.count("*").alias("group_size"))
    query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    held = own.read.format("statestore").load(checkpoint)
    value = held.schema["value"].dataType.fields
    keep, size = (next(f.name for f in value if test(f)) for test in (lambda f: isinstance(f.dataType, StructType), lambda f: f.dataType.simpleString() == "bigint"))
    return held.select("key.digest", F.col(f"value.`{keep}`").alias("keep"), F.col(f"value.`{size}`").alias("group_size"))


def decide(docs: DataFrame, digest_bytes: int = 32, files_per_trigger: int = FILES_PER_TRIGGER, state: str | None = None) -> DataFrame:
    """One row per located row: doc_id, _file, _row, sha256, keep (of the row that stays), group_size."""
    spark = docs.sparkSession
    home = state.rstrip("/") if state else scratch_path(spark, "dedup-state")
    wave = 0
    while exists(spark, f"{home}/files/wave={wave}"):
        wave += 1
    names = docs.groupBy("_file").agg(F.min("_path").alias("path"), (F.min("_path") != F.max("_path")).alias("clash"))
    if wave:
        rows = materialize(arrivals(docs, digest_bytes), "dedup-call")
        new = rows.join(spark.read.parquet(f"{home}/arrivals").select("_file", "_row"), ["_file", "_row"], "left_anti")
    else:
        rows, new = None, arrivals(docs, digest_bytes)
    new.write.mode("overwrite").parquet(f"{home}/arrivals/wave={wave}")
    names.write.mode("overwrite").parquet(f"{home}/files/wave={wave}")
    files = spark.read.parquet(f"{home}/files").groupBy("_file").agg(F.min("path").alias("path"), (F.max("clash") | (F.min("path") != F.max("path"))).alias("clash"))
    if not files.filter("clash").isEmpty():
        raise ValueError("two files have one hash: rename one of them")
    seen = spark.read.parquet(f"{home}/arrivals")
    rows = seen if rows is None else rows
    groups = materialize(run_stream(spark, f"{home}/arrivals", f"{home}/checkpoint", files_per_trigger), "dedup-groups")
    hits = groups.filter("group_size > 1").select("digest")
    if wave:
        hits = materialize(hits.join(rows.select("digest"), "digest", "left_semi"), "dedup-hit-digests")
    met = materialize(seen.join(broadcast_if_small(hits), "digest", "left_semi"), "dedup-hits")
    collided = _collided(docs, rows, met, files, earlier=wave > 0)
    out = ["doc_id", "_file", "_row", "sha256", "keep", "group_size"]
    decided = rows.join(groups, "digest")
    if collided is not None:
        decided = decided.join(broadcast_if_small(collided.select("digest").distinct()), "digest", "left_anti")
        exact = collided.groupBy("digest", "_text").agg(F.max(_own()).alias("keep"), F.count("*").alias("group_size"))
        apart = collided.join(exact, ["digest", "_text"]).select("_file", "_row", "keep", "group_size")
        decided = decided.select(*out).unionByName(rows.join(apart, ["_file", "_row"]).select(*out))
    return decided.select(*out)


def _collided(docs: DataFrame, rows: DataFrame, met: DataFrame, files: DataFrame, earlier: bool) -> DataFrame | None:
    """Rows whose digest is shared by different texts, with ``_text``; None without any. All bytes of the rows ``met`` are compared."""
    spark = docs.sparkSession
    where = broadcast_if_small(met.select("_file", "_row", "digest"))
    texts = docs.select("d.doc_id", "_file", "_row", normalised(F.col("d.text")).alias("_text")).join(where, ["_file", "_row"])
    if earlier:
        old = materialize(met.join(rows.select("_file", "_row"), ["_file", "_row"], "left_anti"), "dedup-old-hits")
        paths = [r["path"] for r in files.join(old.select("_file").distinct(), "_file").select("path").collect()]
        if paths:  # only the files that hold such rows are read
            at = located(spark.read.schema(docs.schema["d"].dataType).parquet(*paths))
            found = at.join(broadcast_if_small(old.select("_file", "_row", "digest")), ["_file", "_row"])
            texts = texts.unionByName(found.select("_file", "_row", "d.doc_id", normalised(F.col("d.text")).alias("_text"), "digest"))
    ends = texts.groupBy("digest").agg(F.min("_text").alias("first"), F.max("_text").alias("last"))
    different = materialize(ends.filter(F.col("first") != F.col("last")).select("digest"), "dedup-collided")
    if different.isEmpty():
        return None
    return materialize(texts.join(broadcast_if_small(different), "digest", "left_semi"), "dedup-exact")


def exact_duplicates(docs: DataFrame, digest_bytes: int = 32, files_per_trigger: int = FILES_PER_TRIGGER, state: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; groups take in all that the state has seen."""
    rows = decide(_located(docs, state), digest_bytes, files_per_trigger, state)
    return rows.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", _stays().alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, state: str | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, none of it if an earlier call has seen the one that stays; all columns stay."""
    rows = _located(docs, state)
    gone = decide(rows, state=state).filter(~_stays()).select("_file", "_row")
    return without(rows, materialize(gone, "dedup-dropped"))


def _stays() -> Column:
    return (F.col("keep._file") == F.col("_file")) & (F.col("keep._row") == F.col("_row"))


def _located(docs: DataFrame, state: str | None) -> DataFrame:
    """Rows that have to be written for their locators are kept beside the state."""
    return located(docs, state and f"{state.rstrip('/')}/texts/{uuid.uuid4().hex}")
