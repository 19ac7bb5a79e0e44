"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit for each bit of 64-bit shingle hashes, set if it is set
in over half of them. Bit ``i`` is assigned a non-zero vector of ``radius + 1``
bits; for each non-zero vector ``v`` a mask holds the bits whose vectors have
an odd product with ``v``. Any ``radius`` differing bits leave a ``v`` that is
even with all of them, so two fingerprints within the radius agree on some
mask: every such pair collides in one of the 15 tables (at radius 3), none is
missed.

Equal fingerprints are one class. Buckets of two classes are decided by one
comparison in the JVM, buckets up to ``FULL`` classes by comparing them with
each other in memory, giving a forest and not all pairs. Larger buckets are
covered again over the bits that their mask leaves free; that is as exact, and
as each level fixes over half of the free bits and classes are distinct, three
levels leave 8 free bits and so at most 256 classes to a bucket.

Defined cases: a null or empty text has the fingerprint zero and is linked
like any other; a text of one or two words is its own only shingle; equal rows
share a class; a null id never names a component unless all its ids are null;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.arrow import slices, with_columns
from vertexloom.functions.shared import broadcast_if_small, materialize
from vertexloom.llm.rows import located, without
from vertexloom.llm.sharding import lookup
from vertexloom.operators.components import connected_components

#: The contract's: differing bits of a link, words of a shingle.
RADIUS, WIDTH = 3, 3
BITS = 64
SEED = 42
#: Largest bucket whose members are compared with each other in memory.
FULL = 1024
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = WIDTH) -> bytes:
    """The fingerprint of a text, 8 bytes: A-Z lower-cased, words joined by spaces, shingles of ``width`` words."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    if len(words) <= width:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles])
    each, count = np.frombuffer(hashes, np.uint8).reshape(-1, 8), np.zeros(BITS, np.int64)
    for at in range(0, len(each), CHUNK):
        count += np.unpackbits(each[at : at + CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(each)).tobytes()


def fingerprints(docs: DataFrame, keep: list[str], width: int = WIDTH) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as a signed long."""
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [int.from_bytes(fingerprint(t, width), "big", signed=True) for t in batch.column("text").to_pylist()]
            yield with_columns(batch, keep, fp=pa.array(fps, pa.int64()))

    return docs.select(*keep, "text").mapInArrow(printed, ", ".join([*fields, "fp long"]))


def cover(fixed: int, radius: int = RADIUS) -> list[int]:
    """Masks that contain ``fixed`` and cover the other bits: one for each non-zero vector of ``radius + 1`` bits."""
    free = [i for i in range(BITS) if not fixed >> i & 1]
    vectors = (1 << radius + 1) - 1
    return [fixed | sum(1 << b for n, b in enumerate(free) if (1 + n % vectors & v).bit_count() & 1) for v in range(1, vectors + 1)]


def links(classes: DataFrame, full: int = FULL, radius: int = RADIUS) -> DataFrame:
    """Rows (a, b) of fingerprints whose connected components are those of all links within the radius.

    ``classes``: distinct rows (fp), cheap to scan.
    """
    masks, rows, found = [0], classes.select("fp", F.lit(0).alias("bucket")), []
    for _ in range(4):
        masks = [m for fixed in masks for m in cover(fixed, radius)]
        keyed = _keyed(rows, masks, radius)
        buckets = materialize(
            keyed.groupBy("bucket", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"),
            "simhash-buckets",
        )
        found.append(buckets.filter((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b"))
        found.append(_within(keyed, buckets.filter(F.col("n").between(3, full)), radius))
        large = buckets.filter(F.col("n") > full)
        if large.isEmpty():
            break
        rows = materialize(_members(keyed, large), "simhash-large")
    else:
        raise AssertionError("buckets of distinct fingerprints stay large although few bits are free")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _keyed(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Each row once for each of the masks below its bucket, with the bits that the mask holds."""
    fan = (1 << radius + 1) - 1
    table = [m - (1 << 64) if m >> 63 else m for m in masks]
    below = rows.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(fan - 1)), lambda i: F.col("bucket") * fan + i)).alias("bucket"))
    return below.withColumn("key", F.col("fp").bitwiseAND(lookup(table, F.col("bucket"), "bigint")))


def _members(keyed: DataFrame, buckets: DataFrame) -> DataFrame:
    own = broadcast_if_small(buckets.select("bucket", "key"))
    return keyed.join(own, ["bucket", "key"], "left_semi").select("fp", "bucket")


def _within(keyed: DataFrame, buckets: DataFrame, radius: int) -> DataFrame:
    own = broadcast_if_small(buckets.select("bucket", "key"))
    lists = keyed.join(own, ["bucket", "key"], "left_semi").groupBy("bucket", "key").agg(F.collect_list("fp").alias("fps"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            a, b = [], []
            for fps in batch.column("fps"):
                low, high = forest(fps.values.to_numpy(), radius)
                a.append(low)
                b.append(high)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return lists.select("fps").mapInArrow(linked, "a long, b long")


def forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For the members of a bucket that have links there, the first member of their component and themselves."""
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= radius
    root = np.arange(len(fps))
    while True:
        new = np.where(near, root[None, :], len(fps)).min(axis=1)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(fps)))
    return fps[root[own]], fps[own]


def class_components(prints: DataFrame, rep: Column, full: int = FULL, radius: int = RADIUS) -> DataFrame:
    """Rows (fp, rep): for each fingerprint of the written table ``prints`` the least ``rep`` of its component."""
    classes = materialize(prints.groupBy("fp").agg(F.min(rep).alias("rep")), "simhash-classes")
    tied = connected_components(links(classes.select("fp"), full, radius))
    tied = materialize(tied.join(classes, tied["node"] == classes["fp"]).select("fp", "component", "rep"), "simhash-tied")
    least = tied.groupBy("component").agg(F.min("rep").alias("least"))
    named = tied.select("fp", "component").join(least, "component").select("fp", "least")
    return materialize(classes.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("rep")), "simhash-named")


def near_duplicates(docs: DataFrame, width: int = WIDTH, full: int = FULL, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links)."""
    prints = materialize(fingerprints(docs, ["doc_id"], width), "simhash-prints")
    named = class_components(prints, F.col("doc_id"), full, radius)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("rep").alias("component_id"))


def dropped_rows(rows: DataFrame, width: int = WIDTH, full: int = FULL, radius: int = RADIUS) -> DataFrame:
    """Locators of the located rows that go when one row of each component, the one with the least doc_id, stays.

    Rows of one id are told apart by their locators.
    """
    narrow = rows.select("d.doc_id", "d.text", "_file", "_row")
    prints = materialize(fingerprints(narrow, ["doc_id", "_file", "_row"], width), "simhash-prints")
    # Nulls come last: an id is preferred to none.
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_file", "_row")
    named = class_components(prints, own, full, radius)
    gone = prints.join(named, "fp").filter((F.col("rep._file") != F.col("_file")) | (F.col("rep._row") != F.col("_row")))
    return materialize(gone.select("_file", "_row"), "simhash-dropped")


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component; all columns stay."""
    rows = located(docs)
    return without(rows, dropped_rows(rows, width, radius=radius))
