"""Places and hand-overs that every executor can reach.

Executors come and go, so anything that outlives a stage is written to the
folder the cluster names in ``spark.checkpoint.dir``; nothing here touches a
machine-local path unless that setting is absent (tests, a laptop session).
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary, WeakSet

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, NumericType, StringType

#: Largest side that is broadcast, in bytes of its values and ROW_BYTES for each row.
MAX_BROADCAST, ROW_BYTES = 16 << 20, 16

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scopes: list[list[str]] = []
_broadcast: WeakSet[DataFrame] = WeakSet()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and all tasks run in this process."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vertexloom-"))
        found = sc.getCheckpointDir()
    return str(found)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scope:
    """The scratch tables of a step; ``keep`` writes one that outlives it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        out = materialize(df, name)
        self.kept.add(_paths[out])
        return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scope]:
    """Remove what is written to fresh paths inside the block when it ends, but for what the scope keeps."""
    scope, mine = Scope(spark), []
    _scopes.append(mine)
    try:
        yield scope
    finally:
        _scopes.pop()
        for path in mine:
            if path not in scope.kept:
                remove(spark, path)
            elif _scopes:
                _scopes[-1].append(path)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of written tables that nothing reads any more; others are left alone."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            remove(df.sparkSession, path)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    Cuts the lineage (a lost executor re-reads the table rather than redoing
    the plan) and gives the optimizer true sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST) -> DataFrame:
    """``df`` with a broadcast hint if its values take at most ``max_bytes``, else as it is.

    ``df`` must be cheap to scan (a written or literal table): rows and the
    bytes of all values are summed. Without the hint Spark joins by shuffle,
    and adaptive execution splits skewed keys.
    """
    size = F.lit(ROW_BYTES)
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType | BinaryType):
            size = size + F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(f.dataType, NumericType | BooleanType):
            size = size + 8
        else:
            size = size + F.coalesce(F.octet_length(value.cast("string")), F.lit(0))
    if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) > max_bytes:
        return df
    out = F.broadcast(df)
    _broadcast.add(out)
    return out


def is_broadcast(df: DataFrame) -> bool:
    """Whether ``broadcast_if_small`` gave the table its hint."""
    return df in _broadcast


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table is at a path."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True
