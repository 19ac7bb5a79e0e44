"""A stable locator for every row of a table of files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.shared import broadcast_if_small, materialize

#: What may stand over a table of files so that each of its rows is met once at most, and the same ones in each scan.
STRAIGHT = {"LogicalRelation", "Project", "Filter", "SubqueryAlias"}


def straight(docs: DataFrame) -> bool:
    """Whether the rows are those of files, each once at most: a deterministic filter or projection of one scan of different files."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in STRAIGHT and plan.children().size() == 1:
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation" or plan.isStreaming():
        return False
    roots = plan.relation().location().rootPaths()
    paths = sorted(roots.apply(i).toString().rstrip("/") for i in range(roots.size()))
    return not any(b == a or b.startswith(a + "/") for a, b in zip(paths, paths[1:], strict=False))


def located(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (d, _path, _file, _row): ``d`` holds all columns, whatever their names, ``_path`` is the file, ``_file`` its 64-bit hash, ``_row`` the row's place in it.

    File and place name a row's content for good. Frames whose rows may come
    from one place more than once (joined, exploded, sampled or united ones)
    or not from files at all are written first, to ``path`` or else to the
    shared folder.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d")
    try:
        if straight(docs):
            at = docs.metadataColumn("_metadata")
            return docs.select(own, at["file_path"].alias("_path"), F.xxhash64(at["file_path"]).alias("_file"), at["row_index"].alias("_row"))
    except AnalysisException:  # the scan has no such columns
        pass
    if path is None:
        return located(materialize(docs, "located"))
    docs.write.mode("overwrite").parquet(path)
    return located(docs.sparkSession.read.schema(docs.schema).parquet(path))


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents of located rows that are not among the locators of ``dropped`` (a written table)."""
    out = broadcast_if_small(dropped.select("_file", "_row"))
    return rows.join(out, ["_file", "_row"], "left_anti").select("d.*")
