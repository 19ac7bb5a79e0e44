"""Edge lists from CSV, XLSX and Parquet files, with the order of their rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.index import dense_index, file_index
from vertexloom.functions.shared import materialize
from vertexloom.model import EDGE_LIST, GraphError

#: Names in a CSV header, in the order of EDGE_LIST.
CSV_COLUMNS = ("startId", "startLabel", "edgeLabel", "endId", "endLabel")
MAX_LINE = 1 << 20
BOM = "﻿"


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Rows (row_no, start_pk, start_label, rel, end_pk, end_label) of a file, by its extension in lower case."""
    kind = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if kind == "csv":
        return read_csv(spark, path)
    if kind in ("xlsx", "xls"):
        return read_xlsx(spark, path)
    if kind == "parquet":
        return read_parquet(spark, path)
    raise GraphError("only support excel or csv file now")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (row_no, line): lines without line ends, in the order of the file."""
    text = spark.read.text(path, lineSep="\n").select(
        F.regexp_replace("value", "\r$", "").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    # Written, so that places are those of one reading.
    return file_index(materialize(text, "lines"), ["file", "block"], "place", "row_no").select("row_no", "line")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with the five columns by name, in any order, among others; a folder's files follow each other as one, the first with the header.

    Fields are split at every comma and trimmed of spaces and tabs; quotes are
    ordinary characters and empty fields empty strings. A missing or repeated
    column, a line with too few or too many fields (a blank one too) or longer
    than 1 MiB raises an error.
    """
    lines = _lines(spark, path)
    first = lines.filter(F.col("row_no") == 0).first()
    if first is None:
        raise GraphError("the file has no header")
    header = [x.strip(" \t") for x in first["line"].removeprefix(BOM).split(",")]
    for name in CSV_COLUMNS:
        if header.count(name) != 1:
            raise GraphError(f"column {name} is {'missing' if name not in header else 'repeated'}")
    n = len(header)
    fields = F.split("line", ",", -1)
    # Thrown by the task that meets the line; the fields below depend on it.
    checked = (
        F.when(F.octet_length("line") > MAX_LINE, F.raise_error(F.concat(F.lit("line too long: "), F.col("row_no").cast("string"))))
        .when(F.size(fields) < n, F.raise_error(F.concat(F.lit("too few columns in line "), F.col("row_no").cast("string"))))
        .when(F.size(fields) > n, F.raise_error(F.concat(F.lit("too many columns in line "), F.col("row_no").cast("string"))))
        .otherwise(fields)
    )
    rows = lines.filter(F.col("row_no") > 0).select("row_no", checked.alias("fields"))
    return rows.select("row_no", *(F.regexp_replace(F.get("fields", F.lit(header.index(name))), r"^[ \t]+|[ \t]+$", "").alias(c) for name, c in zip(CSV_COLUMNS, EDGE_LIST, strict=True)))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet edge list with the columns of EDGE_LIST or of CSV, in the order of files and rows."""
    df = spark.read.parquet(path)
    names = EDGE_LIST if set(EDGE_LIST) <= set(df.columns) else CSV_COLUMNS
    lacking = [c for c in names if c not in df.columns]
    if lacking:
        raise GraphError(f"column {lacking[0]} is missing")
    rows = df.select(*(F.col(a).cast("string").alias(b) for a, b in zip(names, EDGE_LIST, strict=True)), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return file_index(rows, ["_file"], "_row", "row_no").select("row_no", *EDGE_LIST)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """A workbook with the five columns by position, over all its sheets.

    Cells that exist are taken five at a time; the first five of the first
    sheet are the header, and a rest of fewer than five in a sheet is dropped.
    The file is read by Spark and parsed where it is read; a workbook is one
    task, as its parts are compressed as a whole.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = list(workbook_rows(content))
                columns = [[r[i] for r in rows] for i in range(len(EDGE_LIST))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), *(pa.array(c, pa.string()) for c in columns)], names=["_file", "_row", *EDGE_LIST]
                )

    found = files.mapInArrow(parsed, f"_file string, _row long, {', '.join(f'{c} string' for c in EDGE_LIST)}")
    return dense_index(found, ["_file", "_row"], "row_no").select("row_no", *EDGE_LIST)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook_rows(content: bytes) -> Iterator[tuple[str, ...]]:
    """The edge rows of a workbook's bytes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        header = True
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_ID)]
            with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
                held: list[str] = []
                for _, cell in ElementTree.iterparse(f):
                    if cell.tag != f"{_MAIN}c":
                        continue
                    held.append(_cell(cell, shared))
                    cell.clear()
                    if len(held) == len(EDGE_LIST):
                        if not header:
                            yield tuple(held)
                        header, held = False, []


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, value = cell.get("t"), cell.findtext(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    return re.sub(r"\.0+$", "", value) if kind in (None, "n") else value


def write_workbook(spark: SparkSession, path: str, rows: Iterable[Sequence[str | int | float]]) -> None:
    """A workbook of one sheet with a header and edge rows, at a path that Spark can write to. Its rows are held in memory."""

    def cell(value: str | int | float) -> str:
        if isinstance(value, int | float):
            return f"<c><v>{value}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in (CSV_COLUMNS, *rows))
    main, relation = _MAIN.strip("{}"), _ID.strip("{").split("}")[0]
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{relation}"><sheets><sheet name="edges" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(content.getvalue()))
    finally:
        out.close()
