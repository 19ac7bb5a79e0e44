import zipfile

import pytest
from pyspark.errors import PySparkException
from simulation import Graph
from test_graph import by_pk

from vertexloom.model import EDGE_LIST, GraphError
from vertexloom.operators.ingest import build
from vertexloom.sources.edge_lists import read_edge_list
from vertexloom.sources.store import GraphStore
from vertexloom.streaming.imports import follow

HEADER = "startId,startLabel,edgeLabel,endId,endLabel"


def rows(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r.row_no)]


def csv(spark, tmp_path, text):
    (tmp_path / "e.csv").write_bytes(text.encode())
    return read_edge_list(spark, str(tmp_path / "e.csv"))


def test_csv_by_name_with_bom_crlf_quotes_blanks_and_no_last_newline(spark, tmp_path):
    text = '﻿endLabel, edgeLabel,extra,startId\t,endId,startLabel\r\nE,R,1,"a" , b\t,S\r\n,,,,,\r\nE2,R2,x,c,d,S2'
    assert rows(csv(spark, tmp_path, text)) == [('"a"', "S", "R", "b", "E"), ("", "", "", "", ""), ("c", "S2", "R2", "d", "E2")]


@pytest.mark.parametrize("head", ["startId,startLabel,edgeLabel,endId", HEADER + ",endId", ""])
def test_csv_header_errors(spark, tmp_path, head):
    with pytest.raises(GraphError):
        csv(spark, tmp_path, head + "\na,b,c,d\n" if head else "")


@pytest.mark.parametrize("line", ["", "a,b,c,d", "a,b,c,d,e,f", "a" * (1 << 20) + ",b,c,d,e"])
def test_csv_line_errors(spark, tmp_path, line):
    with pytest.raises(PySparkException):
        csv(spark, tmp_path, f"{HEADER}\n{line}\na,b,c,d,e\n").collect()


def test_csv_order_over_many_splits(spark, tmp_path):
    (tmp_path / "e.csv").write_text(HEADER + "\n" + "".join(f"s{i},L,r,t{i % 7},M{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = rows(read_edge_list(spark, str(tmp_path / "e.csv")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == [(f"s{i}", "L", "r", f"t{i % 7}", f"M{i}") for i in range(5000)]


def workbook(path, sheets):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shared = []

    def cell(x):
        if isinstance(x, int | float):
            return f"<c><v>{x}</v></c>"
        if x.startswith("="):
            return f'<c t="inlineStr"><is><t>{x[1:]}</t></is></c>'
        shared.append(x)
        return f'<c t="s"><v>{len(shared) - 1}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        for i, sheet in enumerate(sheets):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>{''.join('<row>' + ''.join(map(cell, r)) + '</row>' for r in sheet)}</sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f"<workbook {main} {rel}><sheets>{''.join(f'<sheet name="s{i}" sheetId="{i + 1}" r:id="r{i}"/>' for i in range(len(sheets)))}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="x">{"".join(f"""<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>""" for i in range(len(sheets)))}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")


def test_xlsx_all_sheets_one_header_numbers_and_a_partial_row(spark, tmp_path):
    path = tmp_path / "E.XLSX"
    workbook(path, [[["h"] * 5, ["a", "A", "r", 12, "B"], ["=b", "A", "r", 1.5, "B"]], [["c", "A", "r", "d", "B"], ["x", "y"]]])
    assert rows(read_edge_list(spark, str(path))) == [("a", "A", "r", "12", "B"), ("b", "A", "r", "1.5", "B"), ("c", "A", "r", "d", "B")]


def test_parquet_and_unknown_kinds(spark, tmp_path):
    spark.createDataFrame([("a", "A", "r", "b", "B", 1)], ", ".join(f"{c} string" for c in EDGE_LIST) + ", more int").write.parquet(str(tmp_path / "e.parquet"))
    assert rows(read_edge_list(spark, str(tmp_path / "e.parquet"))) == [("a", "A", "r", "b", "B")]
    with pytest.raises(GraphError, match="only support excel or csv file now"):
        read_edge_list(spark, "edges.txt")


def test_conflicting_labels_through_a_file(spark, tmp_path):
    graph = build(csv(spark, tmp_path, HEADER + "\na,A,r,b,B\na,X,r,b,Y\n"))
    assert by_pk(graph) == Graph([("a", "A", "r", "b", "B"), ("a", "X", "r", "b", "Y")]).edge


def test_files_that_arrive_are_merged(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    kind = "row_no long, " + ", ".join(f"{c} string" for c in EDGE_LIST)
    data = [("a", "A", "r", "b", "B"), ("b", "B", "r", "c", "C")]
    for i, r in enumerate(data):
        spark.createDataFrame([(i, *r)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        follow(spark, str(tmp_path / "in"), store, str(tmp_path / "ck"), once=True).awaitTermination()
        assert store.version() == i + 1
    assert by_pk(store.open()) == Graph(data).edge
