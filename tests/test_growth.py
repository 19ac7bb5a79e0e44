"""What keeps a step's work in proportion to its input."""

import random
from collections import Counter

import pytest
from simulation import Graph
from test_graph import by_pk, count, raw, stored

from vertexloom.functions import idsets
from vertexloom.functions.shared import materialize
from vertexloom.operators import components, ingest, matching, reach, steps, wcc
from vertexloom.plans.patterns import Pattern, PatternEdge
from vertexloom.queries import QUERIES
from vertexloom.sources.edge_lists import read_edge_list


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_variable_of_a_cycle_goes_by_measured_joins(spark, tmp_path, monkeypatch):
    """Many parts, few suppliers that all supply them: summing parts out with nations joins 24,000 rows, suppliers first 800."""
    rows = [(f"c{i}", "C", "PLACED", f"o{i}", "O") for i in range(60)] + [(f"c{i}", "C", "LIVES_IN", f"n{i % 30}", "N") for i in range(60)]
    rows += [(f"o{i}", "O", "CONTAINS", f"p{j}", "P") for i in range(60) for j in range(40)]
    rows += [(f"s{i}", "S", "SUPPLIES", f"p{j}", "P") for i in range(20) for j in range(40)] + [(f"s{i}", "S", "BASED_IN", f"n{i}", "N") for i in range(20)]
    joined, without = [], matching._without

    def noted(factors, var):
        joined.append((var, matching._joined_rows(factors, var)))
        return without(factors, var)

    monkeypatch.setattr(matching, "_without", noted)
    one = PatternEdge
    edges = [one("c", "o", ["PLACED"]), one("o", "p", ["CONTAINS"]), one("s", "p", ["SUPPLIES"]), one("c", "n", ["LIVES_IN"]), one("s", "n", ["BASED_IN"])]
    found = count(matching.match_count(stored(spark, tmp_path, rows), Pattern({v: [v.upper()] for v in "copsn"}, edges)))
    assert found == sum(1 for i in range(60) if i % 30 < 20) * 40  # each order's parts, by the one supplier of its customer's nation
    assert max(n for _, n in joined) <= 2400, joined


@pytest.mark.parametrize("small", [True, False])
def test_rows_among_ids(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(idsets, "broadcast_if_small", lambda df: df)
    wanted = [0, 1, 63, 64, 255, 256, 700, 700, 1 << 40]
    rows = materialize(spark.createDataFrame([(i, i % 7) for i in [*range(800), 700, 1 << 40, (1 << 40) + 1]], "src long, dst long"))
    found = idsets.among(rows, "src", spark.createDataFrame([(i,) for i in [*wanted, None]], "id long"))
    assert found.columns == ["src", "dst"]
    assert Counter(r.src for r in found.collect()) == Counter({i: 1 for i in wanted} | {700: 2})
    assert ("Exchange hashpartitioning" in plan(found)) != small
    assert idsets.among(rows, "src", spark.createDataFrame([], "id long")).count() == 0


def test_walks_and_khops_from_many_vertices(spark, tmp_path, monkeypatch):
    rnd = random.Random(3)
    rows = [(f"v{rnd.randint(0, 299)}", "A", rnd.choice("rs"), f"v{rnd.randint(0, 299)}", "A") for _ in range(500)]
    graph, sim = stored(spark, tmp_path, rows), Graph(rows)
    monkeypatch.setattr(steps, "FEW", 2)
    asked = []
    monkeypatch.setattr(reach, "among", lambda edges, column, ids: asked.append(column) or idsets.among(edges, column, ids))
    start = rows[0][0]
    assert count(reach.khop_count(graph, [start], 4, 3)) == sim.khop([start], 4, 3, [], [])
    assert count(reach.walk_count(graph, [start], 4, 3, ["r", "r", "s"])) == sim.walks([start], 4, 3, ["r", "r", "s"], [], False)
    assert asked


def test_an_import_joins_each_row_once_for_both_views(spark):
    rows = [("a", "A", "r", "b", "B"), ("b", "X", "s", "a", "Y"), ("a", "C", "r", "b", "D"), ("a", "A", "r", "a", "E"), ("a", "F", "r", "a", "G")]
    graph = ingest.build(raw(spark, rows))
    assert by_pk(graph) == Graph(rows).edge
    assert {(r.src_pk, r.dir, r.rel, r.dst_pk): r.dst_label for r in graph.named.collect()} == Graph(rows).edge
    assert graph.named.count() == len(Graph(rows).edge)
    for edges in (graph.edges, graph.named):
        text = plan(edges)
        assert text.rindex("Join") > text.index("Generate inline")  # views part above the joins


def test_first_labels_are_met_by_hashing(spark):
    text = plan(ingest.first_seen(raw(spark, [("a", "A", "r", "b", "B")])))
    lowest = [line for line in text.splitlines() if "Aggregate(" in line][-1]
    assert "HashAggregate" in lowest and "partial_min(seen" in lowest


def slow_components(edges):
    best = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(best[a], best[b])
            changed |= best[a] != low or best[b] != low
            best[a] = best[b] = low
    return best


@pytest.mark.parametrize("kind", ["random", "sorted path", "mixed path", "hub"])
def test_components_shrink_from_round_to_round(spark, kind):
    rnd = random.Random(5)
    n = 300
    edges = {
        "random": [(rnd.randint(0, n), rnd.randint(0, n)) for _ in range(250)],
        "sorted path": [(i, i + 1) for i in range(n)],
        "mixed path": list(zip(p := rnd.sample(range(n), n), p[1:], strict=False)),
        "hub": [(7, i) for i in range(n) if i != 7] + [(i, i + 1) for i in range(500, 510)],
    }[kind]
    edges = [(a, b) for a, b in edges if a != b]
    df = materialize(spark.createDataFrame(edges, "a long, b long"))
    want = slow_components(edges)
    rounds = [t.count() for t in components._rounds(df)]
    assert sum(rounds) <= 6 * len(want) and len(rounds) <= 20, rounds
    assert {r.node: r.component for r in components.connected_components(df).collect()} == want
    done, nodes = components.component_count(df)
    assert done == len(set(want.values())) and {r.node for r in nodes.collect()} == set(want)


def test_component_count_of_a_graph_that_is_not_stored(spark):
    rows = [("a", "A", "r", "b", "B"), ("c", "A", "r", "c", "A"), ("d", "C", "s", "e", "B"), ("e", "B", "r", "f", "B")]
    graph = ingest.build(raw(spark, rows))
    for relations, labels in (([], []), (["r"], []), ([], ["A", "B"]), (["s"], ["C"]), (["none"], [])):
        assert count(wcc.weak_component_count(graph, relations, labels)) == Graph(rows).wcc(relations, labels)
        assert wcc.weak_components(graph, relations, labels).filter("id = component").count() == Graph(rows).wcc(relations, labels)


def test_files_are_numbered_where_they_are_read(spark, tmp_path):
    folder = tmp_path / "e.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text("endLabel,extra,startId,endId,edgeLabel,startLabel\nE,,s0,t0,r,S\n")
    (folder / "part-1.csv").write_text("".join(f"E,,s{i},t{i},r,S\n" for i in range(1, 40)))
    (folder / "part-2.csv").write_text("E,,s40,t40,r,S\n")
    found = read_edge_list(spark, str(folder))
    assert "Exchange rangepartitioning" not in plan(found)
    assert sorted((r.row_no, r.start_pk, r.end_label) for r in found.collect()) == [(i + 1, f"s{i}", "E") for i in range(41)]


@pytest.mark.parametrize("name", ["source_csv", "source_parquet"])
def test_a_view_is_written_in_parts(spark, name, monkeypatch):
    monkeypatch.setattr("vertexloom.queries.read_edge_list", lambda spark, path: spark.read.format("binaryFile").load(path).selectExpr("path", "0L AS row_no"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
