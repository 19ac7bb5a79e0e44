"""The engine's queries over the stored views, and DuckDB SQL for each, written from the semantics alone."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.shared import scratch_path
from vertexloom.model import EDGE_LIST, RAW, PropertyGraph
from vertexloom.operators import ingest, lookups, matching, neighbours, reach, wcc
from vertexloom.plans.patterns import Pattern, PatternEdge
from vertexloom.plans.views import VIEWS, stored_graph
from vertexloom.sources.edge_lists import CSV_COLUMNS, read_edge_list, write_workbook

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_RAW = {
    "events": """
        SELECT event_id AS row_no, 'u' || user_id AS start_pk, 'L' || (user_id % 3) AS start_label, event_type AS rel,
               'u' || next_user AS end_pk, 'L' || (event_id % 3) AS end_label
        FROM (SELECT *, lead(user_id) OVER (ORDER BY event_id) AS next_user FROM events) WHERE next_user IS NOT NULL""",
    "star": """
        SELECT row_number() OVER (ORDER BY start_pk, start_label, rel, end_pk, end_label) AS row_no, * FROM (
            SELECT 'c:' || o_custkey AS start_pk, 'Customer' AS start_label, 'PLACED' AS rel, 'o:' || o_orderkey AS end_pk, 'Order' AS end_label FROM orders
            UNION ALL SELECT 'o:' || l_orderkey, 'Order', 'CONTAINS', 'p:' || l_partkey, 'Part' FROM lineitem
            UNION ALL SELECT 's:' || l_suppkey, 'Supplier', 'SUPPLIES', 'p:' || l_partkey, 'Part' FROM lineitem
            UNION ALL SELECT 'c:' || c_custkey, 'Customer', 'LIVES_IN', 'n:' || c_nationkey, 'Nation' FROM customer
            UNION ALL SELECT 's:' || s_suppkey, 'Supplier', 'BASED_IN', 'n:' || s_nationkey, 'Nation' FROM supplier
            UNION ALL SELECT 'n:' || n_nationkey, 'Nation', 'IN_REGION', 'r:' || n_regionkey, 'Region' FROM nation)""",
} | {
    f"orders{q}": f"""
        SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no,
               'o' || l_orderkey AS start_pk, 'O' || (l_orderkey % 3) AS start_label, l_returnflag AS rel,
               'p' || l_partkey AS end_pk, 'P' || (l_linenumber % 3) AS end_label
        FROM lineitem WHERE l_quantity >= {q}"""
    for q in (50, 48)
} | {
    "orders": """
        SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no,
               'o' || l_orderkey AS start_pk, 'O' || (l_orderkey % 3) AS start_label, l_returnflag AS rel,
               'p' || l_partkey AS end_pk, 'P' || (l_linenumber % 3) AS end_label
        FROM lineitem"""
}


def _with(view: str, recursive: str = "") -> str:
    """The tables of a view in SQL: raw, vertex(pk, label, seen) and edge(src, dir, rel, dst, dst_label)."""
    return f"""WITH {recursive} raw AS ({_RAW[view]}),
        met AS (SELECT start_pk AS pk, start_label AS label, row_no * 2 AS seen FROM raw UNION ALL SELECT end_pk, end_label, row_no * 2 + 1 FROM raw),
        vertex AS (SELECT pk, min_by(label, seen) AS label, min(seen) AS seen FROM met GROUP BY pk),
        both_ways AS (
            SELECT start_pk AS src, 0 AS dir, rel, end_pk AS dst, end_label AS dst_label, row_no * 2 AS seen FROM raw
            UNION ALL SELECT end_pk, 1, rel, start_pk, start_label, row_no * 2 + 1 FROM raw),
        edge AS (SELECT src, dir, rel, dst, max_by(dst_label, seen) AS dst_label FROM both_ways GROUP BY src, dir, rel, dst)"""


def _in(column: str, names: Sequence[str]) -> str:
    return f"{column} IN ({', '.join(repr(x) for x in names)})" if names else "true"


_DIR = {1: "dir = 0", 2: "dir = 1", 3: "true"}


#: Their recursive SQL holds a pair of vertices for most pairs of a giant component: on sf0.01 it did not end in 12 s.
_NO_SQL = ("wcc_all_orders", "wcc_rel_orders", "wcc_rel_two_orders", "wcc_labels_rel_orders")


def _add(name: str, view: str, run: Callable[[PropertyGraph], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(stored_graph(spark, sf_dir, view))
    if name not in _NO_SQL:
        ORACLE_SQL[name] = sql


def _vertices(graph: PropertyGraph) -> DataFrame:
    return graph.vertices.select("id", "pk", "label")


def _by_pk(graph: PropertyGraph, edges: DataFrame) -> DataFrame:
    if graph.named is not None and edges is graph.edges:
        return graph.named.withColumn("dir", F.col("dir").cast("int"))
    ids = graph.vertices
    return (
        edges.join(ids.select(F.col("id").alias("src"), F.col("pk").alias("src_pk")), "src")
        .join(ids.select(F.col("id").alias("dst"), F.col("pk").alias("dst_pk")), "dst")
        .select("src_pk", F.col("dir").cast("int").alias("dir"), "rel", "dst_pk", "dst_label")
    )


_ID = "row_number() OVER (ORDER BY seen) - 1"
_EDGE_COLUMNS = "src AS src_pk, dir, rel, dst AS dst_pk, dst_label"


def _ingests() -> None:
    for view in ("events", "orders", "orders48", "star"):
        def built(spark: SparkSession, sf_dir: str, view: str = view) -> PropertyGraph:
            return ingest.build(VIEWS[view](spark, sf_dir))

        QUERIES[f"ingest_vertices_{view}"] = lambda spark, sf_dir, built=built: _vertices(built(spark, sf_dir))
        ORACLE_SQL[f"ingest_vertices_{view}"] = f"{_with(view)} SELECT {_ID} AS id, pk, label FROM vertex"
        QUERIES[f"ingest_edges_{view}"] = lambda spark, sf_dir, built=built: (lambda g: _by_pk(g, g.edges))(built(spark, sf_dir))
        ORACLE_SQL[f"ingest_edges_{view}"] = f"{_with(view)} SELECT {_EDGE_COLUMNS} FROM edge"

    def merged(spark: SparkSession, sf_dir: str) -> PropertyGraph:
        raw = VIEWS["events"](spark, sf_dir)
        return ingest.merge(ingest.build(raw.filter("row_no < 500")), raw.filter("row_no >= 500"))

    # Adding the rest of an edge list to a graph of its start gives the graph of the whole.
    QUERIES["ingest_merge_vertices"] = lambda spark, sf_dir: _vertices(merged(spark, sf_dir))
    ORACLE_SQL["ingest_merge_vertices"] = ORACLE_SQL["ingest_vertices_events"]
    QUERIES["ingest_merge_edges"] = lambda spark, sf_dir: (lambda g: _by_pk(g, g.edges))(merged(spark, sf_dir))

    def grown_from_one(spark: SparkSession, sf_dir: str) -> DataFrame:
        lone = spark.createDataFrame([(0, "lone", "Lone", "self", "lone", "Lone")], RAW)
        return _vertices(ingest.merge(ingest.build(lone), VIEWS["events"](spark, sf_dir)))

    # A graph whose greatest id is 0 grows as any other.
    QUERIES["ingest_merge_one_vertex"] = grown_from_one
    ORACLE_SQL["ingest_merge_one_vertex"] = f"{_with('events')} SELECT 0::BIGINT AS id, 'lone' AS pk, 'Lone' AS label UNION ALL SELECT row_number() OVER (ORDER BY seen), pk, label FROM vertex"
    ORACLE_SQL["ingest_merge_edges"] = ORACLE_SQL["ingest_edges_events"]


def _lookups() -> None:
    _add("vertex_scan", "events", _vertices, f"{_with('events')} SELECT {_ID} AS id, pk, label FROM vertex")
    _add("label_scan", "events", lookups.labels, f"{_with('events')} SELECT label AS name FROM vertex UNION SELECT dst_label FROM edge")
    _add("relation_scan", "events", lookups.relations, f"{_with('events')} SELECT DISTINCT rel AS name FROM edge")
    _add("vertex_by_pk", "events", lambda g: lookups.vertex_by_pk(g, "u7"), f"{_with('events')} SELECT * FROM (SELECT {_ID} AS id, pk, label FROM vertex) WHERE pk = 'u7'")
    _add("vertex_by_id", "events", lambda g: lookups.vertex_by_id(g, 11), f"{_with('events')} SELECT * FROM (SELECT {_ID} AS id, pk, label FROM vertex) WHERE id = 11")
    _add(
        "vertex_ids_batch", "events", lambda g: lookups.vertex_ids(g, ["u3", "nobody", "u1", "u3"]),
        f"{_with('events')}, asked(place, pk) AS (VALUES (0::BIGINT, 'u3'), (1, 'nobody'), (2, 'u1'), (3, 'u3')), ids AS (SELECT {_ID} AS id, pk FROM vertex) SELECT place, pk, id FROM asked LEFT JOIN ids USING (pk)",
    )
    for name, direction, relation in (("adjacency_out", 0, None), ("adjacency_in", 1, None), ("adjacency_rel", 0, "click")):
        _add(
            name, "events", lambda g, d=direction, r=relation: _by_pk(g, lookups.adjacency(g, "u1", d, r)),
            f"{_with('events')} SELECT {_EDGE_COLUMNS} FROM edge WHERE src = 'u1' AND dir = {direction} AND {_in('rel', [relation] if relation else [])}",
        )


def _neighbours() -> None:
    for name, direction, relation in (("one_hop_out", 0, None), ("one_hop_in", 1, None), ("one_hop_both", 2, None), ("one_hop_relation", 2, "view")):
        _add(
            name, "events", lambda g, d=direction, r=relation: neighbours.one_hop(g, "u1", d, r).select(F.col("dir").cast("int").alias("dir"), "edge"),
            f"""{_with('events')} SELECT dir, CASE dir WHEN 0 THEN src || ':' || label || ' -> [' || rel || '] -> ' || dst || ':' || dst_label
                ELSE dst || ':' || dst_label || ' -> [' || rel || '] -> ' || src || ':' || label END AS edge
                FROM edge JOIN vertex ON pk = src WHERE src = 'u1' AND {_in('rel', [relation] if relation else [])} AND {'true' if direction == 2 else f'dir = {direction}'}""",
        )
    for name, pks, relations in (
        ("common_2", ["u1", "u2"], []), ("common_3", ["u1", "u2", "u3"], []), ("common_relation", ["u1", "u2", "u3"], ["click"]),
        ("common_dup_ids", ["u1", "u1"], []), ("common_one_id", ["u1"], []),
    ):
        _add(
            name, "events", lambda g, p=pks, r=relations: neighbours.common_neighbours(g, p, r),
            f"""{_with('events')} SELECT count(*) AS count FROM (SELECT dst FROM edge WHERE {_in('src', pks)} AND {_in('rel', relations)}
                GROUP BY dst HAVING count(DISTINCT src) = {len(set(pks))}) WHERE {len(pks)} > 1""",
        )


def _khops() -> None:
    for name, view, pks, k, direction, relations, names in (
        ("khop_k1_out", "events", ["u1", "u2", "u3"], 1, 1, [], []),
        ("khop_k2_out", "events", ["u1", "u2", "u3"], 2, 1, [], []),
        ("khop_k2_in", "events", ["u1", "u2", "u3"], 2, 2, ["click"], []),
        ("khop_k3_both", "orders48", ["o1", "o2", "o3", "o5", "o7", "p1", "p2"], 3, 3, [], []),
        ("khop_k5_both", "orders48", ["p1", "p2", "p3", "p4", "p5"], 5, 3, ["A", "N"], []),
        ("khop_k3_both_orders", "orders", ["o1", "o2", "o3", "o5", "o7", "p1", "p2"], 3, 3, [], []),
        ("khop_k5_both_orders", "orders", ["p1", "p2", "p3", "p4", "p5"], 5, 3, ["A", "N"], []),
        ("khop_labels", "events", ["u1", "u2", "u3"], 2, 3, ["click"], ["L0"]),
        ("khop_relations", "events", ["u1", "u2", "u3"], 1, 3, ["click", "view"], ["L0", "L1"]),
        ("khop_start_dropped", "events", ["u1", "u2", "u3"], 1, 1, [], ["L1"]),
        ("khop_star_both", "star", ["n:1", "r:2"], 2, 3, ["LIVES_IN", "BASED_IN", "IN_REGION"], []),
        ("khop_bad_direction", "events", ["u1"], 2, 4, [], []),
        ("khop_k0", "events", ["u1"], 0, 1, [], []),
    ):
        _add(
            name, view, lambda g, a=(pks, k, direction, relations, names): reach.khop_count(g, *a),
            f"""{_with(view, 'RECURSIVE')}, e AS (SELECT DISTINCT src, dst FROM edge WHERE {_DIR.get(direction, 'false')} AND {_in('rel', relations)} AND {_in('dst_label', names)}),
                b(v, h) AS (SELECT pk, 0 FROM vertex WHERE {_in('pk', pks)} AND {_in('label', names)} UNION SELECT e.dst, b.h + 1 FROM b JOIN e ON e.src = b.v WHERE b.h < {k})
                SELECT {'count(DISTINCT v)' if k > 0 and direction in _DIR else '0::BIGINT'} AS count FROM {'b' if k > 0 and direction in _DIR else '(SELECT 1)'}""",
        )


def _walks() -> None:
    for name, view, pks, k, direction, relations, names, distinct in (
        ("walks_k2", "events", ["u1", "u2", "u3"], 2, 1, ["click"], [], False),
        ("walks_k2_distinct", "events", ["u1", "u2", "u3"], 2, 1, ["click"], [], True),
        ("walks_both_selfloop", "events", ["u1", "u2", "u3"], 2, 3, [], [], False),
        ("walks_dup_relation", "events", ["u1", "u2", "u3"], 2, 1, ["click", "click"], [], False),
        ("walks_dup_start", "events", ["u1", "u1", "u2"], 2, 1, ["click"], [], False),
        ("walks_k1_labels", "events", ["u1", "u2", "u3"], 1, 3, ["click"], ["L0"], False),
        ("walks_k3_both", "events", ["u1"], 3, 3, ["click"], ["L0", "L1"], False),
        ("walks_k3_in_distinct", "events", ["u1"], 3, 2, ["click"], ["L0", "L1"], True),
        ("walks_k4_star", "star", ["r:1"], 4, 3, ["LIVES_IN", "BASED_IN", "IN_REGION", "PLACED"], [], False),
    ):
        starts = ", ".join(f"('{p}')" for p in (dict.fromkeys(pks) if distinct else pks))
        listed = ", ".join(f"('{r}')" for r in relations)
        steps = f"edge JOIN (VALUES {listed}) rl(r) ON rel = r" if relations else "edge"
        levels = "".join(f", f{i + 1} AS (SELECT dst AS v, sum(w * m) AS w FROM f{i} JOIN m ON m.src = v GROUP BY dst)" for i in range(k))
        _add(
            name, view, lambda g, a=(pks, k, direction, relations, names, distinct): reach.walk_count(g, *a),
            f"""{_with(view)}, f0 AS (SELECT v, count(*)::HUGEINT AS w FROM (VALUES {starts}) s(v) GROUP BY v),
                m AS (SELECT src, dst, count(*)::HUGEINT AS m FROM {steps} WHERE {_DIR[direction]} AND {_in('dst_label', names)} GROUP BY src, dst){levels}
                SELECT {'count(*)' if distinct else 'coalesce(sum(w), 0)::BIGINT'} AS count FROM f{k}""",
        )


def _components() -> None:
    for name, view, relations, names in (
        ("wcc_all", "orders50", [], []), ("wcc_rel", "orders50", ["A"], []), ("wcc_rel_two", "orders48", ["A", "N"], []),
        ("wcc_labels", "orders50", [], ["O0", "P0"]), ("wcc_labels_rel", "orders48", ["A", "N"], ["O0", "O1", "P1"]), ("wcc_events", "events", [], []),
        ("wcc_all_orders", "orders", [], []), ("wcc_rel_orders", "orders", ["A"], []), ("wcc_rel_two_orders", "orders", ["A", "N"], []),
        ("wcc_labels_orders", "orders", [], ["O0", "P0"]), ("wcc_labels_rel_orders", "orders", ["A", "N"], ["O0", "O1", "P1"]),
    ):
        _add(
            name, view, lambda g, r=relations, n=names: wcc.weak_component_count(g, r, n),
            f"""{_with(view, 'RECURSIVE')},
                e0 AS (SELECT DISTINCT src, dst FROM edge JOIN vertex ON pk = src WHERE dir = 0 AND src <> dst AND {_in('label', names)} AND {_in('dst_label', names)} AND {_in('rel', relations)}),
                n AS (SELECT pk AS v FROM vertex WHERE {_in('label', names)} UNION SELECT dst FROM e0),
                e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0),
                r(v, root) AS (SELECT v, v FROM n UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.v WHERE r.root < e.dst)
                SELECT count(*) AS component_count FROM (SELECT v, min(root) AS m FROM r GROUP BY v) WHERE v = m""",
        )


def _matches() -> None:
    click, all5 = ["click"], ["click", "error", "purchase", "signup", "view"]
    one = PatternEdge
    cases: list[tuple[str, str, dict, list[PatternEdge]]] = [
        ("match_edge_out", "events", {"a": ["L0"], "b": ["L1"]}, [one("a", "b", click)]),
        ("match_edge_in", "events", {"a": ["L0"], "b": ["L1"]}, [one("a", "b", click, "IN")]),
        ("match_path2", "events", {"a": ["L0"], "b": ["L0", "L1"], "x": ["L2"]}, [one("a", "b", ["click", "error"]), one("b", "x", click, "IN")]),
        ("match_triangle", "events", {"a": ["L0"], "b": ["L1"], "x": ["L2"]}, [one("a", "b", click), one("b", "x", click), one("x", "a", ["click", "view"])]),
        ("match_square", "events", {"a": ["L0"], "b": ["L1"], "x": ["L2"], "y": ["L1"]}, [one("a", "b", click), one("b", "x", click), one("x", "y", click), one("y", "a", click)]),
        ("match_star", "events", {"a": ["L0"], "b": ["L0"], "x": ["L0"]}, [one("a", "b", click), one("a", "x", click)]),
        ("match_disconnected", "events", {"a": ["L0"], "b": ["L1"], "z": ["L2"]}, [one("a", "b", click)]),
        ("match_two_parts", "events", {"a": ["L0"], "b": ["L1"], "x": ["L2"], "y": ["L0"]}, [one("a", "b", click), one("x", "y", ["view"])]),
        ("match_same_vertex", "events", {"a": ["L0"], "b": ["L0"]}, [one("a", "b", all5), one("b", "a", all5)]),
        ("match_parallel", "events", {"a": ["L0"], "b": ["L1"]}, [one("a", "b", click), one("a", "b", ["view"])]),
        ("match_empty_labels", "events", {"a": [], "b": ["L1"]}, [one("a", "b", click)]),
        ("match_empty_relations", "events", {"a": ["L0"], "b": ["L1"]}, [one("a", "b", [])]),
        ("match_bad_direction", "events", {"a": ["L0"], "b": ["L1"]}, [one("a", "b", click, "BOTH")]),
        ("match_self_loop", "events", {"a": ["L0", "L1", "L2"]}, [one("a", "a", click)]),
        ("match_no_edges", "events", {"a": ["L0"], "b": ["L1"]}, []),
        ("match_star_path", "star", {"c": ["Customer"], "o": ["Order"], "p": ["Part"], "s": ["Supplier"], "n": ["Nation"]},
         [one("c", "o", ["PLACED"]), one("o", "p", ["CONTAINS"]), one("s", "p", ["SUPPLIES"]), one("c", "n", ["LIVES_IN"]), one("s", "n", ["BASED_IN"])]),
    ]
    for name, view, nodes, edges in cases:
        tables = [f"(SELECT pk FROM vertex WHERE {_in('label', names) if names else 'false'}) AS v_{v}" for v, names in nodes.items()]
        tables += [f"(SELECT DISTINCT src, dst FROM edge WHERE dir = {dict(OUT=0, IN=1).get(e.direction, 2)} AND {_in('rel', e.relations) if e.relations else 'false'}) AS e{i}" for i, e in enumerate(edges)]
        where = " AND ".join(["true", *(f"e{i}.src = v_{e.source}.pk AND e{i}.dst = v_{e.target}.pk" for i, e in enumerate(edges))])
        _add(name, view, lambda g, p=Pattern(nodes, edges): matching.match_count(g, p), f"{_with(view)} SELECT count(*) AS count FROM {', '.join(tables)} WHERE {where}")


def _sources() -> None:
    """A view is written as a file of each kind, in parts that follow each other, and read back, numbered by its rows."""

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange("row_no").sortWithinPartitions("row_no").drop("row_no")

    def from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch_path(spark, 'edges')}.csv"
        header = spark.range(1).select(F.lit(-1).cast("long").alias("row_no"), F.lit(",".join(("extra", *reversed(CSV_COLUMNS)))).alias("value"))
        fields = [x for c in reversed(EDGE_LIST) for x in (F.lit(","), F.coalesce(F.col(c), F.lit("")))]
        rows = VIEWS["events"](spark, sf_dir).select("row_no", F.concat(F.lit("more"), *fields).alias("value"))
        in_order(header.unionByName(rows)).write.text(path)
        return read_edge_list(spark, path).withColumn("row_no", F.col("row_no") - 1)

    def from_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch_path(spark, 'edges')}.parquet"
        in_order(VIEWS["events"](spark, sf_dir)).write.parquet(path)
        return read_edge_list(spark, path)

    def from_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
        # A workbook is one file; it holds the nations, of which there are 25 at any scale.
        path = f"{scratch_path(spark, 'edges')}.xlsx"
        nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
        write_workbook(spark, path, [(r["n_name"], "Nation", "IN_REGION", r["n_regionkey"], "Region") for r in nations])
        return read_edge_list(spark, path)

    numbered = "SELECT row_number() OVER (ORDER BY row_no) - 1 AS row_no, start_pk, start_label, rel, end_pk, end_label FROM raw"
    for name, run in (("source_csv", from_csv), ("source_parquet", from_parquet)):
        QUERIES[name] = run
        ORACLE_SQL[name] = f"WITH raw AS ({_RAW['events']}) {numbered}"
    QUERIES["source_xlsx"] = from_xlsx
    ORACLE_SQL["source_xlsx"] = """
        SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_no, n_name AS start_pk, 'Nation' AS start_label, 'IN_REGION' AS rel,
               n_regionkey::VARCHAR AS end_pk, 'Region' AS end_label FROM nation"""


for _make in (_sources, _ingests, _lookups, _neighbours, _khops, _walks, _components, _matches):
    _make()
