import json
import threading
import urllib.request

import pytest
from test_graph import SMALL, stored

from vertexloom.cli import arguments, main
from vertexloom.service import answer, serve
from vertexloom.sources.store import GraphStore

API = "/api/v1/algorithms/"


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory.mktemp("served"), SMALL)


def ask(graph, route, **body):
    return answer(graph, route, "application/json", json.dumps(body).encode())


def test_answers(graph):
    assert answer(graph, "/ping", None, b"") == (200, "pong")
    assert ask(graph, API + "k-hop-neighbors", node_ids=["a"], k=2, direction=1) == (200, {"code": 0, "data": {"count": 3}})
    assert ask(graph, API + "k-hop-neighbors", node_ids=["a"], k=2, direction=9, n_labels=None, r_labels=[]) == (200, {"code": 0, "data": {"count": 0}})
    assert ask(graph, API + "common-neighbors", node_ids=["b", "c"]) == (200, {"code": 0, "data": {"count": 1}})
    assert ask(graph, API + "wcc") == (200, {"code": 0, "data": {"component_count": 2}})
    assert ask(graph, API + "adj-count", node_ids=["b", "b"], k=2, direction=1) == (200, {"code": 0, "count": 2})
    assert ask(graph, API + "adj-count", node_ids=["b", "b"], k=2, direction=1, distinct=True) == (200, {"code": 0, "count": 1})
    pattern = {"nodes": [{"var": "x", "labels": ["Person"]}, {"var": "y", "labels": ["Dog"]}], "edges": [{"source": "x", "target": "y", "labels": ["Like"], "direction": "OUT"}]}
    assert ask(graph, API + "subgraph-matching", **pattern) == (200, {"code": 0, "data": {"count": 1}})
    assert ask(graph, "/get_one_hop_neighbors", start_vertex_pk="b", direction=0) == (200, {"data": ["b:Dog -> [Hate] -> c:Cat"]})
    assert ask(graph, "/get_one_hop_neighbors", start_vertex_pk="d", direction=0) == (200, {"data": []})


def test_refusals(graph):
    lost = (200, {"code": -1})
    assert ask(graph, API + "k-hop-neighbors", node_ids=["nobody"], k=2, direction=1) == lost
    assert ask(graph, API + "k-hop-neighbors", node_ids="a", k=2, direction=1) == lost
    assert ask(graph, API + "k-hop-neighbors", node_ids=["a"], direction=1) == lost
    assert ask(graph, API + "k-hop-neighbors", node_ids=["a"], k=1, direction=1, n_labels=["Nope"]) == lost
    assert ask(graph, API + "wcc", r_labels=["Nope"]) == lost
    assert ask(graph, API + "wcc", n_labels="Dog") == lost
    assert ask(graph, API + "adj-count", node_ids=["a"], k=1, direction=1, distinct="yes") == lost
    assert ask(graph, API + "subgraph-matching", nodes=[]) == lost
    assert ask(graph, "/get_one_hop_neighbors")[1]["code"] == 400
    assert ask(graph, "/get_one_hop_neighbors", start_vertex_pk="a", direction=5)[1]["code"] == 400
    assert ask(graph, "/get_one_hop_neighbors", start_vertex_pk="nobody")[1]["code"] == 500
    assert ask(graph, "/get_one_hop_neighbors", start_vertex_pk="a", relation="Nope")[1]["code"] == 500
    assert answer(graph, API + "wcc", "text/plain", b"{}") == (400, "Content-Type must be application/json")
    assert answer(graph, API + "wcc", "application/json", b"{")[0] == 400
    assert answer(graph, API + "adj-count", "application/json", b"{")[1].startswith("Error: ")
    assert answer(graph, "/other", None, b"")[0] == 404


def test_server(graph):
    server = serve(graph, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert urllib.request.urlopen(url + "/ping").read() == b"pong"
        request = urllib.request.Request(url + API + "wcc", b"{}", {"Content-Type": "application/json"})
        assert json.load(urllib.request.urlopen(request)) == {"code": 0, "data": {"component_count": 2}}
    finally:
        server.shutdown()


def test_command_line(spark, tmp_path):
    for bad in ([], ["--database_dir", "x", "--need_import"], ["--database_dir", "x", "--port", "0"]):
        with pytest.raises(SystemExit):
            arguments(bad)
    (tmp_path / "e.csv").write_text("startId,startLabel,edgeLabel,endId,endLabel\na,A,r,b,B\n")
    assert main(["--database_dir", str(tmp_path / "db"), "--need_import", "--data_path", str(tmp_path / "e.csv"), "--batch_size", "500", "--import_only"]) == 0
    assert GraphStore(spark, str(tmp_path / "db")).open().vertices.count() == 2
