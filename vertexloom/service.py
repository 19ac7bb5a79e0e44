"""Requests and answers as JSON, and a small HTTP server for them."""

from __future__ import annotations

import json
import logging
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import urlsplit

from vertexloom.model import GraphError, PropertyGraph, UnknownName
from vertexloom.operators import lookups, matching, neighbours, reach, wcc
from vertexloom.plans.patterns import Pattern, PatternEdge

log = logging.getLogger(__name__)

#: Status and body; bodies are JSON unless they are text.
Answer = tuple[int, Any]


class BadRequest(GraphError):
    """A key is missing or has the wrong type."""


def _names(body: dict, key: str, required: bool = False) -> list[str]:
    """A list of names; unless it is required, null, an empty value or no such key give none."""
    value = body.get(key)
    if not required and not value and value in (None, [], {}):
        return []
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise BadRequest(f"{key} must be a list of strings")
    return value


def _number(body: dict, key: str) -> int:
    value = body.get(key)
    if not isinstance(value, int | float) or isinstance(value, bool):
        raise BadRequest(f"{key} must be a number")
    return int(value)


def _steps(graph: PropertyGraph, body: dict) -> tuple:
    asked = _names(body, "node_ids", True), _number(body, "k"), _number(body, "direction"), _names(body, "r_labels"), _names(body, "n_labels")
    lookups.resolve(graph, asked[0], asked[4], asked[3])
    return asked


def khop(graph: PropertyGraph, body: dict) -> dict:
    return {"code": 0, "data": {"count": reach.khop_count(graph, *_steps(graph, body)).first()[0]}}


def walks(graph: PropertyGraph, body: dict) -> dict:
    distinct = body.get("distinct", False)
    if not isinstance(distinct, bool):
        raise BadRequest("distinct must be true or false")
    return {"code": 0, "count": reach.walk_count(graph, *_steps(graph, body), distinct=distinct).first()[0]}


def common(graph: PropertyGraph, body: dict) -> dict:
    pks, relations = _names(body, "node_ids", True), _names(body, "r_labels")
    lookups.resolve(graph, pks, (), relations)
    return {"code": 0, "data": {"count": neighbours.common_neighbours(graph, pks, relations).first()[0]}}


def components(graph: PropertyGraph, body: dict) -> dict:
    relations, labels = _names(body, "r_labels"), _names(body, "n_labels")
    lookups.resolve(graph, (), labels, relations)
    return {"code": 0, "data": {"component_count": wcc.weak_component_count(graph, relations, labels).first()[0]}}


def subgraph(graph: PropertyGraph, body: dict) -> dict:
    try:
        nodes = {n["var"]: _names(n, "labels") for n in body["nodes"]}
        edges = [PatternEdge(e["source"], e["target"], _names(e, "labels"), e["direction"]) for e in body["edges"]]
    except (KeyError, TypeError) as e:
        raise BadRequest(f"not a pattern: {e}") from e
    lookups.resolve(graph, (), [x for v in nodes.values() for x in v], [x for e in edges for x in e.relations])
    return {"code": 0, "data": {"count": matching.match_count(graph, Pattern(nodes, edges)).first()[0]}}


def one_hop(graph: PropertyGraph, body: dict) -> dict:
    pk, direction, relation = body.get("start_vertex_pk"), body.get("direction", 2), body.get("relation") or None
    if not isinstance(pk, str):
        return {"code": 400, "message": "start_vertex_pk is required"}
    if direction not in (0, 1, 2):
        return {"code": 400, "message": "direction must be 0, 1 or 2"}
    for kind, asked in (("relation", ((), (), [relation] if relation else ())), ("vertex", ([pk], (), ()))):
        try:
            lookups.resolve(graph, *asked)
        except UnknownName:
            return {"code": 500, "message": f"{kind} not found"}
    rows = neighbours.one_hop(graph, pk, direction, relation).orderBy("dir").toLocalIterator()
    return {"data": [r["edge"] for r in rows]}


ROUTES = {
    "/get_one_hop_neighbors": one_hop,
    "/api/v1/algorithms/k-hop-neighbors": khop,
    "/api/v1/algorithms/common-neighbors": common,
    "/api/v1/algorithms/wcc": components,
    "/api/v1/algorithms/subgraph-matching": subgraph,
    "/api/v1/algorithms/adj-count": walks,
}


def answer(graph: PropertyGraph, route: str, content_type: str | None, content: bytes) -> Answer:
    """The answer to a request: text with 400 for what can't be read or run, ``code`` -1 for what can't be resolved."""
    if route == "/ping":
        return 200, "pong"
    if route not in ROUTES:
        return 404, "Not Found"
    if (content_type or "").split(";")[0].strip().lower() != "application/json":
        return 400, "Content-Type must be application/json"
    try:
        body = json.loads(content)
        if not isinstance(body, dict):
            raise ValueError("not an object")
    except ValueError as e:
        return 400, f"Error: {e}" if route.endswith("/adj-count") else "Invalid JSON"
    try:
        return 200, ROUTES[route](graph, body)
    except (BadRequest, UnknownName) as e:
        log.info("%s: %s", route, e)
        return 200, {"code": -1}
    except Exception as e:  # noqa: BLE001  what a query throws is the client's answer
        log.exception(route)
        return 400, f"Error: {e}"


def serve(graph: PropertyGraph, port: int = 8200) -> ThreadingHTTPServer:
    """A server for the routes; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            content = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            self._send(answer(graph, urlsplit(self.path).path, self.headers.get("Content-Type"), content))

        def do_GET(self) -> None:
            route = urlsplit(self.path).path
            self._send((200, "pong") if route == "/ping" else (404, "Not Found"))

        def _send(self, found: Answer) -> None:
            status, body = found
            text = body if isinstance(body, str) else json.dumps(body)
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if isinstance(body, str) else "application/json")
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, form: str, *args: object) -> None:
            log.info(form, *args)

    return ThreadingHTTPServer(("", port), Handler)
