"""Lineage over HTTP: a small local server that answers questions about a loaded graph as JSON."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame

from tracewell.operators import display, graph


class Explorer:
    """Answers by path: /graph (vertices, links), /models, /lineage/SELECTOR and /search?q=TEXT (ids of columns that contain it).

    The display graph is made once; closures are computed when asked for, from their root alone.
    """

    def __init__(self, edges: DataFrame, exposures: DataFrame, nodes: DataFrame):
        self.edges = edges.cache()
        self.graph = json.loads(display.graph_json(*graph.display_graph(self.edges, exposures, nodes)).head().json)

    def answer(self, url: str) -> tuple[int, dict | list]:
        """(HTTP status, JSON) of a request path."""
        parts = urlsplit(url)
        first, _, rest = parts.path.strip("/").partition("/")
        if first == "graph" and not rest:
            return 200, self.graph
        if first == "models" and not rest:
            return 200, sorted({n["model"] for n in self.graph["nodes"] if n["kind"] == "column"})
        if first == "search":
            text = parse_qs(parts.query).get("q", [""])[0].lower()
            return 200, sorted(n["id"] for n in self.graph["nodes"] if text and text in n["id"].lower())
        if first == "lineage" and rest:
            try:
                found = graph.select_lineage(self.edges, unquote(rest)).orderBy("direction", "depth", "model", "column")
            except ValueError as e:
                return 400, {"error": str(e)}
            return 200, [r.asDict() for r in found.collect()]
        return 404, {"error": f"no such path: {parts.path}"}


def server(explorer: Explorer, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server, not started; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, body = explorer.answer(self.path)
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
