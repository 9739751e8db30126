"""A small HTTP endpoint over a graph: ``/query``, ``/update``, ``/reason/<profile>``, ``/bindings`` and ``/``."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from .results import to_json

PAGE = """<!doctype html><title>Graph</title><h1>Graph</h1>
<form action="/query" method="get"><textarea name="query" rows="8" cols="80">SELECT * WHERE { ?s ?p ?o } LIMIT 10</textarea><br><button>Run</button></form>"""


class Endpoint:
    """Holds the graph, since reasoning and updates replace it; ``ignore`` lists prefixes to hide."""

    def __init__(self, graph, ignore: tuple[str, ...] = ()):
        self.graph, self.ignore = graph, set(ignore)

    def handle(self, method: str, path: str, body: str = "", kind: str = "") -> tuple[int, str, str]:
        """(status, content type, text) of a request."""
        url = urlparse(path)
        try:
            if url.path == "/":
                return 200, "text/html", PAGE
            if url.path == "/query":
                text = parse_qs(url.query).get("query", [""])[0] if method == "GET" else body if kind.startswith("application/sparql-query") else parse_qs(body).get("query", [""])[0]
                return 200, "application/sparql-results+json", to_json(self.graph.query(text))
            if url.path == "/update" and method == "POST":
                self.graph = self.graph.update(body if kind.startswith("application/sparql-update") else parse_qs(body).get("update", [""])[0]).cut()
                return 200, "application/json", "{}"
            if url.path == "/bindings":
                return 200, "application/json", json.dumps({k: v for k, v in self.graph.prefixes.items() if k not in self.ignore})
            if url.path.startswith("/reason/"):
                self.graph = self.graph.expand(url.path.removeprefix("/reason/")).cut()
                return 200, "application/json", json.dumps({"triples": len(self.graph)})
        except ValueError as e:
            return 400, "text/plain", str(e)
        return 404, "text/plain", "not found"


def server(graph, address: str = "127.0.0.1:8080", ignore: tuple[str, ...] = ()) -> ThreadingHTTPServer:
    """A server ready for ``serve_forever``."""
    endpoint = Endpoint(graph, ignore)

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            length = int(self.headers.get("Content-Length") or 0)
            status, kind, text = endpoint.handle(self.command, self.path, self.rfile.read(length).decode(), self.headers.get("Content-Type") or "")
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = answer

        def log_message(self, *args):
            pass

    host, _, port = address.partition(":")
    return ThreadingHTTPServer((host, int(port or 8080)), Handler)
