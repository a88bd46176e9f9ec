"""A graph over HTTP: POST /rpc/<method> with a JSON object, answered by rows as JSON.

For work on large results connect to Spark itself (Spark Connect); answers here
are cut off by ``most`` rows with an error, never silently.
"""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame

from graphloom.model import Ontology
from graphloom.operators import store
from graphloom.plans import cypher, sparql
from graphloom.plans.compile import traverse

MOST = 100_000


class RemoteError(RuntimeError):
    """What the server refused, with its status."""


def methods(graph: Callable[[], Ontology]) -> dict[str, Callable[..., DataFrame]]:
    """What can be asked, by name."""
    return {
        "node": lambda id: store.node(graph(), id),
        "edge": lambda id: store.edge(graph(), id),
        "outbound": lambda id: store.outbound(graph(), id),
        "inbound": lambda id: store.inbound(graph(), id),
        "counts": lambda: store.counts(graph()),
        "cypher": lambda query: traverse(graph(), cypher.parse(query)),
        "sparql": lambda query: traverse(graph(), sparql.parse(query)),
        "list_classes": lambda: store.list_classes(graph()),
        "list_edge_types": lambda: store.list_edge_types(graph()),
        "count_instances": lambda name: store.count_instances(graph(), name),
        "supertypes_of": lambda name: store.supertypes_of(graph(), name),
    }


def serve(graph: Callable[[], Ontology], host: str = "127.0.0.1", port: int = 0, most: int = MOST) -> ThreadingHTTPServer:
    """Start a server in a thread; its address is ``server_address``, ``shutdown`` ends it."""
    known = methods(graph)

    class Handler(BaseHTTPRequestHandler):
        def _say(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._say(405, {"error": "only POST"})

        def do_POST(self) -> None:
            name = self.path.removeprefix("/rpc/")
            if not self.path.startswith("/rpc/") or name not in known:
                return self._say(404, {"error": f"no method {name}"})
            try:
                args = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                rows = known[name](**args).toJSON().take(most + 1)
            except Exception as e:
                return self._say(400, {"error": str(e)[:2000]})
            if len(rows) > most:
                return self._say(400, {"error": f"more than {most} rows"})
            self._say(200, {"rows": [json.loads(r) for r in rows]})

        def log_message(self, *args: object) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


class RemoteClient:
    """Calls the methods of a server: client.call("cypher", query="MATCH ...")."""

    def __init__(self, url: str):
        self.url = url.rstrip("/")

    def call(self, method: str, **args: object) -> list[dict]:
        request = urllib.request.Request(f"{self.url}/rpc/{method}", json.dumps(args).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request) as answer:
                return json.load(answer)["rows"]
        except urllib.error.HTTPError as e:
            raise RemoteError(f"{e.code}: {json.load(e).get('error')}") from e
