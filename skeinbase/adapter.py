"""A thin door to the queries: requests as JSON, rows as JSON."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from . import catalog

MOST = 1000


def handle(spark: SparkSession, sf_dir: str, message: dict) -> dict:
    """The answer to a JSON-RPC message: ``list`` names the queries, ``call`` runs one (params name, limit)."""
    reply = {"jsonrpc": "2.0", "id": message.get("id")}
    params = message.get("params") or {}
    if message.get("method") == "list":
        return reply | {"result": sorted(catalog.queries())}
    if message.get("method") != "call":
        return reply | {"error": {"code": -32601, "message": "no such method"}}
    query = catalog.queries().get(params.get("name"))
    if query is None:
        return reply | {"error": {"code": -32602, "message": "no such query"}}
    rows = query(spark, sf_dir).limit(max(0, min(int(params.get("limit", 100)), MOST))).toJSON().collect()
    return reply | {"result": [json.loads(r) for r in rows]}


def server(spark: SparkSession, sf_dir: str, port: int = 0) -> ThreadingHTTPServer:
    """An HTTP server of this machine alone: POST of a message, GET /healthz."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, body: dict) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._send({"ok": self.path == "/healthz"})

        def do_POST(self) -> None:
            try:
                message = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
            except ValueError:
                message = {}
            self._send(handle(spark, sf_dir, message if isinstance(message, dict) else {}))

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
