"""The tools over two wires: JSON-RPC on standard input and output for agents, and a read-only HTTP API."""

from __future__ import annotations

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO
from urllib.parse import parse_qsl, urlsplit

from terrane import tools
from terrane.plans.estate_queries import Tables

PROTOCOL = "2024-11-05"
MOST_ROWS = 200


def answer(t: Tables, name: str, args: dict | None = None, rows: int = 50) -> list[dict]:
    """The first ``rows`` rows of a tool as plain values; the graph stays where it is."""
    got = tools.call(t, name, args).limit(max(0, min(int(rows), MOST_ROWS))).collect()
    return [json.loads(json.dumps(r.asDict(recursive=True), default=str)) for r in got]


def listing() -> list[dict]:
    kind = {int: "integer", float: "number", str: "string"}
    return [
        {"name": n, "description": x.about, "inputSchema": {"type": "object", "properties": {k: {"type": kind[type(v)]} for k, v in x.params.items()} | {"rows": {"type": "integer"}}}}
        for n, x in sorted(tools.TOOLS.items())
    ]


def handle(t: Tables, message: dict) -> dict | None:
    """The reply to one JSON-RPC message; none to a notification."""
    method, key, params = message.get("method"), message.get("id"), message.get("params") or {}
    if key is None:
        return None
    ok = lambda result: {"jsonrpc": "2.0", "id": key, "result": result}
    if method == "initialize":
        return ok({"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "terrane", "version": "0.2"}})
    if method == "ping":
        return ok({})
    if method == "tools/list":
        return ok({"tools": listing()})
    if method == "tools/call":
        args = dict(params.get("arguments") or {})
        rows = args.pop("rows", 50)
        try:
            text, bad = json.dumps(answer(t, params.get("name", ""), args, rows), ensure_ascii=False), False
        except Exception as e:  # noqa: BLE001 - a tool's failure is an answer, not the server's end
            text, bad = str(e).splitlines()[0][:500] if str(e) else type(e).__name__, True
        return ok({"content": [{"type": "text", "text": text}], "isError": bad})
    return {"jsonrpc": "2.0", "id": key, "error": {"code": -32601, "message": f"no method {method}"}}


def stdio(t: Tables, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """One message a line until the input ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            reply = handle(t, json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if reply is not None:
            print(json.dumps(reply, ensure_ascii=False), file=sink, flush=True)


def http(t: Tables, port: int = 8377, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A started server of ``/api`` (the tools) and ``/api/<tool>?<param>=…&rows=…``; local unless told otherwise, reading only."""
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlsplit(self.path)
            name, args = url.path.removeprefix("/api").strip("/"), dict(parse_qsl(url.query))
            if not url.path.startswith("/api"):
                return self._send(404, {"error": "not here"})
            if not name:
                return self._send(200, listing())
            if name not in tools.TOOLS:
                return self._send(404, {"error": f"no tool {name}"})
            rows = args.pop("rows", "50")
            try:
                with lock:  # merged tables are made once
                    body = answer(t, name, args, int(rows))
            except ValueError as e:
                return self._send(400, {"error": str(e)})
            return self._send(200, body)

        def _send(self, status: int, body) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_: object) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
