"""A read-only HTTP surface: submit a query, ask for its state, page through its result, cancel it.

Results are written by the executors to the store of results (a folder all can reach) and read from there page by
page, so a result of any size costs the server one page of memory. They expire, and their number is bounded.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlparse

from ..session import Engine
from ..sources.files import list_files, remove, work_folder
from ..sources.sinks import text_of
from ..sql import commands
from ..sql.parser import Node, SqlError

ALLOWED = {"query", "explain", "show_tables", "show_schemas", "describe"}


def check_read_only(text: str) -> None:
    """SELECT, WITH, VALUES, SHOW, DESCRIBE and EXPLAIN over known tables; files aren't reachable by name."""
    c = commands.parse(text)
    if c.name not in ALLOWED:
        raise SqlError("only reading statements are allowed")

    def inside(n: Any) -> None:
        if isinstance(n, Node):
            if n.kind == "function":
                raise SqlError("file functions aren't allowed")
            for v in n.parts.values():
                inside(v)
        elif isinstance(n, (list, tuple)):
            for v in n:
                inside(v)

    inside(c.args.get("q"))


class Results:
    """Queries by id, with their state and where their rows are. ``keep``: how many; ``most_bytes``: of all results
    together, the oldest of which make room; ``running``: queries at a time, others are refused."""

    def __init__(self, engine: Engine, keep: int = 100, seconds: float = 3600, most_bytes: int = 10 << 30, running: int = 16):
        self.engine, self.keep, self.seconds, self.most_bytes, self.running = engine, keep, seconds, most_bytes, running
        self.folder = work_folder(engine.spark, "results")
        self.lock = threading.Lock()
        self.queries: dict[str, dict[str, Any]] = {}

    def submit(self, text: str, params: list | None) -> dict[str, Any]:
        check_read_only(text)
        self.expire()
        entry: dict[str, Any] = {"id": uuid.uuid4().hex, "state": "running", "submitted": time.time(), "rows": None, "error": None, "columns": None}
        with self.lock:
            if len(self.queries) >= self.keep:
                raise SqlError("too many results are kept")
            if sum(e["state"] == "running" for e in self.queries.values()) >= self.running:
                raise SqlError("too many queries are running")
            self.queries[entry["id"]] = entry
        threading.Thread(target=self._run, args=(entry, text, params), daemon=True).start()
        return entry

    def _run(self, entry: dict[str, Any], text: str, params: list | None) -> None:
        spark = self.engine.spark
        try:
            spark.sparkContext.setJobGroup(entry["id"], "http", True)
            df = self.engine.session().execute(text, params).df
            entry["columns"] = [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]
            path = f"{self.folder}/{entry['id']}"
            from pyspark.sql import functions as F

            numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns)))).withColumn("_at", F.monotonically_increasing_id())
            numbered.write.parquet(path)
            written = spark.read.schema(numbered.schema).parquet(path)
            entry["rows"] = written.count()
            entry["path"], entry["bytes"] = path, sum(f.size for f in list_files(spark, path))
            self.make_room(entry)
            if entry["state"] == "running":
                entry["state"] = "done"
        except Exception as e:  # noqa: BLE001 - whatever failed is told to the client
            if entry["state"] == "running":
                entry.update(state="failed", error=str(e).splitlines()[0][:500])

    def make_room(self, entry: dict[str, Any]) -> None:
        """Drops the oldest results until all fit; one that doesn't fit by itself fails."""
        if entry["bytes"] > self.most_bytes:
            remove(self.engine.spark, entry.pop("path"))
            raise SqlError("the result is larger than the store of results")
        with self.lock:
            done = sorted((e for e in self.queries.values() if "path" in e), key=lambda e: e["submitted"])
            while sum(e["bytes"] for e in done) > self.most_bytes:
                old = done.pop(next(i for i, e in enumerate(done) if e is not entry))
                self.queries.pop(old["id"], None)
                remove(self.engine.spark, old["path"])

    def get(self, name: str) -> dict[str, Any] | None:
        return self.queries.get(name)

    def page(self, entry: dict[str, Any], after: int, limit: int) -> tuple[list[list], int | None]:
        """Rows beyond a place in the result's order, and the place to go on from."""
        from pyspark.sql import functions as F

        rows = self.engine.spark.read.parquet(entry["path"]).filter(F.col("_at") > after).orderBy("_at").limit(limit + 1).collect()
        out = [[v if v is None or isinstance(v, (bool, int, float, str)) else text_of(v) for v in tuple(r)[:-1]] for r in rows[:limit]]
        return out, rows[limit - 1]["_at"] if len(rows) > limit else None

    def cancel(self, entry: dict[str, Any]) -> None:
        if entry["state"] == "running":
            entry["state"] = "cancelled"
            self.engine.spark.sparkContext.cancelJobGroup(entry["id"])

    def delete(self, name: str) -> None:
        entry = self.queries.pop(name)
        self.cancel(entry)
        if "path" in entry:
            remove(self.engine.spark, entry["path"])

    def expire(self) -> None:
        for name, entry in list(self.queries.items()):
            if entry["state"] != "running" and time.time() - entry["submitted"] > self.seconds:
                self.delete(name)


def handler(results: Results, token: str | None) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: Any) -> None:
            pass

        def _send(self, status: int, body: Any, kind: str = "application/json") -> None:
            data = body if isinstance(body, bytes) else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _route(self, method: str) -> None:
            url = urlparse(self.path)
            if url.path in ("/healthz", "/readyz") and method == "GET":
                return self._send(200, {"status": "ok"})
            if token is not None and self.headers.get("Authorization") != f"Bearer {token}":
                return self._send(401, {"error": "a valid token is needed"})
            if url.path == "/v1/info" and method == "GET":
                return self._send(200, {"engine": "graniteql", "spark": results.engine.spark.version, "read_only": True})
            if url.path == "/v1/queries" and method == "POST":
                try:
                    asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                    entry = results.submit(asked["sql"], asked.get("params"))
                except (ValueError, KeyError, TypeError) as e:
                    return self._send(400, {"error": str(e)})
                return self._send(202, self._view(entry))
            m = re.fullmatch(r"/v1/queries/([0-9a-f]{32})(/results|/cancel)?", url.path)
            entry = results.get(m[1]) if m else None
            if not m or entry is None:
                return self._send(404, {"error": "not found"})
            if m[2] is None and method == "GET":
                return self._send(200, self._view(entry))
            if m[2] is None and method == "DELETE":
                results.delete(m[1])
                return self._send(204, b"")
            if m[2] == "/cancel" and method == "POST":
                results.cancel(entry)
                return self._send(200, self._view(entry))
            if m[2] == "/results" and method == "GET":
                if entry["state"] != "done":
                    return self._send(409, {"error": f"the query is {entry['state']}"})
                asked = parse_qs(url.query)
                limit = max(1, min(int(asked.get("limit", ["1000"])[0]), 10_000))
                rows, onward = results.page(entry, int(asked.get("after", ["-1"])[0]), limit)
                if asked.get("format", ["json"])[0] == "ndjson":
                    names = [c["name"] for c in entry["columns"]]
                    return self._send(200, "".join(json.dumps(dict(zip(names, r, strict=True)), ensure_ascii=False) + "\n" for r in rows).encode(), "application/x-ndjson")
                return self._send(200, {"columns": entry["columns"], "rows": rows, "after": onward})
            return self._send(405, {"error": "method not allowed"})

        @staticmethod
        def _view(entry: dict[str, Any]) -> dict[str, Any]:
            return {k: entry[k] for k in ("id", "state", "rows", "error", "columns")}

        def do_GET(self) -> None:  # noqa: N802
            self._route("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._route("POST")

        def do_DELETE(self) -> None:  # noqa: N802
            self._route("DELETE")

    return Handler


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 0, token: str | None = None, tls: tuple[str, str] | None = None, **limits: Any) -> ThreadingHTTPServer:
    """A server that is ready but not yet serving. tls: paths of certificate and key; without it, bind to this host only."""
    if tls is None and host not in ("127.0.0.1", "localhost", "::1"):
        raise SqlError("serving other hosts needs TLS")
    server = ThreadingHTTPServer((host, port), handler(Results(engine, **limits), token))
    if tls is not None:
        import ssl

        context = ssl.SSLContext(ssl.PROTOCOL_TLS_SERVER)
        context.load_cert_chain(*tls)
        server.socket = context.wrap_socket(server.socket, server_side=True)
    return server
