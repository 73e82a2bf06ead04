"""HTTP: JSON answers to graph queries over one session, with a graph that is swapped after each refresh."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

from .operators.query import NotFound, SymbolFilter
from .session import RepositorySession
from .sources.store import Conflict, StoreError

#: Statuses of errors; others are 500.
STATUS = {NotFound: 404, Conflict: 409, StoreError: 503, ValueError: 400, UnicodeDecodeError: 422, FileNotFoundError: 404}
#: Rows of one answer; more is an error that names the export.
MOST_ROWS = 100_000


def _rows(df: DataFrame) -> list[dict]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; use export")
    return [r.asDict(True) for r in rows]


def _pair(x: tuple[DataFrame, DataFrame]) -> dict:
    return {"nodes": _rows(x[0].orderBy("id")), "edges": _rows(x[1].orderBy("id"))}


class Service:
    """The session and its cached graph. Writers take turns; readers keep the graph that they began with."""

    def __init__(self, session: RepositorySession):
        self.session, self.writing, self.swap, self.cached = session, threading.Lock(), threading.Lock(), None

    def graph(self):
        with self.swap:
            if self.cached is None:
                self.cached = self.session.graph()
            return self.cached

    def _swapped(self, stats: dict) -> dict:
        fresh = self.session.graph()
        with self.swap:
            self.cached = fresh
        return stats

    def post(self, path: str, body: dict) -> dict:
        with self.writing:
            if path == "/index/open":
                if body.get("path") and body["path"] != self.session.repo_path:
                    self.session = RepositorySession(self.session.spark, body["path"], body.get("store") or self.session.store.path)
                return self._swapped(self.session.build_full())
            if path == "/index/refresh":
                paths = body.get("paths")
                if not isinstance(paths, list) or not all(isinstance(x, str) for x in paths):
                    raise ValueError("paths: a list of strings")
                return self._swapped(self.session.refresh_paths(paths))
        raise NotFound(path)

    def get(self, path: str, q: dict[str, str]) -> dict:
        g, target = self.graph(), q.get("symbol") or q.get("path") or q.get("target") or ""
        if path == "/health":
            return self.session.health()
        if path == "/graph/find_symbol":
            return {"nodes": _rows(g.find_symbol(SymbolFilter(q.get("name"), q.get("fq_name"), q.get("kind"))))}
        if path == "/graph/dependencies":
            direction = q.get("direction") if q.get("direction") in ("inbound", "both") else "outbound"
            return _pair(g.dependencies(target, direction, int(q.get("depth", 2))))
        if path == "/graph/impact":
            return _pair(g.impact(target, int(q.get("depth", 3))))
        if path in ("/graph/callers", "/graph/callees"):
            return _pair(getattr(g, path.rpartition("/")[2])(target))
        if path == "/graph/references":
            return {"references": _rows(g.references(target))}
        if path == "/graph/explain":
            return _rows(g.explain(target, self.session.snippet))[0]
        raise NotFound(path)


class _Handler(BaseHTTPRequestHandler):
    service: Service

    def _answer(self, work) -> None:
        try:
            status, out = 200, work()
        except Exception as e:  # every failure is an answer
            status = next((code for kind, code in STATUS.items() if isinstance(e, kind)), 500)
            out = {"error": type(e).__name__, "message": str(e)[:2000]}
        data = json.dumps(out, default=str).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self) -> None:
        at = urlsplit(self.path)
        self._answer(lambda: self.service.get(at.path, {k: v[-1] for k, v in parse_qs(at.query).items()}))

    def do_POST(self) -> None:
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        self._answer(lambda: self.service.post(urlsplit(self.path).path, json.loads(body or b"{}")))

    def log_message(self, *_) -> None:
        pass


def serve(session: RepositorySession, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``; port 0 takes a free one."""
    return ThreadingHTTPServer((host, port), type("Handler", (_Handler,), {"service": Service(session)}))
