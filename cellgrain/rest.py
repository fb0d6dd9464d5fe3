"""HTTP service over an engine: framework-free handlers, and a server of the standard library.

GET /health, /catalog, /cube/NAME; POST /query and /explain with {"sql": ..., "role": ...}. The role in
the header ``x-role`` goes before the one in the body. A query's answer has all its rows; with ``limit`` and ``offset`` in
the body it has one page of them, in the result's order, and says whether more follow.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .engine import Engine
from .errors import AccessDenied, BindError, QuerySyntaxError


class Service:
    def __init__(self, engine: Engine):
        self.engine = engine

    def handle(self, method: str, path: str, body: dict | None = None, headers: dict | None = None) -> tuple[int, dict]:
        """Status and answer of one request."""
        body = body or {}
        role = {k.lower(): v for k, v in (headers or {}).items()}.get("x-role") or body.get("role")
        try:
            if method == "GET" and path == "/health":
                return 200, {"status": "ok"}
            if method == "GET" and path == "/catalog":
                return 200, {"cubes": {c.name: c.dims for c in self.engine.catalog.cubes.values()}, "dimensions": self.engine.dimensions}
            if method == "GET" and path.startswith("/cube/"):
                return 200, self.engine.stats(path.removeprefix("/cube/"))
            if method == "POST" and path in ("/query", "/explain"):
                if not isinstance(body.get("sql"), str):
                    return 400, {"error": "sql is missing"}
                if path == "/explain":
                    return 200, {"plan": self.engine.explain(body["sql"], role)}
                result = self.engine.sql(body["sql"], role)
                limit, offset = body.get("limit"), body.get("offset", 0)
                if not (limit is None or type(limit) is int and limit >= 0) or type(offset) is not int or offset < 0:
                    return 400, {"error": "limit and offset are whole numbers from 0"}
                df = result.ordered().offset(offset) if offset else result.ordered()
                rows = [list(r) for r in (df if limit is None else df.limit(limit + 1)).collect()]
                more = limit is not None and len(rows) > limit
                rows = rows[:limit]
                return 200, {"columns": result.columns, "rows": rows, "row_count": len(rows), "more": more, "stats": result.stats}
            return 404, {"error": f"no {method} {path}"}
        except AccessDenied as e:
            return 403, {"error": str(e)}
        except KeyError as e:
            return 404, {"error": str(e)}
        except (QuerySyntaxError, BindError, ValueError) as e:
            return 400, {"error": str(e)}

    def server(self, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self, body: dict | None = None) -> None:
                status, answer = service.handle(self.command, self.path, body, dict(self.headers))
                data = json.dumps(answer, default=str, ensure_ascii=False).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json; charset=utf-8")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self) -> None:
                self._answer()

            def do_POST(self) -> None:
                try:
                    body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                except ValueError:
                    body = {}
                self._answer(body if isinstance(body, dict) else {})

            def log_message(self, *args) -> None:
                pass

        return ThreadingHTTPServer((host, port), Handler)
