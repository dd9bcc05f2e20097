"""A search endpoint over HTTP: GET /query?q=... answers with the matches of a search and how long it took."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

MOST_ROWS = 100  # as many as a search returns


def endpoint(search: Callable[[str], DataFrame], port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server, not yet running, whose ``search`` makes a DataFrame of a query text; port 0 takes any free one.

    The answer is {"duration": seconds, "matches": [row, ...]} with at most
    MOST_ROWS rows. An empty query has no matches; other paths are not found; an
    error of the search is an answer 500 with its message. Requests run in threads of their own, so Spark plans them side by side.
    """

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path != "/query":
                self.answer(404, {"error": "not found"})
                return
            text = parse_qs(url.query).get("q", [""])[0]
            begin = time.perf_counter()
            try:
                matches = [r.asDict(recursive=True) for r in search(text).limit(MOST_ROWS).collect()] if text.strip() else []
            except Exception as e:  # noqa: BLE001 - whatever it is, the client is told
                self.answer(500, {"error": f"{type(e).__name__}: {str(e)[:500]}"})
                return
            self.answer(200, {"duration": round(time.perf_counter() - begin, 6), "matches": matches})

        def answer(self, status: int, content: dict) -> None:
            body = json.dumps(content, default=str, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
