"""A thin HTTP door to a search engine: JSON answers, any origin."""

from __future__ import annotations

import json
import logging
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from spindrift.plans.engine import SearchEngine

_log = logging.getLogger(__name__)


def respond(engine: SearchEngine, target: str) -> tuple[int, dict]:
    """(status, body) of a GET: ``/`` and ``/api/health``; ``/search`` and ``/api/search`` with q, page and limit; 422 for wrong arguments."""
    parts = urlsplit(target)
    if parts.path == "/":
        return 200, {"message": "API is running"}
    if parts.path == "/api/health":
        return 200, engine.health()
    if parts.path not in ("/search", "/api/search"):
        return 404, {"detail": "Not Found"}
    asked = {k: v[-1] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    try:
        query, page, limit = asked.get("q", ""), int(asked.get("page", 1)), int(asked.get("limit", 10))
        return 200, engine.search_page(query, page, limit).envelope()
    except ValueError as e:
        return 422, {"detail": str(e)}
    except Exception:
        _log.exception("request failed path=%s", parts.path)
        return 500, {"detail": "Internal Server Error"}


def serve(engine: SearchEngine, host: str = "127.0.0.1", port: int = 0, concurrent: int = 16) -> ThreadingHTTPServer:
    """A server in a thread of its own; at most ``concurrent`` requests work at once.  ``shutdown()`` ends it; ``server_address`` tells the port."""
    places = threading.Semaphore(concurrent)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            with places:
                status, body = respond(engine, self.path)
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, text: str, *args: object) -> None:
            _log.info(text, *args)

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
