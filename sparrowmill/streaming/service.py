"""A small HTTP service over the queue: JSON answers for people and workers; workers show a token."""

from __future__ import annotations

import hmac
import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tasks
from .worker import Queue

#: Rows of an answer, at most.
MOST_ROWS = 1000
VERBS = ("pause", "resume", "cancel", "retry")


def _rows(frame: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in frame.limit(MOST_ROWS).collect()]


class Service:
    """What the service answers, apart from HTTP: (status, JSON value) of a method, path and body."""

    def __init__(self, queue: Queue, token: str = ""):
        self.queue, self.token = queue, token

    def answer(self, method: str, url: str, body: dict, token: str = "") -> tuple[int, object]:
        parts, asked = urlsplit(url).path.strip("/").split("/"), parse_qs(urlsplit(url).query)
        one = lambda name: asked.get(name, [None])[0]
        if parts[:2] == ["api", "worker"] and not hmac.compare_digest(token, self.token):
            return 401, {"error": "unauthorized"}
        try:
            match method, parts[1:]:
                case "GET", ["summary"]:
                    return 200, _rows(tasks.state_counts(self.queue.tasks()))
                case "GET", ["tasks"]:
                    return 200, _rows(tasks.listing(self.queue.tasks(), one("status"), one("kind"), int(one("limit") or 200)))
                case "GET", ["tasks", number]:
                    found = _rows(self.queue.tasks().where(F.col("task_id") == int(number)))
                    events = _rows(self.queue.events().where(F.col("task_id") == int(number)).orderBy("seq"))
                    return (200, {"task": found[0], "events": events}) if found else (404, {"error": "not found"})
                case "POST", ["tasks"]:
                    return 201, {"id": self.queue.submit(body["kind"], body.get("payload", ""), int(body.get("priority", 0)), int(body.get("max_attempts", 3)))}
                case "POST", ["tasks", number, verb] if verb in VERBS:
                    self.queue.append([{"task_id": int(number), "verb": verb}])
                    return 200, {"ok": True}
                case "POST", ["worker", "claim"]:
                    return 200, {"task": self._claim(body["kinds"], body["node"], float(body.get("lease", 300)))}
                case "POST", ["worker", ("complete" | "fail") as verb]:
                    self.queue.append([{"task_id": int(body["task_id"]), "verb": verb, "node": body["node"], "error": body.get("error")}])
                    return 200, {"ok": True}
            return 404, {"error": "not found"}
        except (KeyError, ValueError) as e:
            return 400, {"error": str(e)}

    def _claim(self, kinds: list[str], node: str, lease: float) -> dict | None:
        head = _rows(tasks.claimable(self.queue.tasks(), kinds, 1))
        if not head:
            return None
        self.queue.append([{"task_id": head[0]["task_id"], "verb": "claim", "node": node, "lease_until": time.time() + lease}])
        mine = _rows(self.queue.tasks().where((F.col("task_id") == head[0]["task_id"]) & (F.col("owner") == node)))
        return mine[0] if mine else None


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server for the service; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self, method: str) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                status, value = service.answer(method, self.path, body, self.headers.get("X-Pipeline-Token", ""))
            except json.JSONDecodeError as e:
                status, value = 400, {"error": str(e)}
            data = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self._do("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._do("POST")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
