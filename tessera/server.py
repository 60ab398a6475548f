"""A search service over one index: /health, /config, /describe, /search?q=&top_k=&scope=&model=. Requests that come together are one Spark job."""

from __future__ import annotations

import json
import queue
import threading
import time
from concurrent.futures import Future
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.formats import as_json
from .plans.hybrid import Index, answer_rows

SCOPES = ("engine", "project", "all")
DESCRIPTION = {"name": "search", "parameters": {"q": "question", "top_k": "how many results, 1 to 100 (5)", "scope": "engine, project or all (engine)", "model": "an encoder of the index (its own)"}}


@dataclass
class Request:
    question: str
    top_k: int
    scope: str
    model: str | None
    began: float = field(default_factory=time.perf_counter)
    done: Future = field(default_factory=Future)


class Gatherer:
    """Requests wait for up to ``wait_s`` for others, up to ``most`` of them, and are answered by one plan; ``workers`` plans run at a time, each in a scheduler
    pool of its own, so that with spark.scheduler.mode FAIR none waits for another's tasks. A group that fails is answered one by one, so that a request fails alone."""

    def __init__(self, spark: SparkSession, index: Index, wait_s: float = 0.01, most: int = 64, workers: int = 2):
        self.spark, self.index, self.wait_s, self.most = spark, index, wait_s, most
        self.waiting: queue.Queue[Request | None] = queue.Queue()
        self.sizes: list[int] = []
        self.workers = [threading.Thread(target=self._work, args=(f"search-{i}",), daemon=True) for i in range(workers)]
        for w in self.workers:
            w.start()

    def _group(self) -> list[Request]:
        first = self.waiting.get()
        if first is None:
            return []
        out, until = [first], time.perf_counter() + self.wait_s
        while len(out) < self.most:
            try:
                more = self.waiting.get(timeout=max(0.0, until - time.perf_counter()))
            except queue.Empty:
                break
            if more is None:  # for the next turn
                self.waiting.put(None)
                break
            out.append(more)
        return out

    def _answer(self, group: list[Request]) -> None:
        rows = answer_rows(self.spark, self.index, [(r.question, r.top_k, r.scope, r.model) for r in group]).select("query_id", as_json().alias("j")).collect()
        found = {r.query_id: json.loads(r.j) for r in rows}
        for i, r in enumerate(group):
            r.done.set_result(found[i] | {"timing": {"total_s": time.perf_counter() - r.began, "answered_together": len(group)}})

    def _work(self, pool: str) -> None:
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        while group := self._group():
            self.sizes.append(len(group))
            try:
                self._answer(group)
            except Exception as e:  # noqa: BLE001  of whatever kind: it is the requests' answer
                for r in group:
                    if len(group) == 1:
                        r.done.set_exception(e)
                    elif not r.done.done():
                        try:
                            self._answer([r])
                        except Exception as own:  # noqa: BLE001
                            r.done.set_exception(own)

    def search(self, question: str, top_k: int = 5, scope: str = "engine", model: str | None = None) -> dict:
        r = Request(question, top_k, scope, model)
        self.waiting.put(r)
        return r.done.result()

    def close(self) -> None:
        for _ in self.workers:
            self.waiting.put(None)
        for w in self.workers:
            w.join()


def search(spark: SparkSession, index: Index, question: str, top_k: int = 5, scope: str = "engine", model: str | None = None) -> dict:
    began = time.perf_counter()
    out = json.loads(answer_rows(spark, index, [(question, top_k, scope, model)]).select(as_json().alias("j")).first().j)
    return out | {"timing": {"total_s": time.perf_counter() - began}}


def respond(spark: SparkSession, index: Index | None, target: str, gatherer: Gatherer | None = None) -> tuple[int, dict]:
    """(status, body) for a request; 503 while there is no index. With a ``gatherer`` it is answered together with others."""
    url = urlparse(target)
    args = {k: v[0] for k, v in parse_qs(url.query).items()}
    if url.path == "/health":
        return 200, {"status": "ok" if index else "degraded"}
    if url.path == "/describe":
        return 200, DESCRIPTION
    if index is None:
        return 503, {"error": "no index"}
    if url.path == "/config":
        return 200, {"chunks": index.chunks.count(), "definitions": index.definitions.count(), "files": index.chunks.agg(F.countDistinct("path")).first()[0], "dimension": index.encoder.dim}
    if url.path != "/search":
        return 404, {"error": "not found"}
    top_k, scope = args.get("top_k", "5"), args.get("scope", "engine")
    if not args.get("q", "").strip() or not top_k.isdigit() or not 1 <= int(top_k) <= 100 or scope not in SCOPES:
        return 400, {"error": "q, top_k from 1 to 100, and scope are needed", **DESCRIPTION}
    if (model := args.get("model")) and (model not in index.encoders or index.encoders[model].dim != index.encoder.dim):
        return 400, {"error": f"model {model} isn't known, or of another dimension than the index"}
    given = args["q"], int(top_k), scope, model
    return 200, gatherer.search(*given) if gatherer else search(spark, index, *given)


def serve(spark: SparkSession, index: Index | None, host: str = "127.0.0.1", port: int = 8765) -> ThreadingHTTPServer:
    """A server that is ready to run; serve_forever() runs it. Its gatherer ends with the process, or by ``server.gatherer.close()``."""
    gatherer = Gatherer(spark, index) if index else None

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = respond(spark, index, self.path, gatherer)
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    server.gatherer = gatherer
    return server
