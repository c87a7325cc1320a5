"""Questions over HTTP: ``GET /health`` and ``POST /query`` with ``{"query": "..."}``, answered by one running session."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame

from quarryline.operators import pipeline, retrieval
from quarryline.providers import Embedder, Generator


def answer_one(query: str, corpus: DataFrame, embedder: Embedder, generator: Generator, k: int = 5) -> dict[str, object]:
    """text, action_code, status and sources of one question."""
    asked = corpus.sparkSession.createDataFrame([(0, query)], "query_id long, query string")
    found, _ = pipeline.answer_questions(asked, corpus, embedder, generator, k)
    r = found.first()  # a row for each question
    return {"text": r["text"], "action_code": r["action_code"], "status": r["status"], "sources": [s.asDict() for s in r["sources"]]}


def server(corpus: DataFrame, embedder: Embedder, generator: Generator, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server over ``corpus``; ``serve_forever`` runs it.  A body that isn't JSON with a text ``query`` is answered with 400."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: dict[str, object]) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path != "/health":
                return self.reply(404, {"error": "not found"})
            state = retrieval.health(corpus)
            self.reply(200 if state["status"] == "ok" else 503, state)

        def do_POST(self) -> None:
            if self.path != "/query":
                return self.reply(404, {"error": "not found"})
            try:
                query = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))["query"]
                if not isinstance(query, str):
                    raise TypeError("query is no text")
            except (ValueError, KeyError, TypeError) as e:
                return self.reply(400, {"error": str(e)})
            self.reply(200, answer_one(query, corpus, embedder, generator))

        def log_message(self, *_: object) -> None:
            """No lines on stderr for each request."""

    return ThreadingHTTPServer((host, port), Handler)
