"""JSON-RPC over HTTP: chunk_file, chunk_directory, build_graph and semantic_chunk."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kerf.functions import sizing
from kerf.operators import analytics, semantic
from kerf.operators.chunking import chunk
from kerf.plans.options import CHUNK_SCHEMA
from kerf.sources import files


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


def call(spark: SparkSession, method: str, params: dict):
    options = params.get("options") or {}
    if method == "chunk_file":
        with open(params["path"], "rb") as f:
            return _rows(chunk(spark.createDataFrame([(0, params["path"], f.read())], "doc_id bigint, path string, content binary"), **options))
    if method == "chunk_directory":
        return _rows(files.chunk_directory(spark, params["path"], glob=params.get("glob", "**/*"), exclude=tuple(params.get("exclude", ())), **options))
    if method == "build_graph":
        chunks = spark.createDataFrame(params["chunks"], CHUNK_SCHEMA).withColumn("key", F.concat_ws("/", "filepath", "index"))
        mentions = chunks.select("key", F.explode("entities.name").alias("name"))
        least = int(params.get("min_chunks", 2))
        return {"nodes": _rows(analytics.graph_nodes(mentions, least)), "edges": _rows(analytics.graph_edges(mentions, least)), "chunk_count": len(params["chunks"])}
    if method == "semantic_chunk":
        docs = spark.createDataFrame([(0, params["content"])], "doc_id bigint, text string")
        return _rows(semantic.semantic_chunks(docs, sizing.mock_embedding, int(params.get("max_size", 1500))))
    raise LookupError(method)


def handle(spark: SparkSession, body: bytes) -> dict:
    """The answer to one request; codes are those of JSON-RPC."""

    def error(code: int, message: str, key=None) -> dict:
        return {"jsonrpc": "2.0", "id": key, "error": {"code": code, "message": message}}

    try:
        request = json.loads(body)
    except ValueError:
        return error(-32700, "not JSON")
    if not isinstance(request, dict) or not isinstance(request.get("method"), str) or not isinstance(request.get("params", {}), dict):
        return error(-32600, "not a request")
    key = request.get("id")
    try:
        return {"jsonrpc": "2.0", "id": key, "result": call(spark, request["method"], request.get("params", {}))}
    except LookupError as e:
        return error(-32601 if not isinstance(e, KeyError) else -32602, f"unknown or missing: {e}", key)
    except Exception as e:
        return error(-32000, f"{type(e).__name__}: {e}", key)


def serve(spark: SparkSession, host: str, port: int) -> None:
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.dumps(handle(spark, self.rfile.read(int(self.headers.get("Content-Length", 0)))), default=str).encode()
            self.send_response(200)
            for name, value in (("Content-Length", len(body)), ("Content-Type", "application/json")):
                self.send_header(name, str(value))
            self.end_headers()
            self.wfile.write(body)

    HTTPServer((host, port), Handler).serve_forever()
