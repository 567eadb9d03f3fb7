"""The engine as tools for an assistant: search_code, get_symbol, list_repos and reindex, over JSON-RPC lines."""

from __future__ import annotations

import json
from typing import IO

from .engine import Engine

TOOLS = {
    "search_code": ("Search the indexed code", {"query": "string", "k": "integer", "repo": "string", "path_prefix": "string", "language": "string"}, ["query"]),
    "get_symbol": ("The definition of a symbol", {"name": "string"}, ["name"]),
    "list_repos": ("The indexed repositories and their state", {}, []),
    "reindex": ("Index a repository again", {"path": "string"}, []),
}


class Tools:
    def __init__(self, engine: Engine) -> None:
        self.engine = engine

    def search_code(self, query: str, k: int = 10, repo: str | None = None, path_prefix: str | None = None, language: str | None = None) -> list[dict]:
        asked = self.engine.spark.createDataFrame([(1, query)], "query_id long, query_text string")
        found = self.engine.search(asked, k, repo, path_prefix, language)
        rows = self.engine.with_state(found, self.engine.probed_heads()).orderBy("position").collect()  # at most k
        kept = ("repo_id", "path", "start_line", "end_line", "score", "language", "symbol_name", "symbol_kind", "symbol_line", "symbol_confidence", "is_stale", "has_dirty_tracked_files")
        return [{**{c: r[c] for c in kept}, "snippet": r.content} for r in rows]

    def get_symbol(self, name: str) -> dict | None:
        found = self.engine.symbol(self.engine.spark.createDataFrame([(name,)], "name string"))
        row = found.join(self.engine.table("chunks").select("chunk_id", "repo_id", "content", "end_line"), "chunk_id").first()
        return row and {"repo_id": row.repo_id, "path": row.path, "start_line": row.start_line, "end_line": row.end_line, "symbol_name": row.symbol_name, "score": row.score, "definition": row.content}

    def list_repos(self) -> list[dict]:
        rows = self.engine.list_repos(self.engine.probed_heads()).collect()  # a row for each repository
        return [json.loads(json.dumps(r.asDict(), default=str)) for r in rows]

    def reindex(self, path: str | None = None) -> dict:
        return self.engine.reindex(path)


def answer(tools: Tools, request: dict) -> dict | None:
    """The answer to one request; none to a notification."""
    if "id" not in request:
        return None
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        result: object = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodeseam", "version": "1"}}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {p: {"type": t} for p, t in fields.items()}, "required": needed}} for n, (d, fields, needed) in TOOLS.items()]}
    elif method == "tools/call" and params.get("name") in TOOLS:
        try:
            made = getattr(tools, params["name"])(**(params.get("arguments") or {}))
            result = {"content": [{"type": "text", "text": json.dumps(made, default=str)}], "isError": False}
        except Exception as e:
            result = {"content": [{"type": "text", "text": str(e)[:500]}], "isError": True}
    else:
        return {"jsonrpc": "2.0", "id": request["id"], "error": {"code": -32601, "message": f"no method {method}"}}
    return {"jsonrpc": "2.0", "id": request["id"], "result": result}


def serve(engine: Engine, source: IO[str], sink: IO[str]) -> None:
    tools = Tools(engine)
    for line in source:
        if line.strip() and (made := answer(tools, json.loads(line))) is not None:
            sink.write(json.dumps(made) + "\n")
            sink.flush()
