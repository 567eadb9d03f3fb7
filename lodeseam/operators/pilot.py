"""Events of the usage log, as the reports read them: what was searched, tasks, activations, retention and misses."""

from __future__ import annotations

import hashlib
import hmac
import time
import uuid

from .usage import ACTIVATION_CHECKS


def payload(field: str, text: str | None, salt: bytes, raw: bool = False) -> dict:
    """Length and keyed id of a text, and the text itself only if asked for."""
    if text is None:
        return {}
    out = {f"{field}_length": len(text), f"{field}_id": hmac.new(salt, text.encode(), hashlib.sha256).hexdigest()[:16]}
    return {**out, **({field: text} if raw else {})}


def event(kind: str, **fields) -> dict:
    return {"ts": time.time(), "event": kind, **{k: v for k, v in fields.items() if v is not None}}


def search(query: str, results: list[dict], latency_ms: float, salt: bytes, tool: str = "cli", **filters) -> dict:
    text = payload("query", query, salt)
    return event(
        "search", tool=tool, **text, latency_ms=latency_ms, result_count=len(results), top_paths=[r["path"] for r in results[:5]], top_repos=[r["repo_id"] for r in results[:5]],
        stale_count=sum(bool(r.get("is_stale")) for r in results), dirty_count=sum(bool(r.get("has_dirty_tracked_files")) for r in results), **filters,
    )


def task_start(engineer: str, task: str, salt: bytes, task_class: str | None = None, repos: list[str] | None = None) -> dict:
    return event("task_start", task_id=f"task-{uuid.uuid4().hex[:12]}", engineer=engineer, task_class=task_class, repos=repos or [], task_length=payload("task", task, salt)["task_length"])


def task_end(task_id: str, engineer: str, baseline_source: str, notes: str | None, salt: bytes, **numbers) -> dict:
    return event("task_end", task_id=task_id, engineer=engineer, baseline_source=baseline_source, **numbers, **payload("notes", notes, salt))


def activation(engineer: str, client: str, checks: dict[str, bool], notes: str | None, salt: bytes, repo: str | None = None) -> dict:
    return event("activation", engineer=engineer, client=client, repo=repo, **{c: bool(checks.get(c)) for c in ACTIVATION_CHECKS}, **payload("notes", notes, salt))


def retention(engineer: str, enabled: bool, week2: bool, notes: str | None, salt: bytes) -> dict:
    return event("retention", engineer=engineer, enabled=enabled, week2=week2, **payload("notes", notes, salt))


def miss(raw_query: str, scrubbed_query: str, expected_path: str | None, expected_text: str | None, notes: str | None, salt: bytes) -> dict:
    texts = {**payload("raw_query", raw_query, salt), **payload("expected_text", expected_text, salt), **payload("notes", notes, salt)}
    return event("miss", scrubbed_query=scrubbed_query, expected_path=expected_path, **texts)
