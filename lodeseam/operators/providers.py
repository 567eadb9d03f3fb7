"""Embedding providers over HTTP, and how one is chosen. Clients are pickled to the workers and open no connection before."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor

from .embedding import HashProvider, Provider

#: Answers after which a request is tried again.
AGAIN = {408, 409, 429, 500, 502, 503, 504}


def pause(attempt: int, retry_after: str | None, base: float = 0.5, most: float = 30.0) -> float:
    """Seconds to wait: what the server asks for, else twice as long with every attempt."""
    try:
        return min(most, max(0.0, float(retry_after)))
    except (TypeError, ValueError):
        return min(most, base * 2**attempt)


def post(url: str, body: dict, headers: dict[str, str] | None = None, timeout: float = 60.0, attempts: int = 4, base: float = 0.5) -> dict:
    data = json.dumps(body).encode()
    for attempt in range(attempts):
        request = urllib.request.Request(url, data, {"Content-Type": "application/json", **(headers or {})})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or attempt == attempts - 1:
                raise RuntimeError(f"{url} answered {e.code}") from e
            time.sleep(pause(attempt, e.headers.get("Retry-After"), base))
        except urllib.error.URLError as e:
            if attempt == attempts - 1:
                raise RuntimeError(f"{url}: {e.reason}") from e
            time.sleep(pause(attempt, None, base))
    raise RuntimeError(url)


class OllamaProvider:
    """A local model server: one request a batch, or one a text in threads where the server knows no batches."""

    def __init__(self, model: str, dimensions: int, url: str = "http://127.0.0.1:11434", threads: int = 4) -> None:
        self.model, self.dimensions, self.url, self.threads = model, dimensions, url.rstrip("/"), threads
        self.model_id = f"ollama:{model}"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        try:
            return post(f"{self.url}/api/embed", {"model": self.model, "input": texts}, attempts=1)["embeddings"]
        except RuntimeError as e:
            if "404" not in str(e):
                raise
        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(lambda t: post(f"{self.url}/api/embeddings", {"model": self.model, "prompt": t})["embedding"], texts))


class OpenAIProvider:
    """A hosted service; the key is read from the environment where it is used, never pickled."""

    def __init__(self, model: str = "text-embedding-3-small", dimensions: int = 1536, url: str = "https://api.openai.com/v1", base: float = 0.5) -> None:
        self.model, self.dimensions, self.url, self.base = model, dimensions, url.rstrip("/"), base
        self.model_id = f"openai:{model}"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        key = os.environ.get("OPENAI_API_KEY", "")
        rows = post(f"{self.url}/embeddings", {"model": self.model, "input": texts}, {"Authorization": f"Bearer {key}"}, base=self.base)["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]


class SentenceProvider:
    """A model of the sentence-transformers library, loaded in the worker where it is installed."""

    def __init__(self, model: str, dimensions: int) -> None:
        self.model, self.dimensions, self.model_id = model, dimensions, f"sentence:{model}"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        if not hasattr(self, "_loaded"):
            from sentence_transformers import SentenceTransformer

            self._loaded = SentenceTransformer(self.model)
        return [list(map(float, v)) for v in self._loaded.encode(texts)]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_loaded"}


def answers(provider: Provider) -> bool:
    try:
        return len(provider.embed_batch(["x"])[0]) == provider.dimensions
    except Exception:
        return False


def choose(kind: str = "hash", model: str | None = None, dimensions: int | None = None, url: str | None = None) -> Provider:
    """hash, ollama, openai, sentence, or auto: the first local model that answers (mxbai-embed-large, nomic-embed-text),
    else hash."""
    where = {"url": url} if url else {}
    if kind == "auto":
        local = [OllamaProvider("mxbai-embed-large", 1024, **where), OllamaProvider("nomic-embed-text", 768, **where)]
        return next((p for p in local if answers(p)), HashProvider(dimensions or 256))
    if kind == "ollama":
        return OllamaProvider(model or "mxbai-embed-large", dimensions or 1024, **where)
    if kind == "openai":
        return OpenAIProvider(model or "text-embedding-3-small", dimensions or 1536, **where)
    if kind == "sentence":
        return SentenceProvider(model or "BAAI/bge-small-en-v1.5", dimensions or 384)
    if kind == "hash":
        return HashProvider(dimensions or 256)
    raise ValueError(f"no provider of kind {kind}")
