"""Embedding providers as a plug-in, keyed text ids, and the cache key of a query embedding."""

from __future__ import annotations

import hashlib
import hmac
import math
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import blake_place

BATCH = 64


class Provider(Protocol):
    """What embeds texts; it is pickled to the workers, so it opens connections when first used."""

    model_id: str
    dimensions: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """Signed hash buckets of tokens; needs no network."""

    def __init__(self, dimensions: int = 256) -> None:
        self.dimensions = dimensions
        self.model_id = f"hash-v1:dims={dimensions}"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        import re

        out = []
        for text in texts:
            vector = [0.0] * self.dimensions
            for word in re.findall("[A-Za-z_][A-Za-z0-9_]*|[0-9]+", text):
                for part in re.sub("([A-Z])", r"_\1", word).lower().split("_"):
                    if part:
                        bucket, sign = blake_place(part, self.dimensions)
                        vector[bucket] += sign
            out.append(vector)
        return out


def embed(texts: DataFrame, key: str, text: str, provider: Provider, most_chars: int = 0, batch: int = BATCH) -> DataFrame:
    """(key, embedding, error): vectors of length one; blank texts give zeros without a call. A batch that fails is tried
    text by text; a text that fails gives null and its error. A vector of other than `dimensions` numbers is an error."""
    kind = texts.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])

    def checked(vectors: list[list[float]], n: int) -> list[list[float]]:
        if len(vectors) != n or any(len(v) != provider.dimensions for v in vectors):
            raise ValueError("wrong number or size of vectors")
        return [[x / s for x in v] if (s := math.sqrt(sum(x * x for x in v))) else list(v) for v in vectors]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = [("" if t is None else t)[: most_chars or None] for t in frame[text]]
            out: list[tuple[list[float] | None, str | None]] = [([0.0] * provider.dimensions, None)] * len(values)
            wanted = [i for i, t in enumerate(values) if t.strip()]
            for at in range(0, len(wanted), batch):
                part = wanted[at : at + batch]
                try:
                    for i, v in zip(part, checked(provider.embed_batch([values[i] for i in part]), len(part))):
                        out[i] = (v, None)
                except Exception:
                    for i in part:
                        try:
                            out[i] = (checked(provider.embed_batch([values[i]]), 1)[0], None)
                        except Exception as e:
                            out[i] = (None, str(e)[:200])
            yield pd.DataFrame({key: frame[key], "embedding": [v for v, _ in out], "error": [e for _, e in out]})

    return texts.select(key, text).mapInPandas(run, schema)


def keyed_id(text: Column | str, salt: bytes, length: int = 64) -> Column:
    """Hex HMAC-SHA256 of a text, cut to `length`; null stays null."""

    @F.pandas_udf(T.StringType())
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(salt, v.encode(), hashlib.sha256).hexdigest()[:length])

    return digest(text)


def text_payload(text: Column | str, salt: bytes, raw: bool = False) -> Column:
    """(length, id, raw): what a log may say of a text; the text itself only if asked for."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.isNotNull(), F.struct(F.length(text).alias("length"), keyed_id(text, salt, 16).alias("id"), (text if raw else F.lit(None).cast("string")).alias("raw")))
