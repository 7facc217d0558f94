"""Embedding texts in batches through a pluggable provider, and a small cache for query vectors."""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Callable, Sequence
from concurrent.futures import Future
from threading import Lock

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts per call and characters per text.
BATCH, MAX_CHARS = 64, 8000
Embedder = Callable[[Sequence[str]], list[list[float]]]


def hashing_embedder(texts: Sequence[str], dim: int = 64) -> list[list[float]]:
    """An offline stand-in: signed feature hashing of the words, unit length; equal texts give equal vectors."""
    out = []
    for text in texts:
        v = [0.0] * dim
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            v[h % dim] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v))
        out.append([x / norm for x in v] if norm else v)
    return out


def embed(text: Column, embedder: Embedder | None) -> Column:
    """Vectors of a text column in batches; null and blank texts, or no provider, give null."""
    if embedder is None:
        return F.lit(None).cast("array<float>")

    def run(part: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(part), index=part.index, dtype=object)
        todo = [i for i, t in part.items() if t is not None and str(t).strip()]
        for k in range(0, len(todo), BATCH):
            batch = todo[k : k + BATCH]
            for i, v in zip(batch, embedder([part[i][:MAX_CHARS] for i in batch])):
                out[i] = v
        return out

    return F.pandas_udf(run, "array<float>")(text)


def fill_missing(rows: DataFrame, text: Column, embedder: Embedder | None) -> DataFrame:
    """Rows whose embedding is null get one; the others keep theirs. Run again, it heals what failed before."""
    missing = rows.filter("embedding IS NULL").withColumn("embedding", embed(text, embedder))
    return rows.filter("embedding IS NOT NULL").unionByName(missing)


class QueryCache:
    """The last ``size`` query vectors; callers that ask for the same text at once share one call; failures are not kept."""

    def __init__(self, embedder: Embedder, size: int = 256):
        self.embedder, self.size = embedder, size
        self._kept: OrderedDict[str, Future] = OrderedDict()
        self._lock = Lock()

    def __call__(self, text: str) -> list[float]:
        with self._lock:
            future = self._kept.get(text)
            mine = future is None
            if mine:
                future = self._kept[text] = Future()
            self._kept.move_to_end(text)
            while len(self._kept) > self.size:
                self._kept.popitem(last=False)
        if mine:
            try:
                future.set_result(self.embedder([text[:MAX_CHARS]])[0])
            except BaseException as failed:
                with self._lock:
                    self._kept.pop(text, None)
                future.set_exception(failed)
        return future.result()
