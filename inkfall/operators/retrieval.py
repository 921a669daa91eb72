"""Search among chunks: metadata filter, cosine similarity, the best k."""

from __future__ import annotations

import json
import time
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from itertools import chain, starmap
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfall.functions.text import cosine

#: Gives a vector for each of the texts of a call. Its `array`, where it has one, gives the same as one array of numpy.
Provider = Callable[[list[str]], list[list[float]]]

PASSAGE_PREFIX, QUERY_PREFIX = "passage: ", "query: "
BATCH, RETRIES, IN_FLIGHT = 32, 3, 4


def metadata_filter(filters: dict | None, metadata_col: str = "metadata") -> Column:
    """All keys of the top level equal, as strings."""
    out = F.lit(True)
    for key, value in (filters or {}).items():
        path = "$['" + key.replace("'", "\\'") + "']"
        out = out & (F.get_json_object(metadata_col, path) == F.lit(str(value)))
    return out


def passing(error: Exception) -> bool:
    """Whether a provider's error may go away by itself: not a wrong key, model or input."""
    return _kind_of(str(error)) not in ("auth", "not_found", "bad_request")


class Calls:
    """Calls of a provider, `in_flight` of them going at once. What they give comes in their order.

    With 0 each is made in the caller's thread, as suits a provider that computes by itself: threads
    would only wait for each other.
    """

    def __init__(self, provider: Provider, retries: int, wait: float, in_flight: int) -> None:
        self.provider, self.retries, self.wait, self.in_flight = provider, retries, wait, in_flight
        self.pool, self.going = ThreadPoolExecutor(in_flight or 1), deque[tuple[Any, Future]]()

    def __enter__(self) -> Calls:
        return self

    def __exit__(self, *_: object) -> None:
        self.pool.shutdown(cancel_futures=True)

    def _call(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(1, self.retries + 1):
            try:
                vectors = self.provider(texts)
                break
            except Exception as error:
                if attempt == self.retries or not passing(error):
                    raise RuntimeError(f"Embedding 失败，已重试 {attempt} 次: {error}") from error
                time.sleep(self.wait * 2 ** (attempt - 1))
        if len(vectors) != len(texts):
            raise RuntimeError(f"the provider gave {len(vectors)} vectors for {len(texts)} texts")
        return vectors

    def _done(self) -> tuple[Any, list[list[float]]]:
        beside, vectors = self.going.popleft()
        return beside, vectors.result()

    def put(self, beside: Any, texts: list[str]) -> Iterator[tuple[Any, list[list[float]]]]:
        """Starts a call, after giving what came with the first one going, and its vectors, where no more may go."""
        if not self.in_flight:
            yield beside, self._call(texts)
            return
        if len(self.going) == self.in_flight:
            yield self._done()
        self.going.append((beside, self.pool.submit(self._call, texts)))

    def rest(self) -> Iterator[tuple[Any, list[list[float]]]]:
        while self.going:
            yield self._done()


def embed_texts(df: DataFrame, text_col: str, provider: Provider, prefix: str = PASSAGE_PREFIX, batch: int = BATCH, retries: int = RETRIES, wait: float = 1.0, in_flight: int = IN_FLIGHT) -> DataFrame:
    """df with `vector`. The provider gets `batch` texts a call, whatever the sizes of Arrow's batches.

    Each task keeps up to `in_flight` calls going at once and gives its rows in order, so it holds no
    more than so many calls' rows. A call that fails is made again, with a wait that doubles, `retries`
    times in all, unless its error says that this cannot help. The provider must bear calls from
    several threads.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def full_calls(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows in frames of one call each; only the last may be smaller."""
        rest: list[pd.DataFrame] = []
        held = 0
        for frame in frames:
            rest.append(frame)
            held += len(frame)
            if held >= batch:
                whole = pd.concat(rest, ignore_index=True)
                cut = held - held % batch
                yield from (whole.iloc[i : i + batch] for i in range(0, cut, batch))
                rest, held = [whole.iloc[cut:]], held - cut
        if held:
            yield pd.concat(rest, ignore_index=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told = lambda rows, vectors: rows.assign(vector=pd.Series(vectors, index=rows.index, dtype=object))
        with Calls(provider, retries, wait, in_flight) as calls:
            for rows in full_calls(frames):
                yield from starmap(told, calls.put(rows, [prefix + (t or "") for t in rows[text_col]]))
            yield from starmap(told, calls.rest())

    return df.mapInPandas(run, schema)


@dataclass(frozen=True)
class Embedding:
    """embed_texts with a provider, as an embedder. Operators that have texts in Python already call
    the provider there, in the same way, and need no table of vectors.
    """

    provider: Provider
    prefix: str = PASSAGE_PREFIX
    batch: int = BATCH
    retries: int = RETRIES
    wait: float = 1.0
    in_flight: int = IN_FLIGHT

    def __call__(self, df: DataFrame, text_col: str) -> DataFrame:
        return embed_texts(df, text_col, self.provider, self.prefix, self.batch, self.retries, self.wait, self.in_flight)

    def calls(self) -> Calls:
        return Calls(getattr(self.provider, "array", self.provider), self.retries, self.wait, self.in_flight)


class _HashedVectors:
    def __init__(self, dim: int) -> None:
        self.dim = dim

    def array(self, texts: list[str]) -> np.ndarray:
        words = [text.lower().split() for text in texts]
        h = np.fromiter(map(zlib.crc32, map(str.encode, chain.from_iterable(words))), np.int64)
        # A row of a text holds what adds, and after it what takes off.
        at = np.repeat(np.arange(len(texts)) * (2 * self.dim), [len(w) for w in words]) + h % self.dim + np.where(h >> 16 & 1, 0, self.dim)
        counts = np.bincount(at, minlength=len(texts) * 2 * self.dim).reshape(len(texts), 2, self.dim)
        return (counts[:, 0] - counts[:, 1]).astype(float)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return self.array(texts).tolist()


def hashed_vectors(dim: int = 64) -> Provider:
    """A provider that needs no model: signed counts of hashed words. For tests and offline use."""
    return _HashedVectors(dim)


def health_check(provider: Callable[[list[str]], list[list[float]]]) -> tuple[bool, str]:
    try:
        return True, f"ok, dim={len(provider(['ping'])[0])}"
    except Exception as error:
        return False, str(error)


def _kind_of(error: str) -> str:
    """The kind of a provider's error, by what its text says; the first that fits."""
    low = error.lower()
    if "401" in error or "unauthorized" in low:
        return "auth"
    if "connect" in low:
        return "connection"
    if "rate" in low or "quota" in low:
        return "rate_limit"
    if "model" in low and "not found" in low:
        return "not_found"
    if "400" in error and "input" in low:
        return "bad_request"
    return "unknown"


def test_embedding(provider: Callable[[list[str]], list[list[float]]], text: str = "ping") -> dict:
    """Dimension and a preview of a vector, or the kind of the error."""
    try:
        vector = provider([text])[0]
    except Exception as error:
        return {"success": False, "error": _kind_of(str(error)), "message": str(error)[:200]}
    shown = [f"{x:.4f}" for x in vector]
    return {"success": True, "dim": len(vector), "preview": f"[{shown[0]}, {shown[1]}, ..., {shown[-1]}]" if len(shown) > 2 else f"[{', '.join(shown)}]"}


def search(chunks: DataFrame, query: list[float], top_k: int = 10, filters: dict | None = None, vector_col: str = "vector", id_col: str = "chunk_id") -> DataFrame:
    """The top_k chunks by cosine similarity, ties by id: text up to 500 characters, score to 4 places."""
    if not 1 <= top_k <= 100:
        raise ValueError("top_k must be from 1 to 100")
    near = chunks.where(F.col(vector_col).isNotNull())
    near = near.where(metadata_filter(filters)) if filters else near
    literal = F.array(*[F.lit(float(x)) for x in query])
    best = near.withColumn("_score", cosine(F.col(vector_col), literal)).orderBy(F.desc("_score"), id_col).limit(top_k)
    shown = [F.substring("text", 1, 500).alias("text")] if "text" in chunks.columns else []
    meta = [F.coalesce("metadata", F.lit("{}")).alias("metadata")] if "metadata" in chunks.columns else []
    owner = [F.col("doc_id").cast("string").alias("doc_id")] if "doc_id" in chunks.columns else []
    return best.select(F.col(id_col).cast("string").alias("chunk_id"), *owner, *shown, *meta, F.round("_score", 4).alias("score"))


def embed_query(provider: Callable[[list[str]], list[list[float]]], query: str) -> list[float]:
    """The vector of a query, which the provider gets after QUERY_PREFIX; empty if it gives none."""
    found = provider([QUERY_PREFIX + query])
    return list(found[0]) if found else []


def retrieve(chunks: DataFrame, query: str, provider: Callable[[list[str]], list[list[float]]], top_k: int = 10, filters: dict | None = None, vector_col: str = "vector", id_col: str = "chunk_id") -> dict:
    """The query, total_results and results, of which there are top_k (100 at most)."""
    found = search(chunks, embed_query(provider, query), top_k, filters, vector_col, id_col).collect()
    results = [r.asDict() | ({"metadata": json.loads(r.metadata)} if "metadata" in r else {}) for r in found]
    return {"query": query, "total_results": len(results), "results": results}


def score_band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.5, "good").when(score >= 0.3, "fair").otherwise("low")
