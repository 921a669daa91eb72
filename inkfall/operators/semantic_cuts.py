"""Semantic chunks in one pass over the documents, for a provider that is called where the texts are.

Texts go through in the order of their rows: sentences are told, what stands around each goes to the
provider in full calls, across documents, and of the vectors that come back only those of one call are
held, as each is compared with the next one only. All sums have the order that Spark's have, so that
breaks are the same as semantic.py finds by rows of sentences.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from itertools import pairwise, zip_longest
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from inkfall.operators.retrieval import Embedding

#: Sentences with the white space around them: an end belongs to the sentence before it.
_PART = re.compile(r"[^。！？.!?\n]++[。！？.!?\n]?|[。！？.!?\n]")
_CHUNK = (("chunk_index", T.IntegerType()), ("text", T.StringType()), ("char_start", T.IntegerType()), ("char_end", T.IntegerType()))
#: Characters and rows that are given on at once, about.
_CHARACTERS, _ROWS = 1 << 22, 4096


def sentences(text: str) -> tuple[list[str], list[int]]:
    """Sentences without the white space around them, blanks left out, and where each ends in the text."""
    said, ends, at = [], [], 0
    for part in _PART.findall(text):
        whole = part.rstrip()
        if whole:
            said.append(whole.lstrip())
            ends.append(at + len(whole))
        at += len(part)
    return said, ends


def _similarity(a: list | None, b: list | None) -> float | None:
    """As functions.text.cosine has it, for vectors that may be null, hold nulls or differ in length."""
    if a is None or b is None:
        return None

    def dot(x: list, y: list) -> float | None:
        total = 0.0
        for p, q in zip_longest(x, y):
            if p is None or q is None:
                return None
            total += float(p) * float(q)
        return total

    aa, bb, ab = dot(a, a), dot(b, b), dot(a, b)
    norm = None if aa is None or bb is None else math.sqrt(aa) * math.sqrt(bb)
    if norm is None or norm <= 0:
        return 0.0
    return None if ab is None else ab / norm


class Neighbours:
    """Similarities of vectors, which come a call's at a time, with the one before each; the first one's is null."""

    def __init__(self) -> None:
        self.last: Any = None
        self.first = True

    def of(self, vectors: list[list[float]] | np.ndarray) -> list[float | None]:
        first, last = self.first, self.last
        self.first = False
        try:
            now = np.asarray(vectors, dtype=np.float32).astype(np.float64)
            plain = now.ndim == 2 and (first or isinstance(last, np.ndarray) and len(last) == now.shape[1]) and not np.isnan(now).any()
        except (TypeError, ValueError):  # nulls among them, or lengths that differ
            plain = False
        if not plain:
            rows = [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vectors]
            found = [_similarity(a, b) for a, b in zip([last, *rows[:-1]], rows, strict=True)]
            self.last = rows[-1] if rows[-1] is None or None in rows[-1] else np.array(rows[-1])
            return found
        rows, self.last = now if first else np.vstack((last, now)), now[-1]
        # accumulate() adds one after the other, which sum() does not.
        dots = lambda x, y: np.add.accumulate(x * y, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))
        own = np.sqrt(dots(rows, rows))
        norms = own[:-1] * own[1:]
        with np.errstate(all="ignore"):
            found = np.where(norms <= 0, 0.0, dots(rows[:-1], rows[1:]) / norms).tolist()
        return [None, *found] if first else found


def _share(ordered: list[float], q: float) -> float:
    position = (len(ordered) - 1) * q
    lower, higher = math.floor(position), math.ceil(position)
    a, b = ordered[lower], ordered[higher]
    return a if a == b or lower == higher else (higher - position) * a + (position - lower) * b


def threshold(distances: list[float], method: str, amount: float) -> float:
    """What semantic.threshold gives for a document's distances, of which there is one at least."""
    ordered = np.sort(np.array(distances)).tolist()  # what is not a number comes last, as in Spark
    if method == "percentile":
        return _share(ordered, amount / 100)
    total = n = mean = spread = 0.0
    for x in distances:
        total, n, delta = total + x, n + 1, x - mean
        mean += delta / n
        spread += delta * (delta - delta / n)
    if method == "standard_deviation":
        return total / n + amount * math.sqrt(spread / n)
    return total / n + amount * (_share(ordered, 0.75) - _share(ordered, 0.25))


def breaks(distances: list[float | None], method: str, amount: float) -> list[int]:
    """Places of distances above the threshold. What is not a number is above all numbers, as in Spark."""
    known = [d for d in distances if d is not None]
    if not known:
        return []
    limit = threshold(known, method, amount)
    if math.isnan(limit):
        return []
    return [i for i, d in enumerate(distances) if d is not None and (d > limit or math.isnan(d))]


def cut(docs: DataFrame, embed: Embedding, method: str, amount: float, buffer_size: int) -> DataFrame:
    """(id, chunk_index, text, char_start, char_end) of documents (id, text)."""
    if buffer_size < 0 or method == "percentile" and not 0 <= amount <= 100:
        raise ValueError(f"buffer_size {buffer_size}, {method} {amount}")
    schema = T.StructType([docs.schema.fields[0], *(T.StructField(name, kind) for name, kind in _CHUNK)])
    places = [to_arrow_type(f.dataType) for f in schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[tuple[Any, str | None, list[int]]] = deque()  # documents in order, and the ends of their sentences
        found: deque[float | None] = deque()  # similarities that belong to them
        near = Neighbours()

        def ready() -> Iterator[tuple]:
            """Chunks of the documents whose vectors have all come."""
            while waiting and len(found) >= len(waiting[0][2]):
                doc, text, ends = waiting.popleft()
                alike = [found.popleft() for _ in ends][1:]
                cuts = breaks([None if s is None else 1.0 - s for s in alike], method, amount) if ends else []
                bounds = [0, *(ends[i] for i in cuts), len(text or "")]
                for i, (a, b) in enumerate(pairwise(bounds)):
                    yield doc, i, None if text is None else text[a:b], a, b

        def rows() -> Iterator[tuple]:
            asked: list[str] = []
            with embed.calls() as calls:
                for batch in batches:
                    kinds[:] = [batch.schema.field(0).type, *places]
                    for doc, text in zip(*batch.columns, strict=True):
                        text = text.as_py()
                        said, ends = sentences(text or "")
                        many = len(ends) > 3
                        waiting.append((doc.as_py(), text, ends if many else []))
                        for i in range(len(said) if many else 0):
                            asked.append(embed.prefix + " ".join(said[max(0, i - buffer_size) : i + buffer_size + 1]))
                            if len(asked) == embed.batch:
                                for _, vectors in calls.put(None, asked):
                                    found.extend(near.of(vectors))
                                asked = []
                        yield from ready()
                if asked:
                    for _, vectors in calls.put(None, asked):
                        found.extend(near.of(vectors))
                for _, vectors in calls.rest():
                    found.extend(near.of(vectors))
            yield from ready()

        def told(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], schema.names)

        kinds: list[pa.DataType] = []
        some, size = [], 0
        for row in rows():
            some.append(row)
            size += len(row[2] or "")
            if len(some) == _ROWS or size >= _CHARACTERS:
                yield told(some)
                some, size = [], 0
        if some:
            yield told(some)

    return docs.mapInArrow(run, schema)
