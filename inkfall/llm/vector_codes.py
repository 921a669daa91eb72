"""Vector codes: integer product quantisation, with nearest entries found in the Walsh-Hadamard domain.

Each vector is scaled to integers and cut into PARTS equal consecutive parts; each part position has a
codebook of up to ENTRIES entries, which starts as the parts of the vectors with the smallest ids and
is refined by ROUNDS of assignment and integer means. A vector's code is the index of each part's
nearest entry, ties to the lower one.

To find it, parts and entries are padded with zeros to a power of two and transformed by the unscaled
Walsh-Hadamard transform, whose rows stand in order of sequency. The transform of width P multiplies
squared distances by P, exactly and in integers, and puts most of a smooth part's energy first. So
squared differences are added up sequency by sequency; after each of a few steps one entry's distance
bounds the least, and entries whose sum so far is beyond it are dropped for that part. What is left at
the end is the exact distance times P.

Every round is one pass over the vectors: tasks assign their own and pass on a sum and a count for each
component of each entry, which Spark adds up. Codebooks are ENTRIES times the vector's length integers,
so they fit the driver and the tasks' closures at any number of vectors.

Defined results: a vector that is null, empty or holds null or non-finite components takes no part. The
length is that of the kept vector with the smallest id; vectors of another length cannot be compared
with it and take no part either. A length that PARTS does not divide is filled up with zeros. Ids may
repeat; the first vectors are those of the smallest ids, and of one id those of the least components;
a null id comes last. With fewer than ENTRIES vectors the codebooks are as much smaller. Components
whose squared distances could leave 64 bits raise an error. Null labels are one label. Other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors that are compared at a time; it bounds a task's memory.
_ROWS = 4096


def sequency_matrix(width: int) -> np.ndarray:
    """The unscaled Walsh-Hadamard matrix, its rows by their number of changes of sign."""
    matrix = np.ones((1, 1), np.int64)
    while len(matrix) < width:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return matrix[np.argsort((matrix[:, 1:] != matrix[:, :-1]).sum(1), kind="stable")]


def transformed(parts: np.ndarray) -> np.ndarray:
    """Rows of integers in the Walsh-Hadamard domain."""
    width = 1 << max(0, parts.shape[-1] - 1).bit_length()
    padded = np.zeros((*parts.shape[:-1], width), np.int64)
    padded[..., : parts.shape[-1]] = parts
    return padded @ sequency_matrix(width).T


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each part (a row) the nearest entry's index and squared distance; how many differences were squared."""
    x, c = transformed(parts), transformed(entries)
    rows, width = x.shape
    every = np.arange(rows)
    row, entry = np.repeat(every, len(c)), np.tile(np.arange(len(c)), rows)
    total, work = np.zeros(len(row), np.int64), 0
    steps = sorted({0, *(1 << k for k in range(width.bit_length()) if 1 << k < width), width})
    for a, b in pairwise(steps):
        total += ((x[row, a:b] - c[entry, a:b]) ** 2).sum(1)
        work += len(row) * (b - a)
        if b == width:
            break
        # The entry that is ahead is measured to its end; that bounds the least distance.
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.minimum.reduceat(total, heads)
        ahead = np.flatnonzero(total == least[row])
        ahead = ahead[np.unique(row[ahead], return_index=True)[1]]
        bound = total[ahead] + ((x[row[ahead], b:] - c[entry[ahead], b:]) ** 2).sum(1)
        work += len(ahead) * (width - b)
        keep = total <= bound[row]
        row, entry, total = row[keep], entry[keep], total[keep]
    order = np.lexsort((entry, total, row))
    first = order[np.unique(row[order], return_index=True)[1]]
    return entry[first], total[first] // width, work


def _safe(parts: int, length: int) -> int:
    """Largest absolute component whose distances stay within 64 bits."""
    width = 1 << max(0, -(-length // parts) - 1).bit_length()
    return int((2**62 / (4 * width**3 * parts)) ** 0.5)


def _cut(lists: pa.Array, length: int, parts: int) -> np.ndarray:
    """(rows, parts, components per part) of lists of one length."""
    flat = lists.flatten().to_numpy().reshape(len(lists), length)
    each = -(-length // parts)
    out = np.zeros((len(lists), parts * each), np.int64)
    out[:, :length] = flat
    return out.reshape(len(lists), parts, each)


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, parts: int) -> tuple[DataFrame, list[list[int]], int]:
    """(id, label, v) of the vectors that take part, as integers; the first ENTRIES of them; their length."""
    own, (id_, vector, label) = plain(df, id_col, vector_col, label_col)
    fits = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size(vector) > 0)
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = written(own.where(fits).select(F.col(id_).alias("id"), F.col(label).alias("label"), whole.alias("v")), "vector-codes")
    by_id = [F.asc_nulls_last("id"), "v"]
    found = rows.orderBy(*by_id).limit(1).select(F.size("v")).first()
    if found is None:
        return rows, [], 0
    length = found[0]
    rows = rows.where(F.size("v") == length)
    most = rows.select(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()[0]
    if most > (safe := _safe(parts, length)):
        raise ValueError(f"components up to {most / scale:g} are beyond {safe / scale:g}, where distances leave 64 bits")
    return rows, [list(r.v) for r in rows.orderBy(*by_id).limit(ENTRIES).collect()], length


def _moved(rows: DataFrame, books: np.ndarray, length: int) -> np.ndarray:
    """The codebooks after one round of assignments and means; unused entries stay."""
    parts, size, each = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                x = _cut(batch.column(0).slice(first, _ROWS), length, parts)
                for p in range(parts):
                    index, _, _ = nearest(x[:, p], books[p])
                    chosen = (index == np.arange(size)[:, None]).astype(np.int64)
                    sums[p] += chosen @ x[:, p]
                    counts[p] += chosen.sum(1)
        used = np.flatnonzero(np.repeat(counts.ravel(), each))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums.ravel()[used]), pa.array(np.repeat(counts.ravel(), each)[used])], ["place", "total", "n"])

    added = rows.select("v").mapInArrow(run, "place int, total long, n long").groupBy("place").agg(F.sum("total"), F.sum("n"))
    out = books.copy().ravel()
    for place, total, n in added.collect():
        out[place] = total // n
    return out.reshape(books.shape)


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every kept vector, code as array<int> by part; and the codebooks by part, entry and component."""
    rows, first, length = kept_vectors(df, id_col, vector_col, label_col, scale, parts)
    if not first:
        return rows.select("id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    books = _cut(pa.array(first, pa.list_(pa.int64())), length, parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _moved(rows, books, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                some = batch.slice(first, _ROWS)
                x = _cut(some.column(2), length, parts)
                found = [nearest(x[:, p], books[p]) for p in range(parts)]
                code, error = np.stack([f[0] for f in found], 1), sum(f[1] for f in found)
                ends = pa.array(np.arange(some.num_rows + 1) * parts, pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.ListArray.from_arrays(ends, pa.array(code.ravel(), pa.int32())), pa.array(error)], ["id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code array<int>, error long"), books


def told(books: np.ndarray) -> str:
    """All components of the codebooks by part, entry and position, in decimal, with commas between."""
    return ",".join(map(str, books.ravel().tolist()))


def digests(df: DataFrame, **columns: str) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): the codes in hexadecimal with the error of each label."""
    found, books = encode(df, **columns)
    found = written(found, "vector-codes-found")
    text = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(told(books).encode()).hexdigest()
    return found.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias("vec_id"), text.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
