"""Exact top-k search by inner product over cover trees of the queries and of the data.

Vectors near the same pivot stand together, in blocks of bounded size; pivots come from a bounded
sample and only shape the blocks. A task makes a cover tree of each of its blocks and searches it
together with trees of the queries: a pair of nodes is left out when the largest inner product that
their centres, covering radii, norms and angles allow is below the worst k-th score in the query
node. The scores with the sample, whose rows are rows of the data, are where each query's k-th score
starts. Queries go to the tasks in blocks of QUERY_BLOCK, one block after the other, so what is sent
and what the driver holds has a fixed bound, and each task returns at most k rows for a query.

Defined results: components are floor(scale * x). Vectors that are null, or hold null or
non-finite components, and rows without an id take no part. Vectors meet those of their own number
of components. Candidates with the query's id are its own. Each row of the query set is answered;
rows that repeat both id and vector are answered once. Ties go to the smaller id. Scores beyond 64
bits are cut to the largest or least that fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

SAMPLE, PIVOTS = 2_000, 128
QUERY_BLOCK, DATA_BLOCK, LEAF = 4_096, 2_048, 64
#: Scores that a task holds at a time.
CELLS = 1 << 21
_FREE = -(1 << 63)


class Level:
    """Nodes of one parent: node i holds rows [first, last) of its tree, `below` it stand its children."""

    def __init__(self, tree: CoverTree, first: np.ndarray, last: np.ndarray, below: list[Level | None]) -> None:
        self.first, self.last, self.below = first, last, below
        self.leaf = np.array([b is None for b in below], dtype=bool)
        self.center = tree.vectors[first]
        self.norm = tree.norm[first]
        self.radius, self.angle, self.high = np.zeros(len(first)), np.zeros(len(first)), self.norm.copy()
        for i in np.flatnonzero(last - first > 1):
            own, norm = tree.vectors[first[i] : last[i]], tree.norm[first[i] : last[i]]
            self.high[i] = norm.max()
            self.radius[i] = np.sqrt(((own - own[0]) ** 2).sum(axis=1).max()) * (1 + 1e-9)
            cosine = (own @ own[0]) / (norm * norm[0]) if norm.min() > 0 else np.array([-1.0])
            self.angle[i] = np.arccos(np.clip(cosine.min(), -1, 1)) + 1e-6 if self.radius[i] > 0 else 0.0

    def only(self, at: np.ndarray) -> Level:
        """The nodes with the numbers `at`."""
        out = object.__new__(Level)
        for name in ("first", "last", "leaf", "center", "norm", "radius", "angle", "high"):
            setattr(out, name, getattr(self, name)[at])
        out.below = [self.below[i] for i in at]
        return out

    def rows(self) -> np.ndarray:
        size = self.last - self.first
        return np.arange(size.sum()) + np.repeat(self.first - np.cumsum(size) + size, size)


class CoverTree:
    """The centre of a node is its first row, and its children cover its rows within half of its radius."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        square = (vectors**2).sum(axis=1)
        gap = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * (vectors @ vectors.T), 0))
        shape = self._split(gap, np.arange(len(vectors)), leaf)
        order = self._order(shape)
        self.vectors, self.ids = vectors[order], ids[order]
        self.norm = np.sqrt((self.vectors**2).sum(axis=1))
        self.root = self._level([shape], 0)

    def _split(self, gap: np.ndarray, rows: np.ndarray, leaf: int) -> np.ndarray | list:
        """The rows of a leaf, or its parts; the first row is the centre."""
        if len(rows) <= leaf:
            return rows
        own = gap[np.ix_(rows, rows)]
        least, nearest, centers = own[0].copy(), np.zeros(len(rows), np.int64), [0]
        radius = least.max()
        if radius == 0:
            return rows
        while least.max() > radius / 2:
            far = int(np.argmax(least))
            closer = own[far] < least
            nearest[closer] = len(centers)
            np.minimum(least, own[far], out=least)
            nearest[far], least[far] = len(centers), 0
            centers.append(far)
        order = np.argsort(nearest, kind="stable")
        parts = []
        for k, some in enumerate(np.split(order, np.cumsum(np.bincount(nearest, minlength=len(centers)))[:-1])):
            some = rows[np.concatenate([[centers[k]], some[some != centers[k]]])]
            parts.append(self._split(gap, some, leaf))
        return parts

    def _order(self, shape: np.ndarray | list) -> np.ndarray:
        return shape if isinstance(shape, np.ndarray) else np.concatenate([self._order(s) for s in shape])

    def _level(self, shapes: list, first: int) -> Level:
        firsts, below = [], []
        for shape in shapes:
            firsts.append(first)
            if isinstance(shape, np.ndarray):
                below.append(None)
                first += len(shape)
            else:
                below.append(self._level(shape, first))
                first = int(below[-1].last[-1])
        return Level(self, np.array(firsts, np.int64), np.array([*firsts[1:], first], np.int64), below)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integers held as doubles, exact."""
    largest = (np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    if largest < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a).dot(whole(b).T) if a.size and b.size else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


class Search:
    """The k best of each query so far; block after block may be searched.

    `sample` are ids and vectors of some rows of the data, from which a score is known that the k-th
    reaches at least. `bounded` counts pairs of nodes, `scored` pairs of rows.
    """

    def __init__(self, queries: CoverTree, k: int, sample: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.queries, self.k = queries, k
        self.score = np.full((len(queries.ids), k), _FREE, np.int64)
        self.id = np.full((len(queries.ids), k), np.iinfo(np.int64).max, np.int64)
        self.floor = np.full(len(queries.ids), _FREE, np.int64)
        if sample is not None and len(sample[0]) >= k:
            some = _scores(queries.vectors, sample[1])
            some[sample[0][None, :] == queries.ids[:, None]] = _FREE
            self.floor = np.partition(some, len(sample[0]) - k, axis=1)[:, len(sample[0]) - k]
        self.bounded = self.scored = 0

    def block(self, data: CoverTree) -> None:
        self.data = data
        stack = [(self.queries.root, data.root)]
        while stack:
            stack += self._visit(*stack.pop())

    def _worst(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def _visit(self, q: Level, d: Level) -> list[tuple[Level, Level]]:
        """Rules out pairs of nodes, scores those of leaves, and returns the others, the most promising last."""
        ends = np.stack([q.first, q.last], axis=1).ravel()
        worst = np.minimum.reduceat(np.append(self._worst(), 0), ends)[::2]
        self.bounded += len(q.first) * len(d.first)
        dot, norms = q.center @ d.center.T, q.norm[:, None] * d.norm[None, :]
        most = dot + q.radius[:, None] * (d.norm + d.radius)[None, :] + q.norm[:, None] * d.radius[None, :]
        keep = self._reaches(most, norms, worst[:, None])
        wide = np.nonzero(keep & (q.radius[:, None] + d.radius[None, :] > 0) & (norms > 0))
        if len(wide[0]):
            i, j = wide
            apart = np.arccos(np.clip(dot[wide] / norms[wide], -1, 1)) - q.angle[i] - d.angle[j] - 1e-6
            high = q.high[i] * d.high[j]
            keep[wide] = self._reaches(high * np.maximum(np.cos(np.clip(apart, 0, np.pi)), 0), high, worst[i])
        q_leaf, d_leaf = np.flatnonzero(q.leaf), np.flatnonzero(d.leaf)
        q_more, d_more = np.flatnonzero(~q.leaf), np.flatnonzero(~d.leaf)
        self._leaves(q.only(q_leaf), d.only(d_leaf), keep[np.ix_(q_leaf, d_leaf)])
        found = [(q.only(q_leaf[keep[q_leaf, j]]), d.below[j], most[:, j].max()) for j in d_more if keep[q_leaf, j].any()]
        found += [(q.below[i], d.only(d_leaf[keep[i, d_leaf]]), most[i].max()) for i in q_more if keep[i, d_leaf].any()]
        found += [(q.below[i], d.below[j], most[i, j]) for i in q_more for j in d_more if keep[i, j]]
        return [(a, b) for a, b, _ in sorted(found, key=lambda x: x[2])]

    @staticmethod
    def _reaches(most: np.ndarray, size: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """Whether a bound may reach a score, with room for the rounding of sums of that size."""
        return (worst == _FREE) | (np.maximum(most + 1e-9 * (size + np.abs(most)) + 1e-6, -(2.0**63)) >= worst)

    def _leaves(self, q: Level, d: Level, keep: np.ndarray) -> None:
        q_some, d_some = np.flatnonzero(keep.any(axis=1)), np.flatnonzero(keep.any(axis=0))
        if not len(q_some):
            return
        q, d, keep = q.only(q_some), d.only(d_some), keep[np.ix_(q_some, d_some)]
        other = d.rows()
        wide = np.repeat(keep, d.last - d.first, axis=1)
        step = max(1, CELLS // len(other))
        own, node = q.rows(), np.repeat(np.arange(len(q.first)), q.last - q.first)
        for at in range(0, len(own), step):
            rows = own[at : at + step]
            score = _scores(self.queries.vectors[rows], self.data.vectors[other])
            self.scored += score.size
            hit = np.nonzero(wide[node[at : at + step]] & (score >= np.maximum(self._worst()[rows], _FREE + 1)[:, None]))
            row, ids = rows[hit[0]], self.data.ids[other[hit[1]]]
            mine = ids != self.queries.ids[row]
            self._merge(row[mine], ids[mine], score[hit][mine])

    def _merge(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        some = np.unique(row)
        if not len(some):
            return
        row = np.concatenate([row, np.repeat(some, self.k)])
        ids, score = np.concatenate([ids, self.id[some].ravel()]), np.concatenate([score, self.score[some].ravel()])
        order = np.lexsort((ids, ~score, row))  # ~x falls as x rises
        start = np.searchsorted(row[order], some)
        best = order[start[:, None] + np.arange(self.k)[None, :]]
        self.score[some], self.id[some] = score[best], ids[best]


def _pivots(sample: np.ndarray) -> np.ndarray:
    """Vectors far from each other, the farthest from all before it each time."""
    chosen, least = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(PIVOTS, len(sample)) and least.max() > 0:
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def whole_vectors(table: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, v): floor(scale * x) of the vectors that take part, as doubles."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "dim", "v"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("dim")).mapInArrow(run, "id long, dim int, v array<double>")


def _sample(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of up to SAMPLE rows."""
    rows = vectors.where(F.col("dim") == dim).orderBy(F.xxhash64("id")).limit(SAMPLE).collect()
    return np.array([r.id for r in rows]), np.array([r.v for r in rows], dtype=np.float64).reshape(len(rows), -1)


def _celled(vectors: DataFrame, samples: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Vectors in the order of their nearest pivot, so that what a task reads lies close together."""
    pivots = vectors.sparkSession.sparkContext.broadcast({dim: _pivots(sample) for dim, (_, sample) in samples.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            cell = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own, all_ = _matrix(batch.column(2).take(pa.array(at))), pivots.value[int(dim)]
                cell[at] = np.argmin((all_**2).sum(axis=1)[None, :] - 2 * own @ all_.T, axis=1) if dim else 0
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(cell)], names=["id", "dim", "v", "cell"])

    celled = vectors.mapInArrow(run, "id long, dim int, v array<double>, cell int")
    return celled.repartitionByRange(partitions(vectors.sparkSession), "dim", "cell", "id").sortWithinPartitions("dim", "cell", "id")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, ids, vectors) of up to DATA_BLOCK rows of one cell, as they come."""
    dim = cell = -1
    ids: list[np.ndarray] = []
    vectors: list[np.ndarray] = []
    for batch in batches:
        dims, cells = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 3))
        cuts = np.flatnonzero(np.concatenate([[True], (dims[1:] != dims[:-1]) | (cells[1:] != cells[:-1])])) if len(dims) else []
        for first, last in zip(cuts, [*cuts[1:], len(dims)], strict=False):
            for at in range(first, last, DATA_BLOCK):
                size = min(DATA_BLOCK, last - at)
                if (dims[at], cells[at]) != (dim, cell) or sum(map(len, ids)) + size > DATA_BLOCK:
                    if ids:
                        yield int(dim), np.concatenate(ids), np.concatenate(vectors)
                    dim, cell, ids, vectors = dims[at], cells[at], [], []
                ids.append(batch.column(0).slice(at, size).to_numpy(zero_copy_only=False))
                vectors.append(_matrix(batch.column(2).slice(at, size)))
    if ids:
        yield int(dim), np.concatenate(ids), np.concatenate(vectors)


def top_k(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows; queries have ids divisible by `every`."""
    spark = table.sparkSession
    vectors = written(whole_vectors(table, scale, id_col, vector_col), "topk-vectors")
    samples = {r.dim: _sample(vectors, r.dim) for r in vectors.select("dim").distinct().orderBy("dim").collect()}
    data = written(_celled(vectors, samples), "topk-cells")
    asked = data.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    asked = written(asked.repartitionByRange(partitions(spark), "dim", "cell", "id").sortWithinPartitions("dim", "cell", "id").withColumn("row", F.monotonically_increasing_id()), "topk-queries")
    parts = asked.groupBy("dim", F.shiftright("row", 33).alias("part")).agg(F.min("row").alias("low"), F.count("*").alias("n")).orderBy("dim", "part").collect()
    found = None
    for dim, low, high in _row_ranges(parts):
        answer = _answered(data, asked.where((F.col("dim") == dim) & F.col("row").between(low, high)), dim, k, samples[dim])
        found = answer if found is None else found.union(answer)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _row_ranges(parts: list) -> list[tuple[int, int, int]]:
    """(dim, first row, last row) of blocks of QUERY_BLOCK queries, from the counts by partition."""
    out, size = [], 0
    for part in parts:
        at = 0
        while at < part.n:
            if not out or out[-1][0] != part.dim or size == QUERY_BLOCK:
                out.append((part.dim, part.low + at, part.low + at))
                size = 0
            step = min(QUERY_BLOCK - size, part.n - at)
            at, size = at + step, size + step
            out[-1] = (part.dim, out[-1][1], part.low + at - 1)
    return out


def _answered(data: DataFrame, queries: DataFrame, dim: int, k: int, sample: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The answers of one block of queries, written, so that the block need not be kept."""
    rows = queries.select("id", "v", "row").collect()  # QUERY_BLOCK at most
    vectors = np.array([r.v for r in rows], dtype=np.float64).reshape(len(rows), -1)
    sent = data.sparkSession.sparkContext.broadcast((vectors, np.array([r.id for r in rows]), np.array([r.row for r in rows]), sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, ids, numbers, sample = sent.value
        searches = []
        for at in range(0, len(ids), DATA_BLOCK):
            tree = CoverTree(vectors[at : at + DATA_BLOCK], np.arange(at, min(at + DATA_BLOCK, len(ids))))
            number, tree.ids = numbers[tree.ids], ids[tree.ids]
            searches.append((number, Search(tree, k, sample)))
        for _, own, block in _blocks(batches):
            tree = CoverTree(block, own)
            for _, search in searches:
                search.block(tree)
        for number, search in searches:
            kept = search.score != _FREE
            at = np.nonzero(kept)[0]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (search.queries.ids[at], number[at], search.id[kept], search.score[kept])], names=["query_id", "query", "vec_id", "score"])

    answers = written(data.where(F.col("dim") == dim).mapInArrow(run, "query_id long, query long, vec_id long, score long"), "topk-answers")
    sent.destroy()
    return answers
