"""Ranked lexical search: the best documents for each item, by branch and bound over FP-trees of documents.

A document is the vector of its counts of the items' terms, in the order of the terms' document
frequencies, most frequent first. Vectors that begin with the same terms share a path of a trie. Of
the trie the branching nodes are kept, down to leaves of LEAF documents or fewer. A node knows, for
each term below it, the largest count in one document, and the least length norm m of its documents;
from them follows an upper bound of the score of whatever stands below. For each item the trie is
searched depth first, the better child first, and a subtree whose bound cannot enter the item's best
k is left out. Scores are 64-bit integers and exact.

Each task builds tries of up to SHARD documents of its own partition, one after the other, and takes
the best k of one trie as the start of the next. It passes on k rows an item at most. These are merged
by parts of the tasks first and then by item, so no item is held whole in one task.

Items are the query set. They go out in blocks of ITEM_BYTES of text, which bounds the vocabulary
that is sent to the executors. Each block reads all documents once more; nothing is left out. An item
longer than that is a block of its own.

Defined results: a null text has no terms and no rank, and a document without any term counts for
nothing. An item without terms, or with terms that no document has, gets no rows. Rows of one item id
are one item with the terms of all of them; a null id is an id. Repeated documents are ranked each on
its own; equal scores go by ascending id, null last. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import plain, small_batches, written

LEAF, SHARD, SHARD_ENTRIES = 64, 8192, 4_000_000
ITEM_BYTES = 4 << 20
#: Rows of the tasks are merged in so many parts an item before they are merged by item.
PARTS = 32
_LAST = np.iinfo(np.int64).max
#: Bytes of UTF-8: ASCII letters in lower case, digits and all that is not ASCII stay; the rest parts terms.
_TERMS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()

VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_TERMS).split()


def _restricted(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): all terms of each document counted, those of the vocabulary told apart."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            sizes, terms, counts, ends = [], [], [], [0]
            for text in batch.column(1):
                words = terms_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                held = Counter(filter(known.__contains__, words))
                sizes.append(len(words))
                terms += [known[w] for w in held]
                counts += held.values()
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    own, (id_, text) = plain(docs, id_col, text_col)
    return own.select(F.col(id_).cast("long"), F.col(text).cast("string")).mapInArrow(run, VECTORS)


def _frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for term, df in vectors.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


def saturated(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The part of a term's weight that a document of norm m gives for so many occurrences."""
    return (1_000_000_000 * count) // (1000 * count + 20 * m)


@dataclass
class Tree:
    """Documents in the order of their paths, and the nodes above them; node 0 is the root."""

    row: np.ndarray  # of each document, its place in the input
    start: np.ndarray  # of each document, its first entry; one more at the end
    term: np.ndarray  # entries: term and its part of the weight, by document
    part: np.ndarray
    owner: np.ndarray  # entries: document
    span: list[tuple[int, int]]  # of each node, its documents
    children: list[list[int]]
    node: np.ndarray  # bounds: node, term and the most that the term can give below it
    node_term: np.ndarray
    node_part: np.ndarray


def plant(start: np.ndarray, term: np.ndarray, count: np.ndarray, m: np.ndarray, key: np.ndarray, df: np.ndarray) -> Tree:
    """The tree of documents given by their entries; key orders documents of the same path."""
    docs, rank = len(start) - 1, np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    owner = np.repeat(np.arange(docs), np.diff(start))
    order = np.lexsort((rank[term], owner))
    path = rank[term][order].astype(">u4")
    paths = [path[a:b].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)]
    row = np.array(sorted(np.argsort(key, kind="stable").tolist(), key=paths.__getitem__), np.int64)
    sizes = np.diff(start)[row]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    entry = order[np.repeat(start[row] - begin[:-1], sizes) + np.arange(begin[-1])]
    term, count, owner = term[entry].astype(np.int64), count[entry].astype(np.int64), np.repeat(np.arange(docs), sizes)
    m = m[row]
    shared = np.zeros(docs, np.int64)  # terms at the beginning that a document shares with the one before it
    for i in range(1, docs):
        a, b = term[begin[i - 1] : begin[i]], term[begin[i] : begin[i + 1]]
        n = min(len(a), len(b))
        unlike = a[:n] != b[:n]
        shared[i] = int(unlike.argmax()) if unlike.any() else n
    span, children = [(0, docs)], [[]]
    for at, (lo, hi) in enumerate(span):  # grows while it is walked
        if hi - lo <= LEAF:
            continue
        inner = shared[lo + 1 : hi]
        cuts = [lo, *(lo + 1 + np.flatnonzero(inner == inner.min())).tolist(), hi]
        first = lo
        for here, after in zip(cuts[1:-1], cuts[2:], strict=True):
            if after - first > LEAF:  # small neighbours go together
                children[at].append(len(span))
                span.append((first, here))
                children.append([])
                first = here
        children[at].append(len(span))
        span.append((first, hi))
        children.append([])
    found: list[tuple[np.ndarray, np.ndarray]] = [(term[:0], count[:0])] * len(span)
    for at in range(len(span) - 1, -1, -1):
        lo, hi = span[at]
        some = [found[c] for c in children[at]] or [(term[begin[lo] : begin[hi]], count[begin[lo] : begin[hi]])]
        terms, counts = (np.concatenate(x) for x in zip(*some, strict=True))
        by = np.argsort(terms, kind="stable")
        terms = terms[by]
        heads = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else terms
        found[at] = (terms[heads], np.maximum.reduceat(counts[by], heads) if len(terms) else counts)
    node = np.repeat(np.arange(len(span)), [len(t) for t, _ in found])
    least = np.array([m[lo:hi].min() if hi > lo else 1 for lo, hi in span])
    node_term, most = (np.concatenate(x) for x in zip(*found, strict=True))
    return Tree(row, begin, term, saturated(count, m[owner]), owner, span, children, node, node_term, saturated(most, least[node]))


@dataclass
class Best:
    """The best rows so far of one item: scores, then keys ascending, and what stands for the document."""

    score: np.ndarray
    key: np.ndarray
    place: np.ndarray

    def bar(self, k: int) -> tuple[int, int]:
        """What a row must reach: its score, and with that score a smaller key."""
        return (int(self.score[-1]), int(self.key[-1])) if len(self.score) == k else (0, -_LAST - 1)

    def add(self, k: int, score: np.ndarray, key: np.ndarray, place: np.ndarray) -> None:
        score, key, place = (np.concatenate(x) for x in ((self.score, score), (self.key, key), (self.place, place)))
        by = np.lexsort((place, key, -score))[:k]
        self.score, self.key, self.place = score[by], key[by], place[by]


def search(tree: Tree, weights: np.ndarray, best: Best, k: int, key: np.ndarray, base: int) -> int:
    """Bring the best of one item up to date with the documents of a tree; how many of them were scored.

    weights has each term's weight, zero for the terms that are not the item's. key orders the
    documents of the input, of which the first is place `base`.
    """
    own = weights[tree.node_term]
    held = np.flatnonzero(own)
    bound = np.zeros(len(tree.span), np.int64)
    np.add.at(bound, tree.node[held], own[held] * tree.node_part[held])
    bounds, stack, scored = bound.tolist(), [0], 0
    bar, last = best.bar(k)
    while stack:
        at = stack.pop()
        # A subtree with the bar's own bound may hold a smaller key.
        if bounds[at] < bar or not bounds[at]:
            continue
        if tree.children[at]:
            stack += sorted(tree.children[at], key=bounds.__getitem__)
            continue
        lo, hi = tree.span[at]
        a, b = tree.start[lo], tree.start[hi]
        score = np.zeros(hi - lo, np.int64)
        np.add.at(score, tree.owner[a:b] - lo, weights[tree.term[a:b]] * tree.part[a:b])
        scored += hi - lo
        rows = tree.row[lo:hi]
        fits = np.flatnonzero((score > bar) | (score == bar) & (key[rows] < last))
        if len(fits):
            best.add(k, score[fits], key[rows[fits]], base + rows[fits])
            bar, last = best.bar(k)
    return scored


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    some, rows, entries = [], 0, 0
    for batch in batches:
        for first in range(0, batch.num_rows, SHARD):
            piece = batch.slice(first, SHARD)
            some.append(piece)
            rows, entries = rows + piece.num_rows, entries + len(piece.column(2).flatten())
            if rows >= SHARD or entries >= SHARD_ENTRIES:
                yield pa.Table.from_batches(some)
                some, rows, entries = [], 0, 0
    if some:
        yield pa.Table.from_batches(some)


def _block(docs: DataFrame, items: list[tuple[int | None, set[bytes]]], id_col: str, text_col: str, k: int) -> DataFrame:
    """Each task's best k of each item: (item, part, doc_id, score)."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(terms for _, terms in items))))}
    with small_batches(spark, 512):
        vectors = written(_restricted(docs, id_col, text_col, vocabulary), "ranking-vectors")
    total, length = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _frequencies(vectors, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    owned = [np.array(sorted(vocabulary[t] for t in terms), np.int64) for _, terms in items]
    sent = spark.sparkContext.broadcast((df, weight, owned, [i for i, _ in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, weight, owned, names = sent.value
        empty = np.zeros(0, np.int64)
        best = [Best(empty, empty, empty) for _ in owned]
        ids, base, dense = [], 0, np.zeros(len(weight), np.int64)
        for shard in _shards(batches):
            shard = shard.combine_chunks()
            lists, counts = shard.column("terms").combine_chunks(), shard.column("counts").combine_chunks()
            start = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
            n = shard.column("n").to_numpy()
            key = shard.column("doc_id").fill_null(_LAST).to_numpy()
            tree = plant(start, lists.flatten().to_numpy(), counts.flatten().to_numpy(), 50 + (50 * n * total) // max(1, length), key, df)
            for own, top in zip(owned, best, strict=True):
                dense[own] = weight[own]
                search(tree, dense, top, k, key, base)
                dense[own] = 0
            # Ids of the rows that are still among some item's best, so that a task holds no more.
            ids.append(shard.column("doc_id").combine_chunks())
            base += len(key)
            if len(ids) > 1:
                ids, base = _kept(ids, best)
        part = TaskContext.get().partitionId() % PARTS
        for name, top in zip(names, best, strict=True):
            if len(top.score):
                found = pa.concat_arrays(ids).take(pa.array(top.place))
                size = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([name] * size, pa.int64()), pa.array([part] * size, pa.int32()), found, pa.array(top.score)], ["item_id", "part", "doc_id", "score"])

    return vectors.where("size(terms) > 0").mapInArrow(run, "item_id long, part int, doc_id long, score long")


def _kept(ids: list[pa.Array], best: list[Best]) -> tuple[list[pa.Array], int]:
    """The ids that the best rows name, which are numbered anew."""
    used = np.unique(np.concatenate([b.place for b in best]))
    for b in best:
        b.place = np.searchsorted(used, b.place)
    return [pa.concat_arrays(ids).take(pa.array(used))], len(used)


def _blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[int | None, set[bytes]]]]:
    """Items with their terms, so many bytes of text at a time; rows of one id together."""
    own, (id_, text) = plain(items, id_col, text_col)
    rows = own.select(F.col(id_).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    some: list[tuple[int | None, set[bytes]]] = []
    size = 0
    for id_, text in rows.orderBy("id").toLocalIterator():
        raw = text.encode()
        if some and some[-1][0] == id_:
            some[-1][1].update(terms_of(raw))
        else:
            if size + len(raw) > most and some:
                yield some
                some, size = [], 0
            some.append((id_, set(terms_of(raw))))
        size += len(raw)
    if some:
        yield some


def rank(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents, or all with a score if fewer."""
    found = None
    for block in _blocks(items, item_id, item_text, item_bytes):
        some = _block(docs, block, doc_id, doc_text, k)
        found = some if found is None else found.union(some)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item_id", "part"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")
