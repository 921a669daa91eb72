"""Substring dedup: words in windows that occur more than once in the corpus go.

A window is `size` consecutive words. Its anchor is the run of ANCHOR words in it with the least
hash, so equal windows have equal anchors at equal places, and the windows of a document fall into
short stretches with one anchor each. Anchors that occur once in the corpus settle their windows.
The stretches of each repeated anchor form a shard of reference passages, for which a suffix
automaton with occurrence counts is built; the stretches are streamed through it, and a window whose
matching statistics reach a state that more than one place has led to is repeated. The shards hold
a part of the corpus that grows with it, so they cannot be broadcast whole; the automata meet their
documents through the shuffle, by anchor.

Equal texts take part once, with their number: all their windows are repeated. In the same way equal
stretches stand in their shard once, and where there are two of them all their windows are repeated;
only the others are streamed. A shard of more than `hot_rows` different stretches is cut by a second
anchor, of another order of the hashes. What is still as large, as in a big family of near copies, is
cut into single windows, of which two are repeated only if they are equal; grouping tells that in
any number of places.

Defined results: words are the runs between white space, unchanged; a null text has none. Windows
are judged on the input: both of two equal windows go, within one document too. Rows that repeat
are places of their own. Null ids are ids like any other. Columns other than the two named are not
read. Texts and stretches are told apart by 128 bits of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import BROADCAST_BYTES, partitions, text_of, written

ANCHOR = 8
HOT_ROWS = 5_000
_STEP = 200_000


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` values."""
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
            out ^= out >> np.uint64(32)
    return out


def stretches(words: list[bytes], size: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Anchor hash and first window of each stretch of windows with one anchor; number of windows.

    Each level has an order of the hashes of its own.
    """
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    anchor = min(ANCHOR, size)
    grams = _rolled(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), anchor)
    if level:
        with np.errstate(over="ignore"):
            grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * level)
            grams ^= grams >> np.uint64(32)
    width = size - anchor + 1
    place = np.concatenate([first + np.arange(min(_STEP, n - first)) + sliding_window_view(grams[first : first + min(_STEP, n - first) + width - 1], width).argmin(axis=1) for first in range(0, n, _STEP)])
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return grams[place[starts]], starts, n


class SuffixAutomaton:
    """Of several sequences, with how many places of them lead to each state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, next_: dict[int, int]) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The state of q's words up to one longer than p's."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int], times: int) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = self._split(last, symbol, q)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and symbol not in self.next[p]:
                    self.next[p][symbol] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, symbol, self.next[p][symbol])
                last = new
            self.count[last] += times

    def close(self) -> None:
        """A place that leads to a state leads to the states of its suffixes."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def repeated(self, sequence: list[int], size: int) -> list[int]:
        """Starts of the windows of `size` symbols that occur at two places or more."""
        out, state, matched = [], 0, 0
        for i, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol not in self.next[state]:
                continue
            state, matched = self.next[state][symbol], matched + 1
            if matched > size:
                matched = size
            while self.length[self.link[state]] >= matched:
                state = self.link[state]
            if matched == size and self.count[state] > 1:
                out.append(i - size + 1)
        return out


def shard_spans(passages: list[bytes], size: int, times: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """For each passage the spans of its words that lie in windows repeated among the passages.

    times: in how many places each passage stands, one by default.
    """
    count: dict[bytes, int] = {}
    for p, n in zip(passages, times or [1] * len(passages), strict=True):
        count[p] = count.get(p, 0) + n
    words: dict[bytes, int] = {}
    coded = {p: [words.setdefault(w, len(words)) for w in p.split(b" ")] for p in count}
    if len(count) == 1:
        whole = [(0, len(coded[passages[0]]))] if count[passages[0]] > 1 else []
        return [whole] * len(passages)
    automaton = SuffixAutomaton()
    for p, n in count.items():
        automaton.add(coded[p], n)
    automaton.close()
    spans = {}
    for p, sequence in coded.items():
        own: list[tuple[int, int]] = []
        for start in automaton.repeated(sequence, size):
            if own and start <= own[-1][1]:
                own[-1] = (own[-1][0], start + size)
            else:
                own.append((start, start + size))
        spans[p] = own
    return [spans[p] for p in passages]


#: Stretches: the number of their text, the place of the first word, how many words there are, in how
#: many places they stand (beyond one, number and place are of any of these), a hash, and the words.
_PARTS = "anchor long, no long, first int, words int, times long, kind binary, passage string"
_SPANS = "no long, start int, end int"


def _parts_of(anchor: list[int], no: pa.Array, first: list[int], times: pa.Array, parts: list[bytes]) -> pa.RecordBatch:
    words = pa.array([p.count(b" ") + 1 for p in parts], pa.int32())
    kinds = pa.array([xxhash.xxh3_128_digest(p) for p in parts], pa.binary())
    columns = [pa.array(anchor, pa.int64()), no, pa.array(first, pa.int32()), words, times, kinds, pa.array(parts, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["anchor", "no", "first", "words", "times", "kind", "passage"])


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    no, start, end = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["no", "start", "end"])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(anchor, no, first, times, passage) of each row."""
    columns = [batch.column(k).to_pylist() for k in range(4)] + [batch.column(4).cast(pa.binary()).to_pylist()]
    return zip(*columns, strict=True)


def _spans_of_shards(size: int):
    def settled(rows: list[tuple]) -> list[tuple]:
        if len(rows) == 1:  # no other stretch, and no window stands in one stretch twice
            return []
        spans = shard_spans([r[4] for r in rows], size, [r[3] for r in rows])
        return [(no, first + a, first + b) for (_, no, first, times, _), some in zip(rows, spans, strict=True) if times == 1 for a, b in some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in _rows(batch):
                if shard and row[0] != shard[0][0]:
                    out += settled(shard)
                    shard = []
                    if len(out) > 20_000:
                        yield _batch_of(out)
                        out = []
                shard.append(row)
        if shard:
            out += settled(shard)
        yield _batch_of(out)

    return run


def _cut_again(size: int, single: bool):
    """Stretches by a second anchor, or as single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, anchor, first, parts = [], [], [], []
            for i, (old, _, place, _, passage) in enumerate(_rows(batch)):
                words = passage.split(b" ")
                if single:
                    n = len(words) - size + 1
                    hashes, starts = np.full(n, old), np.arange(n)
                else:
                    hashes, starts, n = stretches(words, size, 1)
                    with np.errstate(over="ignore"):
                        hashes = hashes.view(np.int64) * np.int64(31) + np.int64(old)
                for h, low, high in zip(hashes.tolist(), starts.tolist(), [*starts[1:].tolist(), n], strict=True):
                    at.append(i)
                    anchor.append(h)
                    first.append(place + low)
                    parts.append(b" ".join(words[low : high + size - 1]))
            take = pa.array(at, pa.int64())
            yield _parts_of(anchor, batch.column(1).take(take), first, batch.column(3).take(take), parts)

    return run


def _those(rows: DataFrame, column: str, few: DataFrame, how: str) -> DataFrame:
    """A semi or anti join with a written table, which is sent to every executor only while it is small."""
    other = few.select(F.col(few.columns[0]).alias("_those"))
    small = other.count() * 64 <= BROADCAST_BYTES
    return rows.join(F.broadcast(other) if small else other, F.col(column) == F.col("_those"), how)


def _part_spans(parts: DataFrame, size: int, hot_rows: int, cut: int = 0) -> DataFrame:
    """(no, start, end): spans of the stretches that are repeated or whose windows are, after `cut` cuts."""
    spark = parts.sparkSession
    kinds = parts.groupBy("anchor", "kind", "passage").agg(F.sum("times").alias("times"), F.min("no").alias("no"), F.min("first").alias("first"))
    kinds = written(kinds.select("anchor", "no", "first", "times", "passage", "kind"), "substring-kinds")
    equal = kinds.where("times > 1").select(F.col("anchor").alias("_anchor"), F.col("kind").alias("_kind"))
    asked = parts.where("times = 1").select("anchor", "kind", "no", "first", "words")
    found = asked.join(equal, (F.col("anchor") == F.col("_anchor")) & (F.col("kind") == F.col("_kind")), "left_semi")
    found = found.select("no", F.col("first").alias("start"), (F.col("first") + F.col("words")).alias("end"))
    if cut == 2:  # these are single windows, which have nothing in common unless they are equal
        return found
    kinds = kinds.drop("kind")
    hot = written(kinds.groupBy("anchor").count().where(f"count > {hot_rows}").select("anchor"), "substring-hot")
    few = hot.isEmpty()
    cold = kinds if few else _those(kinds, "anchor", hot, "left_anti")
    shards = cold.repartition(partitions(spark), "anchor").sortWithinPartitions("anchor")
    found = found.union(shards.mapInArrow(_spans_of_shards(size), _SPANS))
    if few:
        return found
    again = _those(kinds, "anchor", hot, "left_semi").mapInArrow(_cut_again(size, cut == 1), _PARTS)
    return found.union(_part_spans(written(again, "substring-again"), size, hot_rows, cut + 1))


def repeated_spans(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc, key, spans): word spans to remove, by id and hash of the text; spans may overlap."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = _texts(docs, id_col, text_col)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hashes, starts = [], [], []
            for i, data in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                h, first, windows = stretches(data.split(), size)
                if windows:
                    at.append(i)
                    hashes.append(h.view(np.int64))
                    starts.append(np.append(first, windows))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(hashes, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int32()))], names=["doc", "key", "hashes", "starts"])

    found = written(texts.mapInArrow(anchors, f"doc {kind}, key binary, hashes array<long>, starts array<int>"), "substring-anchors")
    once = found.groupBy("key").agg(F.min("doc").alias("rep"), F.count("*").alias("times"), F.first(F.struct("hashes", "starts")).alias("of"))
    once = written(once.select("key", "rep", "times", "of.*").withColumn("no", F.monotonically_increasing_id()), "substring-texts")
    each = once.select("no", "starts", F.posexplode("hashes").alias("i", "anchor"))
    each = each.select("no", "anchor", F.element_at("starts", F.col("i") + 1).alias("first"), F.element_at("starts", F.col("i") + 2).alias("next"))
    counts = once.select(F.explode("hashes").alias("_anchor")).groupBy("_anchor").count().where("count > 1").select("_anchor")
    shared = each.join(counts, F.col("anchor") == F.col("_anchor")).groupBy(F.col("no").alias("_no"))
    shared = written(shared.agg(F.collect_set(F.struct("first", "next", "anchor")).alias("shared")), "substring-shared")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for at in range(batch.num_rows):
                words = texts[at].as_py().split()
                rows = batch.column(3)[at].as_py()
                parts = [b" ".join(words[r["first"] : r["next"] + size - 1]) for r in rows]
                here = pa.array([at] * len(rows), pa.int64())
                yield _parts_of([r["anchor"] for r in rows], batch.column(0).take(here), [r["first"] for r in rows], batch.column(1).take(here), parts)

    # Of a text with copies all goes; it is here for others to be compared with.
    named = once.select("no", "times", F.col("rep").alias("_doc"), F.col("key").alias("_key"))
    named = named.join(shared, F.col("no") == F.col("_no")).select("no", "times", "_doc", "_key", "shared")
    met = texts.join(named, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))).select("no", "times", "text", "shared")
    parts = written(met.mapInArrow(passages, _PARTS), "substring-passages")
    spans = written(_part_spans(parts, size, hot_rows).groupBy(F.col("no").alias("_no")).agg(F.collect_set(F.struct("start", "end")).alias("spans")), "substring-found")
    of_one = once.where("times = 1").select("no", "rep", "key").join(spans, F.col("no") == F.col("_no")).select(F.col("rep").alias("doc"), "key", "spans")
    whole = F.array(F.struct(F.lit(0).alias("start"), (F.element_at("starts", -1) + (size - 1)).alias("end")))
    copies = written(once.where("times > 1").select("key"), "substring-copies")
    of_copies = _those(found, "key", copies, "left_semi").select("doc", "key", whole.alias("spans")).distinct()
    return of_one.union(of_copies)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, key, text): the key is 128 bits of the text's SHA-256."""
    key = F.substring(F.unhex(F.sha2(text_of(text_col), 256)), 1, 16)
    return docs.select(F.col(id_col).alias("doc"), key.alias("key"), text_of(text_col).alias("text"))


def drop_repeated_windows(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed): kept words joined by one space; word spans removed.

    removed holds the maximal spans, sorted, ends exclusive.
    """
    spans = written(repeated_spans(docs, size, id_col, text_col, hot_rows).select(F.col("doc").alias("_doc"), F.col("key").alias("_key"), "spans"), "substring-spans")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept, cut = [], [], [], []
            for data, some in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = data.split()
                own: list[list[int]] = []
                for start, end in sorted((s["start"], s["end"]) for s in some or ()):
                    if own and start <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], end)
                    else:
                        own.append([start, end])
                left = [words[a:b] for a, b in zip([0, *(e for _, e in own)], [*(s for s, _ in own), len(words)], strict=True)]
                n.append(len(words))
                gone.append(sum(b - a for a, b in own))
                kept.append(b" ".join([w for part in left for w in part]))
                cut.append([{"start": a, "end": b} for a, b in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(cut, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["id", "n_words", "n_removed", "kept", "removed"])

    texts = _texts(docs, id_col, text_col)
    met = texts.join(spans, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left").select("doc", "text", "spans")
    out = met.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string, removed array<struct<start: int, end: int>>")
    return out.withColumnRenamed("id", id_col)
