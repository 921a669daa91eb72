"""Best-fit packing of documents into sequences of bounded length.

Which documents share a sequence depends on their lengths alone, and there are no more lengths
than tokens in a sequence, so the packing is solved on the counts of the lengths: first the
dominance reduction of Martello and Toth fixes sets that are at least as good as any other for
their largest document, then best fit decreasing places the remainder. Its answer is a short list
of patterns with how often each is used. Documents take their places in it by their rank among the
documents sorted by length, which a range partitioning and prefix sums over partitions give.

pack_in_order packs documents that have an order, such as that of a mixture: the same is done for
each window of so many consecutive documents, and the sequences are numbered window by window.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, partitions, small_batches, text_of, written
from .tokens import Sent


@dataclass
class Pattern:
    """`times` sequences, each with so many documents of each length."""

    times: int
    items: list[tuple[int, int]] = field(default_factory=list)

    def used(self) -> int:
        return sum(size * n for size, n in self.items)


class _Lengths:
    """Counts of lengths, with the smallest and the largest one that fits."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def without(self, size: int) -> _Lengths:
        """The lengths but for one document."""
        rest = _Lengths(self.count)
        rest.take(size, 1)
        return rest

    def at_most(self, room: int, but: int = 0) -> int:
        """The largest length up to `room`, 0 if none; `but`: a length of which one is in use."""
        i = bisect_left(self.sizes, room + 1) - 1
        while i >= 0 and self.sizes[i] == but and self.count[but] < 2:
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def smallest(self, n: int, but: int) -> list[int]:
        """The n smallest documents' lengths without one of length `but`."""
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(n - len(out), self.count[size] - (size == but))
            if len(out) == n:
                break
        return out

    def largest_pair(self, room: int, but: int) -> int:
        """The most that two documents of up to room in all hold, without one of length `but`; 0 if none fit."""
        i, j, most = 0, len(self.sizes) - 1, 0
        while i <= j:
            a, b = self.sizes[i], self.sizes[j]
            if self.count[a] - (a == but) < 1:
                i += 1
            elif self.count[b] - (b == but) < 1 or a + b > room:
                j -= 1
            else:
                if i < j or self.count[a] - (a == but) > 1:
                    most = max(most, a + b)
                i += 1
        return most


def _dominating(left: _Lengths, large: int, capacity: int) -> list[int] | None:
    """Partners with which a document of this length is as well off as with any others."""
    room = capacity - large
    best = left.at_most(room, large)
    if not best:
        return []
    if best == room:
        return [best]  # whatever else fits beside it fits into the partner's place
    least = left.smallest(3, large)
    if len(least) < 2 or sum(least[:2]) > room:
        return [best]  # at most one partner fits
    if len(least) == 3 and sum(least) <= room:
        return None
    # At most two partners fit.
    if left.largest_pair(room, large) <= best:
        return [best]
    second = left.without(large).without(best).at_most(room - best)
    if second and second >= left.at_most(room // 2, large):
        return [best, second]
    return None


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that an optimal packing may be taken to have, and the lengths that are left."""
    left, fixed = _Lengths(counts), []
    again = True
    while again:
        again = False
        for large in sorted(left.sizes, reverse=True):
            while left.count.get(large):
                partners = _dominating(left, large, capacity)
                if partners is None:
                    break
                need: dict[int, int] = {}
                for size in (large, *partners):
                    need[size] = need.get(size, 0) + 1
                times = min(left.count[size] // n for size, n in need.items())
                if len(partners) == 2:
                    # The proof is for the lengths as they are now, and it looks at four of a length at most.
                    times = max(1, min((left.count[size] - 4) // n + 1 for size, n in need.items()))
                for size, n in need.items():
                    left.take(size, times * n)
                fixed.append(Pattern(times, sorted(need.items(), reverse=True)))
                again = True
    return fixed, dict(left.count)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing, with all documents of one length and all sequences alike at once."""
    open_: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(pattern: Pattern) -> None:
        room = capacity - pattern.used()
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(pattern)

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                pattern = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, pattern = capacity, Pattern(-(-n // (capacity // size)))
            each = min(room // size, n)  # the tightest sequence stays so until it is full for this length
            times = min(pattern.times, n // each)
            put(Pattern(times, [*pattern.items, (size, each)]))
            if pattern.times > times and pattern.items:
                put(Pattern(pattern.times - times, pattern.items))
            n -= times * each
    return [p for some in open_.values() for p in some]


def packed(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, rest = reduced(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _runs(patterns: list[Pattern], counts: dict[int, int]) -> np.ndarray:
    """Rows (first rank, documents, documents in a sequence, length, first sequence, offset) by rank.

    A pattern has at most 90 different lengths of up to 4096 tokens together, and there are a few
    patterns for each length, so this stays within some tens of megabytes for any corpus.
    """
    start = dict(zip(sorted(counts), np.cumsum([0, *(counts[s] for s in sorted(counts))]).tolist(), strict=False))
    rows, sequence = [], 0
    for pattern in patterns:
        offset = 0
        for size, n in pattern.items:
            rows.append((start[size], pattern.times * n, n, size, sequence, offset))
            start[size] += pattern.times * n
            offset += n * size
        sequence += pattern.times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def _places(runs: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences and offsets of documents by their ranks."""
    at = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1] if len(rank) else np.zeros((0, 6), np.int64)
    i = rank - at[:, 0]
    return at[:, 4] + i // np.maximum(at[:, 2], 1), at[:, 5] + i % np.maximum(at[:, 2], 1) * at[:, 3]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, position_col: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids][, position]): each document's ids and the end id, cut at the capacity.

    A null text is empty: one piece with the end id alone. Only documents longer than a sequence
    are cut; all pieces but the last fill one.
    """
    end = int(end_id).to_bytes(4, "little")
    sent = docs.sparkSession.sparkContext.broadcast(Sent(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = sent.value.encoder().ids
        for batch in batches:
            at, rows, cut = [], [], []
            for i, data in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                ids = encode(data) + end
                for k, first in enumerate(range(0, len(ids), capacity * 4)):
                    part = ids[first : first + capacity * 4]
                    at.append(i)
                    rows.append((k, first // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        cut.append(part)
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            rows_of = pa.array(at, pa.int64())
            out = [batch.column(0).take(rows_of), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])]
            out += [pa.array(cut, pa.binary())] * with_ids + [c.take(rows_of) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(out, names=names)

    position = [F.col(position_col).cast("long").alias("position")] if position_col else []
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, *["position"] * len(position)]
    schema = _piece_schema(docs, id_col, with_ids) + ", position long" * len(position)
    return docs.select(F.col(id_col).alias("id"), text_of(text_col), *position).mapInArrow(run, schema)


def _piece_schema(docs: DataFrame, id_col: str, with_ids: bool) -> str:
    return f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, each with sequence_id and its offset there.

    with_ids: each piece also carries its token ids, as little-endian unsigned 32-bit integers.
    Sequences are gapless from offset 0. Rows may repeat; each is packed. Equal lengths are dealt
    by id and piece, repeated ids in any order. Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pack-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(_runs(packed(counts, capacity), counts))
    row = F.monotonically_increasing_id()
    sorted_ = cut.repartitionByRange(partitions(spark), "length", "id", "piece").sortWithinPartitions("length", "id", "piece")
    sorted_ = written(sorted_.withColumn("_row", row), "pack-sorted").withColumn("_part", F.shiftright("_row", 33))
    sizes = sorted(sorted_.groupBy("_part").count().collect())  # a row for each partition
    base = dict(zip([p for p, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("_row").to_numpy(zero_copy_only=False)
            part = row >> 33
            seen = np.unique(part)
            first = np.array([base[int(p)] for p in seen], dtype=np.int64)
            rank = first[np.searchsorted(seen, part)] + (row & ((1 << 33) - 1)) if len(row) else row
            extra = [pa.array(x) for x in _places(runs.value, rank)]
            kept = [k for k, name in enumerate(batch.schema.names) if name not in ("_row", "_part")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *extra], names=[*(batch.schema.names[k] for k in kept), "sequence_id", "offset"])

    schema = _piece_schema(docs, id_col, with_ids) + ", sequence_id long, offset long"
    return sorted_.drop("_part").mapInArrow(place, schema).withColumnRenamed("id", id_col)


def pack_in_order(docs: DataFrame, tokenizer: str, position_col: str, window_docs: int, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, each with sequence_id and its offset there, packed in the order of a position.

    Documents whose position div window_docs is the same form a window. A sequence holds documents
    of one window alone, and sequence_id, which is window * 2^32 + the sequence's number in it,
    ascends with the windows and in them with the first document's position. Documents of one length
    are dealt by position. A window is one group: window_docs rows and one for each full sequence.
    """
    window = F.expr(f"position div {int(window_docs)}")

    def place(table: pa.Table) -> pa.Table:
        length, position, piece = (table.column(c).to_numpy() for c in ("length", "position", "piece"))
        sizes, n = np.unique(length, return_counts=True)
        counts = dict(zip(sizes.tolist(), n.tolist(), strict=True))
        rank = np.empty(len(length), np.int64)
        rank[np.lexsort((piece, position, length))] = np.arange(len(length))
        sequence, offset = _places(_runs(packed(counts, capacity), counts), rank)
        first = np.full(sequence.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, sequence, position)
        number = np.empty(len(first), np.int64)
        number[np.argsort(first, kind="stable")] = np.arange(len(first))
        ids = (position[0] // window_docs << 32) + number[sequence]
        return table.drop_columns(["position"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    schema = _piece_schema(docs, id_col, with_ids) + ", sequence_id long, offset long"
    with small_batches(docs.sparkSession, TEXT_ROWS):
        cut = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids, position_col), "pack-pieces")
    return cut.groupBy(window).applyInArrow(place, schema).withColumnRenamed("id", id_col)
