"""SimHash near-dedup: fingerprints, BK-trees over shards of them, connected components.

A fingerprint link is a Hamming distance of at most `radius` bits. The 64 bits are cut into
radius + 2 blocks; two linked fingerprints agree on at least two of these, so a shard is the set of
fingerprints that agree on a given pair of blocks, and every link lies within some shard. Each
shard's fingerprints form a BK-tree, whose children are keyed by their integer distance to the
parent, and each fingerprint's search follows only edges within the radius of its own distance.

The shards hold all the corpus, so they have no bound under which they could be sent to every
executor; a shard's tree meets its searches through the shuffle instead. A shard that would be
large is cut again by the blocks of its remaining bits, which loses no link either. Only distinct
fingerprints take part, and a tree gives the edges of a spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import TEXT_ROWS, partitions, plain, small_batches, text_of, written
from .components import components

#: Above this many fingerprints a shard is cut again by blocks of its remaining bits.
SHARD_ROWS = 20_000

#: Rows of one key that are compared with each other at a time, and with as many others.
BLOCK_ROWS = 4096

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], dtype=np.int64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of `size` words, lower-cased A-Z; of the whole if shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(r, 42) for r in runs), dtype=np.uint64, count=len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if more than half of the hashes have it; zero for no hashes."""
    if not len(hashes):
        return 0
    octets = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)
    sums = [np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)]
    set_ = np.concatenate(sums) * 2 > len(hashes)
    return int(np.packbits(set_, bitorder="little").view("<u8")[0])


def reseeded(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of the same shingles; seed 0 leaves them."""
    if not seed:
        return hashes
    odd = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        x = (hashes ^ (hashes >> np.uint64(31))) * odd
        x = (x ^ (x >> np.uint64(29))) * odd
    return x ^ (x >> np.uint64(32))


class BKTree:
    """Fingerprints by Hamming distance; a child is keyed by its distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, value: int, radius: int) -> list[int]:
        """Positions of all values within the radius."""
        found: list[int] = []
        if not self.values:
            return found
        stack = [0]
        while stack:
            at = stack.pop()
            gap = (self.values[at] ^ value).bit_count()
            if gap <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if gap - radius <= edge <= gap + radius:
                    stack.append(child)
        return found

    def add(self, value: int) -> None:
        """Add a value that is not in the tree yet."""
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)


def forest(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links within the radius that connect all that are linked, one less than a component's size."""
    tree, root = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        for j in tree.search(value, radius):
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                yield value, values[j]
        tree.add(value)


def _masks(free: int, blocks: int, agree: int, base: int) -> list[int]:
    """Masks of `base` and any `agree` of the blocks into which the free bits are cut."""
    bits = [b for b in range(64) if free >> b & 1]
    cuts = [sum(1 << int(b) for b in part) for part in np.array_split(bits, blocks)] if bits else []
    return [base | sum(some) for some in combinations(cuts, agree)] or [base]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _keyed(rows: DataFrame, masks: Column) -> DataFrame:
    """A row for each mask of the array: the shard is the mask and the bits of fp under it."""
    return rows.select("fp", "seed", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def _lits(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)) for m in masks])


def _shard_links(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(left: list[int], right: list[int], seed: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_signed(x) for x in left], pa.int64()), pa.array([_signed(x) for x in right], pa.int64()), pa.array(seed, pa.int32())], names=["a", "b", "seed"])

        a: list[int] = []
        b: list[int] = []
        s: list[int] = []
        rest = [np.zeros(0, np.int64)] * 4
        for batch in _and_none(batches):
            if batch is not None:
                new = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
                rest = [np.concatenate(x) for x in zip(rest, new, strict=True)]
            fp, seed, mask, key = rest
            if not len(fp):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (mask[1:] != mask[:-1]) | (seed[1:] != seed[:-1])]))
            ends = np.concatenate([starts[1:], [len(fp)]])
            if batch is not None:  # the last shard may go on in the next batch
                last = starts[-1]
                starts, ends = starts[:-1], ends[:-1]
            for i in np.flatnonzero(ends - starts > 1):
                values = [int(x) for x in fp[starts[i] : ends[i]].astype(np.uint64)]
                for x, y in forest(values, radius):
                    a.append(x)
                    b.append(y)
                    s.append(int(seed[starts[i]]))
            rest = [x[last:] for x in rest] if batch is not None else [x[:0] for x in rest]
            if len(a) > 50_000:
                yield out(a, b, s)
                a, b, s = [], [], []
        yield out(a, b, s)

    return link


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(distinct: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b, seed): links that connect all linked fingerprints. distinct: (fp, seed) without repeats."""
    spark = distinct.sparkSession
    every = (1 << 64) - 1
    masks, parts = _masks(every, radius + 2, 2, 0), []
    level = _keyed(distinct, _lits(masks))
    for depth in range(3):
        counts = level.groupBy("seed", "mask", "key").count().where(f"count > {shard_rows}")
        hot = written(counts.select(F.col("seed").alias("_s"), F.col("mask").alias("_m"), F.col("key").alias("_k")), "simhash-hot")
        if depth == 2 or hot.isEmpty():
            parts.append(level)
            break
        on = (F.col("seed") == F.col("_s")) & (F.col("mask") == F.col("_m")) & (F.col("key") == F.col("_k"))
        parts.append(level.join(hot, on, "left_anti"))
        finer = {m: _masks(every & ~m, radius + 1, 1, m) for m in masks}
        cut = F.create_map(*[x for m, some in finer.items() for x in (F.lit(_signed(m)), _lits(some))])
        level = written(_keyed(level.join(hot, on, "left_semi"), F.element_at(cut, F.col("mask"))).distinct(), "simhash-finer")
        masks = sorted({x for some in finer.values() for x in some})
    found = None
    for part in parts:
        dealt = part.repartition(max(partitions(spark), 1), "seed", "mask", "key").sortWithinPartitions("seed", "mask", "key", "fp")
        some = dealt.select("fp", "seed", "mask", "key").mapInArrow(_shard_links(radius), "a long, b long, seed int")
        found = some if found is None else found.union(some)
    return found


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of each row's whole text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(shingle_hashes(t, size))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_of(text_col)).mapInArrow(run, f"id {kind}, fp long")


def near_components(docs: DataFrame, size: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Fingerprints are of `size`-word shingles, repeats included. component_id is the smallest doc_id
    that links reach; a null doc_id never is, unless a component has no other. Texts without words
    share the fingerprint zero and are linked like any others. Other columns are not read.
    """
    rows = written(fingerprints(docs, size, id_col, text_col), "simhash-rows")
    classes = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    edges = links(classes.select("fp", F.lit(0).alias("seed")), radius, shard_rows).select("a", "b")
    roots = written(components(edges, "a", "b"), "simhash-roots")
    joined = written(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-joined")
    least = written(joined.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root"), "simhash-least")
    label = written(joined.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id"), "simhash-labels")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(label, F.col("fp") == F.col("_fp")).select(F.col("id").alias(id_col), digits, "component_id")


#: Fingerprints of independent seeds that the pipeline's stage takes.
SEEDS = 2
#: Keys of a text, each of the least hashes under BAND_ROWS orders of its shingles: two texts of a
#: similarity of 0.8 have some key in common but for 1 - (1 - 0.8^7)^40, less than once in 10,000.
BANDS, BAND_ROWS = 40, 7
#: Bits of the parities of a set of shingles; see parities().
PARITIES = 1024

_ODD = (np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 31, BANDS * BAND_ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def _sets(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles): all distinct shingle hashes of each row, sorted, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, size)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_of(text_col)).mapInArrow(run, f"id {kind}, shingles binary")


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes; those of an empty set are equal for all such sets."""
    short = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(_ODD), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for first in range(0, len(short), 512):
            np.minimum(least, (short[first : first + 512] * _ODD[:, None]).min(axis=1), out=least)
        keys = np.arange(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
            keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(29)
    return keys


def parities(shingles: np.ndarray) -> bytes:
    """For each of PARITIES residues whether an odd number of the hashes has it.

    Two sets differ in at least as many shingles as their parities do in bits.
    """
    counts = np.bincount((reseeded(shingles, 99) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES)
    return np.packbits(counts & 1).tobytes()


def _able(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sets of sizes n and m and parities a and b may have the similarity; none that has it is left out."""
    apart = (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6
    able = np.abs(n - m) <= apart
    able[able] = np.bitwise_count(a[able] ^ b[able]).sum(axis=1) <= apart[able]
    return able


def _words64(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), PARITIES // 64)


def _sketched(docs: DataFrame, size: int, seeds: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, fps, bands, bits) of each row: distinct shingles, fingerprints, keys, parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, fps, bands, bits = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, size)
                fps.append([_signed(fingerprint(reseeded(hashes, k))) for k in range(seeds)])
                distinct = np.unique(hashes)
                ns.append(len(distinct))
                bands.append(band_keys(distinct).view(np.int64))
                bits.append(parities(distinct))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (fps, bands)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int32()), *lists, pa.array(bits, pa.binary())], names=["id", "n", "fps", "bands", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_of(text_col)).mapInArrow(run, f"id {kind}, n int, fps array<long>, bands array<long>, bits binary")


def _jaccard(a: bytes, b: bytes) -> float:
    one, two = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(one, two, assume_unique=True))
    union = len(one) + len(two) - both
    return both / union if union else 1.0


def _confirmed(pairs: DataFrame, rows: DataFrame, docs: DataFrame, size: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs (id, other) whose full shingle sets have the similarity; parities rule out most others."""
    kind = docs.schema[id_col].dataType.simpleString()

    def able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 4))
            yield batch.select([0, 1]).filter(pa.array(_able(n, m, _words64(batch.column(3)), _words64(batch.column(5)), similarity), pa.bool_()))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_jaccard(a.as_py(), b.as_py()) >= similarity for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(found, pa.bool_()))

    def met(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        one = table.select(F.col("id").alias("_i"), *[F.col(c).alias(f"_a{c}") for c in columns])
        two = table.select(F.col("id").alias("_j"), *[F.col(c).alias(f"_b{c}") for c in columns])
        found = pairs.join(one, F.col("id") == F.col("_i")).join(two, F.col("other") == F.col("_j"))
        return found.select("id", "other", *[f"_a{c}" for c in columns], *[f"_b{c}" for c in columns])

    likely = written(met(pairs, rows, "n", "bits").mapInArrow(able, f"id {kind}, other {kind}"), "near-likely")
    ids = likely.select(F.col("id").alias("_id")).union(likely.select("other")).distinct()
    with small_batches(docs.sparkSession, TEXT_ROWS):
        sets = written(_sets(docs.join(ids, F.col(id_col) == F.col("_id"), "left_semi"), size, id_col, text_col), "near-sets")
        return written(met(likely, sets, "shingles").mapInArrow(alike, f"id {kind}, other {kind}"), "near-confirmed")


def _key_pairs(similarity: float, kind: pa.DataType):
    """Pairs of rows (key, n, part, id, bits), sorted, of one key and not of one part that may have the similarity."""

    def out(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[i], kind), pa.array(ids[j], kind)], names=["id", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _and_none(batches):
            if batch is not None:
                new = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]] + [_words64(batch.column(4))]
                new[1] = new[1].astype(np.int64)
                rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            end = np.searchsorted(rest[0], rest[0][-1]) if batch is not None else len(rest[0])
            key, n, part, ids, bits = (x[:end] for x in rest)
            rest = [x[end:] for x in rest]  # the last key may go on in the next batch
            if not end:
                continue
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            new_part = new_key | np.concatenate([[True], part[1:] != part[:-1]])
            stop = np.append(np.flatnonzero(new_key), end)[np.cumsum(new_key)]
            later = np.append(np.flatnonzero(new_part), end)[np.cumsum(new_part)]
            i = np.flatnonzero(later < stop)
            j = later[i]
            some: list[tuple[np.ndarray, np.ndarray]] = []
            while len(i):
                for low in range(0, len(i), 50_000):
                    x, y = i[low : low + 50_000], j[low : low + 50_000]
                    able = _able(n[x], n[y], bits[x], bits[y], similarity)
                    some.append((x[able], y[able]))
                if sum(len(x) for x, _ in some) > 100_000:
                    yield out(ids, *map(np.concatenate, zip(*some, strict=True)))
                    some = []
                i, j = i[j + 1 < stop[i]], j[j + 1 < stop[i]] + 1
            if some:
                yield out(ids, *map(np.concatenate, zip(*some, strict=True)))

    return run


def _in_blocks(keyed: DataFrame) -> DataFrame:
    """Rows (h, part, id) of keys with their size, with h for each pair of the key's blocks that the row is in.

    A key of up to BLOCK_ROWS rows is one block. The rows of a larger one are dealt to blocks by their
    ids, and every two blocks meet under an h of their own, so every two rows do and no task holds
    more than two blocks of a key at a time.
    """
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("a"), F.greatest(b, F.col("own")).alias("b")))
    dealt = keyed.withColumn("own", own).withColumn("pair", F.explode(pairs))
    return dealt.select(F.xxhash64("h", "pair.a", "pair.b").alias("h"), "part", "id")


def near_copies(docs: DataFrame, size: int = 5, radius: int = 4, seeds: int = SEEDS, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root) over ids of near copies: components of the pairs with the similarity.

    The similarity is the Jaccard index of the sets of `size`-word shingles; texts without words are
    equal. Candidates are links of fingerprints of any seed and texts with a key in common. First
    the links of the fingerprints' forest and, for each key, those to its least id are confirmed on
    the full sets, and what they join is a part. Then all pairs that have a key in common and are
    not in one part are confirmed, so none is missed for a link that the first step left out or that
    failed. Rows with a null id take no part; rows that repeat an id are one node.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    kind = docs.schema[id_col].dataType.simpleString()
    with small_batches(docs.sparkSession, TEXT_ROWS):
        rows = written(_sketched(docs, size, seeds, id_col, text_col), "near-rows")
    marks = rows.select("id", F.posexplode("fps").alias("seed", "fp"))
    classes = written(marks.groupBy("seed", "fp").agg(F.min("id").alias("least")), "near-classes")
    edges = written(links(classes.select("fp", "seed"), radius), "near-links")
    first = classes.select(F.col("seed").alias("_s"), F.col("fp").alias("_f"), F.col("least").alias("other"))
    same = marks.join(first, (F.col("seed") == F.col("_s")) & (F.col("fp") == F.col("_f"))).where("id != other").select("id", "other")
    left = edges.join(first.withColumnRenamed("other", "id"), (F.col("seed") == F.col("_s")) & (F.col("a") == F.col("_f"))).select("seed", "b", "id")
    cross = left.join(first, (F.col("seed") == F.col("_s")) & (F.col("b") == F.col("_f"))).where("id != other").select("id", "other")
    keys = rows.select("id", F.explode("bands").alias("h"))
    shared = keys.groupBy(F.col("h").alias("_h")).agg(F.min("id").alias("other"), F.max("id").alias("most")).where("other != most").drop("most")
    held = written(keys.join(shared, F.col("h") == F.col("_h")).select("id", "h", "other"), "near-keys")
    stars = held.where("id != other").select("id", "other")
    pairs = written(same.union(cross).union(stars).distinct(), "near-pairs")
    near = _confirmed(pairs, rows, docs, size, similarity, id_col, text_col)
    parts = written(components(near, "id", "other").distinct(), "near-parts")
    held = held.join(parts, F.col("id") == F.col("node"), "left").select("h", F.coalesce("root", "id").alias("part"), "id")
    held = written(held, "near-held")
    mixed = held.groupBy(F.col("h").alias("_h")).agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("size")).where("low != high").select("_h", "size")
    asked = _in_blocks(held.join(mixed, F.col("h") == F.col("_h"))).join(rows.select(F.col("id").alias("_id"), "n", "bits"), F.col("id") == F.col("_id"))
    dealt = asked.select("h", "n", "part", "id", "bits").repartition(max(partitions(docs.sparkSession), 1), "h").sortWithinPartitions("h", "part", "id")
    met = dealt.mapInArrow(_key_pairs(similarity, to_arrow_type(docs.schema[id_col].dataType)), f"id {kind}, other {kind}").where("id != other").distinct()
    more = _confirmed(written(met, "near-met"), rows, docs, size, similarity, id_col, text_col)
    return components(near.union(more), "id", "other")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one row of each group of near copies, that of the smallest id."""
    own, (id_, text) = plain(docs, id_col, text_col)
    found = written(near_copies(own, id_col=id_, text_col=text, **options).where("node != root").select("node").distinct(), "near-dropped")
    return own.join(found, F.col(id_) == F.col("node"), "left_anti").toDF(*docs.columns)
