"""Exact dedup by a two-pass Bloom filter over hashes of the normalised texts.

Pass one counts the slots that each text's hash sets in a Bloom filter of two hash functions and
keeps, as bitmaps, those that were set twice or more. Pass two looks every hash up in these
bitmaps: a text with an unrepeated slot has no copy and passes straight through; only the others
are grouped, by their SHA-256. All of it is built-in expressions.

Defined results: a null text counts as empty. Texts are equal when identical after each run of
white space is one space. The row with the smallest doc_id stays; a null doc_id comes last, and of
rows that repeat a doc_id one stays. Other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SPACE, plain, text_of, written

#: Bits of the filter for each row, before rounding up to a power of two.
BITS_PER_ROW = 16
#: What a group of copies takes in memory, with room to spare.
GROUP_BYTES = 160


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), f"{SPACE}+", " ")


def _slots(sha: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(sha), F.lit(k)), F.lit(bits)) + 1 for k in (1, 2)]


def repeated_slots(hashes: DataFrame, sha: str, bits: int) -> DataFrame:
    """Pass one: (bucket, bitmap) of the slots that more than one insertion has set."""
    slot = hashes.select(F.explode(F.array(*_slots(sha, bits))).alias("slot"))
    return _bitmaps(slot.groupBy("slot").count().where("count > 1"))


def _bitmaps(slots: DataFrame) -> DataFrame:
    return slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap"))


def _is_set(bitmap: str, slot: str) -> Column:
    at = f"bitmap_bit_position({slot})"
    byte = f"cast(conv(hex(substring({bitmap}, cast({at} div 8 as int) + 1, 1)), 16, 10) as int)"
    return F.expr(f"{bitmap} is not null and (shiftright({byte}, cast({at} % 8 as int)) & 1) = 1")


def possibly_repeated(rows: DataFrame, filters: DataFrame, sha: str, bits: int, small: bool, flag: str) -> DataFrame:
    """Pass two: rows with a boolean column that is false only where the hash is surely single."""
    found = rows
    for k, slot in enumerate(_slots(sha, bits)):
        side = filters.select(F.col("bucket").alias(f"_bucket{k}"), F.col("bitmap").alias(f"_bitmap{k}"))
        found = found.withColumn(f"_slot{k}", slot)
        on = F.expr(f"bitmap_bucket_number(_slot{k})") == F.col(f"_bucket{k}")
        found = found.join(F.broadcast(side) if small else side, on, "left")
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return found.select(*kept, (_is_set("_bitmap0", "_slot0") & _is_set("_bitmap1", "_slot1")).alias(flag))


def _filter_bits(n: int, bits: int | None) -> int:
    return bits or 1 << max(16, math.ceil(math.log2(max(1, n) * BITS_PER_ROW)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256.

    bits: size of the filter, by default 16 to 32 for each row. It is sent to the executors while
    it takes 16 MB at most, and joined by its buckets beyond.
    """
    hashes = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(normalised(text_col), 256)).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "exact-hashes",
    )
    bits = _filter_bits(hashes.count(), bits)
    filters = written(repeated_slots(hashes, "sha", bits), "exact-filter")
    flagged = possibly_repeated(hashes, filters, "sha", bits, bits // 8 <= BROADCAST_BYTES, "maybe")
    maybe = flagged.where("maybe")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    groups = written(maybe.groupBy("sha").agg(F.count("*").alias("size"), first).where("size > 1"), "exact-groups")
    groups = groups.select(F.col("sha").alias("group_sha"), "size", "first")
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = lambda df: df.select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha
    )
    shared = maybe.join(groups, F.col("sha") == F.col("group_sha"), "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        sha,
    )
    return alone(flagged.where("not maybe")).union(shared)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """The documents without exact copies, with all their columns.

    Both passes read ids and hashes alone, from one reading of the texts. What comes back to the
    texts is one row for each group of copies: all of these where they take BROADCAST_BYTES at most,
    and beyond that a filter of them, by which single texts pass through and only the others are
    shuffled. Where that filter is too large as well, the texts are shuffled once.
    """
    own, (id_, text) = plain(docs, id_col, text_col)
    hashed = own.withColumn("sha", F.unhex(F.sha2(normalised(text), 256)))
    hashes = written(hashed.select(F.col(id_).alias("id"), "sha"), "exact-hashes")
    bits = _filter_bits(hashes.count(), bits)
    filters = written(repeated_slots(hashes, "sha", bits), "exact-filter")
    maybe = possibly_repeated(hashes, filters, "sha", bits, bits // 8 <= BROADCAST_BYTES, "maybe").where("maybe")
    rows = maybe.groupBy("sha", "id").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rows")).alias("first")
    groups = rows.groupBy("sha").agg(first, F.sum("rows").alias("size")).where("size > 1")
    groups = written(groups.select(F.col("sha").alias("group"), F.col("first.id").alias("keep"), F.col("first.rows").alias("rows")), "exact-groups")
    n = groups.count()
    own_columns = own.columns

    def firsts(some: DataFrame, small: bool) -> DataFrame:
        met = some.join(F.broadcast(groups) if small else groups, F.col("sha") == F.col("group"), "left")
        kept = met.where(F.col("group").isNull() | (F.col("rows") == 1) & F.col(id_).eqNullSafe(F.col("keep"))).select(*own_columns)
        if groups.where("rows > 1").isEmpty():
            return kept
        # Rows that repeat both id and text: one of them stays.
        again = met.where((F.col("rows") > 1) & F.col(id_).eqNullSafe(F.col("keep")))
        return kept.union(again.dropDuplicates(["sha"]).select(*own_columns))

    bits = _filter_bits(n, None)
    if n * GROUP_BYTES <= BROADCAST_BYTES:
        found = firsts(hashed, True)
    elif bits // 8 <= BROADCAST_BYTES:
        slots = groups.select(F.explode(F.array(*_slots("group", bits))).alias("slot")).distinct()
        flagged = possibly_repeated(hashed, written(_bitmaps(slots), "exact-group-filter"), "sha", bits, True, "maybe")
        found = flagged.where("not maybe").select(*own_columns).union(firsts(flagged.where("maybe"), False))
    else:
        found = firsts(hashed, False)
    return found.toDF(*docs.columns)
