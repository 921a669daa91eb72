"""Mixing sources to target weights by Pfair scheduling, with built-in expressions.

Each source's documents, in the order of a hash of their ids, form blocks of equal size. With W the
sum of the integer weights, block j (from 0) of a source of weight w may not start before slot
floor(j W / w), its release, and must stand before slot ceil((j + 1) W / w), its deadline; earliest
deadline first meets all of these, so at every slot each source's share deviates from its target by
less than one block. The order repeats after W slots, so one period is worked out on the driver,
from the weights alone, and every document finds its place by its rank within its source. The weights
are the caller's; the driver holds the number of documents of each of them and nothing else.

Defined results: sources without a weight, null among them, share the weight `other`, as one
source. Sources without documents take no part and the other weights keep their proportions. The
mixture ends where a named source first cannot fill a block; documents beyond it keep their place
but are not in the mixture. mix(whole=True) goes on past it: where the next block in turn is one
that its source does not have, partial blocks counting as blocks, the other sources start a new
schedule with what they have left, so that every document with a weight is in the mixture. Equal
ids are ranked in any order. Other columns, whatever their names, are carried along. What follows
the mixture reads its order from the files it is stored in, by in_order.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, plain, written


def period(weights: list[int]) -> list[list[int]]:
    """For each source, the slots of its blocks in one period, by earliest deadline first."""
    total = sum(weights)
    slots: list[list[int]] = [[] for _ in weights]
    waiting = [(0, i) for i, w in enumerate(weights) if w]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[i]) + 1) * total // weights[i]), i))
        _, i = heapq.heappop(ready)
        slots[i].append(slot)
        if len(slots[i]) < weights[i]:
            heapq.heappush(waiting, (len(slots[i]) * total // weights[i], i))
    return slots


def rounds(parts: list[int], blocks: list[int]) -> list[list[dict]]:
    """For each source, the schedules in which it takes part until all its blocks are placed.

    A schedule starts at slot `base` with the source's block `first` and ends where a source has
    no block for its turn; there is one for each source at most.
    """
    out: list[list[dict]] = [[] for _ in parts]
    done, base = [0] * len(parts), 0
    while live := [k for k in range(len(parts)) if done[k] < blocks[k]]:
        total, slots = sum(parts[k] for k in live), period([parts[k] for k in live])
        length = min((blocks[k] - done[k]) // parts[k] * total + some[(blocks[k] - done[k]) % parts[k]] for k, some in zip(live, slots, strict=True))
        for k, some in zip(live, slots, strict=True):
            out[k].append({"first": done[k], "base": base, "total": total, "weight": parts[k], "slots": some})
            done[k] += length // total * parts[k] + sum(s < length % total for s in some)
        base += length
    return out


def schedule(docs: DataFrame, weights: dict[str, int], other: int = 1, block_docs: int = 16, id_col: str = "doc_id", source_col: str = "source", whole: bool = False) -> DataFrame:
    """docs with _block, _release, _deadline, _slot, _position and _in_mix after its own columns."""
    own, (id_, source) = plain(docs, id_col, source_col)
    names = sorted(weights)
    group = F.coalesce(F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]), F.col(source)), F.lit(len(names))) if names else F.lit(0)
    keyed = own.withColumn("_group", group).withColumn("_hash", F.md5(F.col(id_).cast("string")))
    totals = dict(map(tuple, keyed.groupBy("_group").count().collect()))  # a row for each weight
    share = [*(weights[n] for n in names), other]
    used = [i for i in range(len(share)) if totals.get(i) and share[i]]
    parts = [share[i] for i in used]
    blocks = [-(-totals[i] // block_docs) for i in used]
    if whole:
        every, horizon = rounds(parts, blocks), sum(blocks)
    else:
        total, slots = sum(parts), period(parts)
        ends = [totals[i] // block_docs // p * total + some[totals[i] // block_docs % p] for i, p, some in zip(used, parts, slots, strict=True) if i < len(names) or len(used) == 1]
        every, horizon = [[{"first": 0, "base": 0, "total": total, "weight": p, "slots": some}] for p, some in zip(parts, slots, strict=True)], min(ends, default=0)
    # Sources are cut by their hash into about as many pieces as a piece has documents.
    digits = max(1, math.ceil(math.log(max(1, sum(totals.values())), 16) / 2))
    keyed = keyed.withColumn("_piece", F.substring(F.coalesce("_hash", F.lit("")), 1, digits))
    before = Window.partitionBy("_group").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = keyed.groupBy("_group", "_piece").count().select(F.col("_group").alias("_g"), F.col("_piece").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_group", "_piece").orderBy("_hash", id_)) - 1
    ranked = keyed.withColumn("_within", within).join(bases, (F.col("_group") == F.col("_g")) & (F.col("_piece") == F.col("_p")))
    of_group = F.from_json(F.lit(json.dumps({str(i): every[k] for k, i in enumerate(used)})), "map<string, array<struct<first: long, base: long, total: long, weight: long, slots: array<long>>>>")
    ranked = ranked.withColumn("_all", F.element_at(of_group, F.col("_group").cast("string"))).withColumn("_rank", F.col("_base") + F.col("_within")).withColumn("_block", F.expr(f"_rank div {block_docs}"))
    ranked = ranked.withColumn("_own", F.element_at(F.filter("_all", lambda r: r["first"] <= F.col("_block")), -1)).withColumn("_i", F.expr("_block - _own.first"))
    ranked = ranked.withColumn("_slot", F.expr("_own.base + _i div _own.weight * _own.total + element_at(_own.slots, cast(_i % _own.weight as int) + 1)"))
    placed = ranked.select(
        *own.columns,
        "_block",
        F.expr("_own.base + _i * _own.total div _own.weight"),
        F.expr("_own.base + ((_i + 1) * _own.total + _own.weight - 1) div _own.weight"),
        "_slot",
        F.expr(f"_slot * {block_docs} + _rank % {block_docs}"),
        F.coalesce(F.col("_slot") < horizon, F.lit(False)),
    )
    return placed.toDF(*docs.columns, "_block", "_release", "_deadline", "_slot", "_position", "_in_mix")


def mix(docs: DataFrame, weights: dict[str, int], **options) -> DataFrame:
    """The documents of the mixture, with their own columns, stored in the order of the schedule."""
    placed = schedule(docs, weights, **options)
    n = len(docs.columns)
    placed = placed.toDF(*[f"c{k}" for k in range(n)], "block", "release", "deadline", "slot", "position", "in_mix").where("in_mix")
    stored = placed.repartitionByRange(partitions(docs.sparkSession), "position").sortWithinPartitions("position")
    return stored.select(*[f"c{k}" for k in range(n)]).toDF(*docs.columns)


def _in_files(docs: DataFrame, *names: str) -> DataFrame:
    """docs under other names, with the number and path of each row's file and its place there."""
    at = docs.metadataColumn("_metadata")
    return docs.select("*", F.regexp_extract(at["file_name"], r"^part-(\d+)", 1).try_cast("long"), at["file_path"], at["row_index"]).toDF(*names, "part", "file", "row")


def in_order(docs: DataFrame, position: str = "_position") -> DataFrame:
    """docs as a stored mixture is read, with each row's place in it, from 0 and gapless, as a last column.

    The order is that of the numbers in Spark's file names, and in a file that of its rows. A table
    that was not read from Parquet files is stored first, in the order of its partitions.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    try:
        rows = _in_files(docs, *names)
    except AnalysisException:
        rows = _in_files(written(docs, "mix-order"), *names)
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("part", "file").count()  # a row for each file
    bases = files.select(F.col("file").alias("f"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    placed = rows.join(F.broadcast(bases), F.col("file") == F.col("f"))
    return placed.select(*names, F.col("base") + F.col("row")).toDF(*docs.columns, position)
