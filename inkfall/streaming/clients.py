"""What each client of the log has in view, as keyed state: a bounded buffer, and counts by level.

A client keeps its last CLIENT_HISTORY entries by time and number. Each is one entry of a map in the
client's state, so a batch writes what came and removes what went and leaves the rest alone. Counts by
level go up with what comes and down with what is evicted. Entries may come late or twice: one that is
older than all of a full buffer changes nothing, and one that is there already counts once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from inkfall.streaming.logs import CLIENT_HISTORY

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PLACE = T.StructType([T.StructField("timestamp", T.DoubleType()), T.StructField("seq", T.LongType())])
_HELD = T.StructType([T.StructField("level", T.StringType()), T.StructField("message", T.StringType())])
_COUNTS = T.StructType([T.StructField("batches", T.LongType()), T.StructField("levels", T.MapType(T.StringType(), T.LongType()))])
VIEW = "client string, batch long, counts map<string,long>, entries array<struct<timestamp: double, seq: long, level: string, message: string>>"


class ClientView(StatefulProcessor):
    """The view of one client: entries up to `limit`, shown at one level or all, and counts of all that are held."""

    def __init__(self, limit: int = CLIENT_HISTORY, level: str | None = None) -> None:
        self.limit, self.level = limit, level

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", _PLACE, _HELD)
        self.counts = handle.getValueState("counts", _COUNTS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before = dict(self.held.iterator())
        came: dict[tuple, tuple] = {}
        for frame in rows:
            came.update({(float(t), int(s)): (level, message) for t, s, level, message in zip(frame["timestamp"], frame["seq"], frame["level"], frame["message"], strict=True)})
        new = {p: e for p, e in came.items() if p not in before}
        last = sorted([*before, *new])[-self.limit :]
        kept, (batches, levels) = set(last), self.counts.get() if self.counts.exists() else (0, {})
        count = Counter(levels)
        for place, entry in new.items():
            if place in kept:
                self.held.updateValue(place, entry)
                count[entry[0]] += 1
        for place, entry in before.items():
            if place not in kept:
                self.held.removeKey(place)
                count[entry[0]] -= 1
        levels = {k: n for k, n in count.items() if n}
        self.counts.update((batches + 1, levels))
        entry_of = lambda p: new[p] if p in new else before[p]
        shown = [(*p, *entry_of(p)) for p in last if self.level in (None, entry_of(p)[0])]
        yield pd.DataFrame({"client": [key[0]], "batch": [batches + 1], "counts": [levels], "entries": [[dict(zip(("timestamp", "seq", "level", "message"), e, strict=True)) for e in shown]]})

    def close(self) -> None:
        pass


def views(log: DataFrame, limit: int = CLIENT_HISTORY, level: str | None = None, client_col: str = "client") -> DataFrame:
    """(client, batch, counts, entries) of each client that a batch has entries for, numbered by the client's batches."""
    rows = log.select(log[client_col].cast("string").alias("client"), "timestamp", "seq", "level", "message")
    return rows.groupBy("client").transformWithStateInPandas(ClientView(limit, level), outputStructType=VIEW, outputMode="Update", timeMode="None")


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Keyed state of this kind needs the store on RocksDB, which a query takes from the settings when it starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def keep_views(log: DataFrame, out: str, checkpoint: str, limit: int = CLIENT_HISTORY, level: str | None = None, client_col: str = "client") -> StreamingQuery:
    """Write each batch's views under `out` as one folder a batch, which a batch that runs again replaces; until the input is used up."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/part={number}")

    with _state_store(log.sparkSession):
        return views(log, limit, level, client_col).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_views(spark: SparkSession, out: str) -> DataFrame:
    """Each client's last view."""
    from pyspark.sql import functions as F

    rows = spark.read.schema(VIEW).parquet(out)
    return rows.groupBy("client").agg(F.max_by(F.struct("batch", "counts", "entries"), "batch").alias("v")).select("client", "v.*")
