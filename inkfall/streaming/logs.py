"""The operational log as a stream: entries, a bounded history, counts by level."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkfall.streaming import log_source
from inkfall.streaming.log_source import HISTORY

LEVELS = ("debug", "info", "warn", "error", "success")
CLIENT_HISTORY = 1000
SCHEMA = log_source.ENTRY


def entry(message: str, level: str = "info", source: str = "", duration_ms: int | None = None, **extra: object) -> dict:
    return {"id": uuid.uuid4().hex[:8], "timestamp": time.time(), "level": level, "message": message, "source": source, "duration_ms": duration_ms, "extra": {k: str(v) for k, v in extra.items()}}


def emit(spark: SparkSession, path: str, entries: list[dict]) -> int:
    """Append entries to the log's folder, where every reader's stream finds them; the number of the next entry."""
    return log_source.publish(spark, path, entries)


def subscribe(spark: SparkSession, path: str, replay: int = HISTORY, limit: int = 0) -> DataFrame:
    """The last `replay` entries, then what comes. A reader that falls more than `limit` behind loses the oldest; 0 is no limit."""
    spark.dataSource.register(log_source.LogSource)
    return spark.readStream.format("inkfall_log").option("replay", replay).option("limit", limit).load(path)


def tail(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """The last entries in the order they were written; 1 to 1000. Only the segments that hold them are read."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    spark.dataSource.register(log_source.LogSource)
    return spark.read.format("inkfall_log").option("tail", limit).load(path).orderBy("seq")


def history(log: DataFrame, limit: int = 100) -> DataFrame:
    """The last entries in the order of time; 1 to 1000."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    return log.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit).orderBy("timestamp", "id")


def of_level(log: DataFrame, *levels: str) -> DataFrame:
    return log.where(F.col("level").isin(*levels)) if levels else log


def level_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("level").agg(F.count("*").alias("n"))


def windowed_counts(log: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Counts by level and window; entries later than `late` behind the newest are left out."""
    timed = log.withColumn("ts", F.timestamp_seconds("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "level").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "level", "n")


def keep_history(stream: DataFrame, out: str, limit: int = HISTORY, checkpoint: str | None = None) -> StreamingQuery:
    """Maintain the last `limit` entries at `out`: each batch is merged into a new version.

    Versions are numbered by batch, so a batch that runs again writes the same version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        both = batch.select(*[f.name for f in SCHEMA])
        if number:
            both = spark.read.schema(SCHEMA).parquet(f"{out}/v{number - 1}").union(both)
        both.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit).coalesce(1).write.mode("overwrite").parquet(f"{out}/v{number}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint or f"{out}/_checkpoint")
    return writer.trigger(availableNow=True).start()


def newest(spark: SparkSession, out: str) -> DataFrame:
    """The history as of the last batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    numbers = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()]
    return spark.read.schema(SCHEMA).parquet(f"{out}/v{max(numbers)}") if numbers else spark.createDataFrame([], SCHEMA)


def clear(spark: SparkSession, out: str) -> None:
    """Empty the history: the last version becomes one without entries."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    last = max((int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()), default=0)
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{out}/v{last}")


def subscribers(spark: SparkSession) -> int:
    return len(spark.streams.active)
