"""The log as a streaming source of its own: replay, then live; a limit that drops the oldest.

A log is a folder of numbered segments, each a file of JSON lines under the number of its first entry.
publish() appends a segment by an atomic rename that fails where the number is taken, so entries are
numbered without gaps, whoever writes. The source `inkfall_log` reads them:

    spark.dataSource.register(LogSource)
    spark.readStream.format("inkfall_log").option("replay", 500).option("limit", 10000).load(path)

A new query starts `replay` entries before the end and goes on live. Offsets are entry numbers, kept in
the query's checkpoint, so a query that is started again goes on behind the last entry it finished. A
batch takes all that is new; with a `limit` one that lies further behind takes only the last so many,
so a slow reader loses the oldest entries and no others. Each segment of a batch is a partition, read by
the task that has it. As a batch source it gives the whole log, or its last `tail` entries, from the
segments that hold them.

trim() deletes segments that lie wholly before the last so many entries; readers then begin with what
is left. The folder must be one that pyarrow's filesystems open.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from inkfall.sources import shared

HISTORY = 500
ENTRY = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("timestamp", T.DoubleType()), T.StructField("level", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("duration_ms", T.IntegerType()), T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])
SCHEMA = T.StructType([T.StructField("seq", T.LongType()), *ENTRY.fields])


def _lines(text: str) -> list[str]:
    return [line for line in text.split("\n") if line]


def publish(spark: SparkSession, folder: str, entries: list[dict]) -> int:
    """Append entries as one segment; the number that the next entry will have."""
    log, text = shared.NumberedFiles(spark, folder), "\n".join(json.dumps(e, ensure_ascii=False) for e in entries)
    while True:
        firsts = log.numbers()
        first = firsts[-1] + len(_lines(log.read(firsts[-1]))) if firsts else 0
        if not entries or log.publish(first, text):
            return first + len(entries)


def publish_rows(rows: DataFrame, folder: str, *order: str) -> int:
    """A whole table as a new log, in the order of its columns: each task writes its range as one segment.

    Columns are those of ENTRY, null where they lack. The log must be empty. The rows are laid down
    sorted first, so that a task that runs again writes the same segment.
    """
    spark = rows.sparkSession
    if shared.NumberedFiles(spark, folder).numbers():
        raise ValueError("the log has entries already")
    own = set(rows.columns)
    entry = F.struct(*[(F.col(f.name) if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRY])
    place = shared.scratch_path(spark, "log-rows")
    sized = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(entry).alias("line"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    sized.write.partitionBy("part").parquet(place)
    laid = spark.read.schema("line string, at long, part int").parquet(place)
    counts, first = dict(map(tuple, laid.groupBy("part").count().collect())), {}
    for part in sorted(counts):
        first[part] = sum(counts[p] for p in first)
    names = {part: f"{first[part]:020d}.json" for part in first}

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, at = None, None
        for batch in frames:
            for part, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != at:
                    if stream is not None:
                        stream.close()
                    log = _Folder(folder)
                    log.files.create_dir(log.folder, recursive=True)
                    stream, at = log.files.open_output_stream(f"{log.folder}/{names[part]}"), part
                stream.write(line.encode() + b"\n")
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], ["segments"])

    if names:
        laid.repartition(len(names), "part").sortWithinPartitions("part", "at").select("part", "line").mapInArrow(write, "segments int").agg(F.sum("segments")).collect()
    shared.delete(spark, place)
    return sum(counts.values())


def trim(spark: SparkSession, folder: str, keep: int = HISTORY) -> int:
    """Delete segments that the last `keep` entries do not touch; how many. The last segment stays."""
    log = shared.NumberedFiles(spark, folder)
    firsts = log.numbers()
    if not firsts:
        return 0
    from_ = firsts[-1] + len(_lines(log.read(firsts[-1]))) - keep
    old = [a for a, b in zip(firsts, firsts[1:], strict=False) if b <= from_]
    for first in old:
        shared.delete(spark, log.path(first))
    return len(old)


@dataclass
class Segment(InputPartition):
    """A file, the number of its first entry, and the numbers that are read from it."""

    path: str
    first: int
    begin: int
    end: int


class _Folder:
    def __init__(self, path: str) -> None:
        self.files, self.folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def text(self, path: str) -> str:
        with self.files.open_input_stream(path) as stream:
            return stream.read().decode()

    def segments(self) -> list[tuple[int, str]]:
        found = self.files.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return sorted((int(f.base_name[:20]), f.path) for f in found if f.base_name.endswith(".json") and f.base_name[:20].isdigit())

    def head(self) -> int:
        """The number that the next entry will have."""
        some = self.segments()
        return some[-1][0] + len(_lines(self.text(some[-1][1]))) if some else 0

    def between(self, begin: int, end: int) -> list[Segment]:
        some = self.segments()
        firsts = [first for first, _ in some]
        out = []
        for k in range(max(0, bisect.bisect_right(firsts, begin) - 1), bisect.bisect_left(firsts, end)):
            after = firsts[k + 1] if k + 1 < len(firsts) else end
            if max(begin, firsts[k]) < min(end, after):
                out.append(Segment(some[k][1], firsts[k], max(begin, firsts[k]), min(end, after)))
        return out

    def rows(self, part: Segment) -> Iterator[tuple]:
        for seq, line in enumerate(_lines(self.text(part.path)), part.first):
            if part.begin <= seq < part.end:
                entry = json.loads(line)
                extra = entry.get("extra")
                yield (seq, *(entry.get(f.name) for f in ENTRY.fields[:-1]), None if extra is None else {k: None if v is None else str(v) for k, v in extra.items()})


class _Live(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.replay, self.limit = options["path"], int(options.get("replay", HISTORY)), int(options.get("limit", 0))
        if self.replay < 0 or self.limit < 0:
            raise ValueError("replay and limit must not be negative")

    def initialOffset(self) -> dict:
        return {"next": max(0, _Folder(self.path).head() - self.replay)}

    def latestOffset(self) -> dict:
        return {"next": _Folder(self.path).head()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        begin = max(start["next"], end["next"] - self.limit) if self.limit else start["next"]
        return _Folder(self.path).between(begin, end["next"])

    def read(self, partition: Segment) -> Iterator[tuple]:
        return _Folder(self.path).rows(partition)


class _Whole(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.tail = options["path"], int(options.get("tail", 0))

    def partitions(self) -> Sequence[InputPartition]:
        log = _Folder(self.path)
        head = log.head()
        return log.between(max(0, head - self.tail) if self.tail else 0, head) or [Segment("", 0, 0, 0)]

    def read(self, partition: Segment) -> Iterator[tuple]:
        return _Folder(self.path).rows(partition) if partition.path else iter(())


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inkfall_log"

    def schema(self) -> T.StructType:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Live(dict(self.options))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Whole(dict(self.options))
