"""The tables documents, chunk_jobs and chunks, written by commits and read as snapshots.

A commit's rows are Parquet files under `{table}/commit={id}`. They count once a manifest names the
commit: one small file under the next number of `_log`, which appears whole or not at all and never
replaces another. So a run that breaks off between files leaves the snapshot as it was, readers never
see half a commit, and of two runs at once each gets a number of its own.

The number orders commits, whatever their runs are called. Of a document's versions, and of a job's
executions, the one of the highest number is read. A job is one document under one strategy, with its
parameters and cleaning; it stands even if it made no chunks, and then hides those it made before.
Deleted documents are rows of a table of tombstones; they hide what came before them, with its jobs
and chunks.

What is hidden is found on narrow columns and anti-joined, so texts are not shuffled where few rows
are superseded. Every CHECKPOINT commits the state of the log is written as one file, so that a reader
opens that and the manifests after it. compact() writes a snapshot as one commit that takes the place
of those before it; vacuum() deletes files that no snapshot reads any more.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfall.sources import shared

CHECKPOINT = 32

#: Keys of chunk metadata that are stored as columns of their own; see the strategies for their values.
FIELDS = (
    "chunk_size", "chunk_overlap", "breakpoint_threshold", "breakpoint_type", "strip_headers", "Header 1", "Header 2", "Header 3", "Header 4",
    "granularity", "parent_index", "child_index", "strategy", "element_type", "type", "page_number", "parser", "page_range",
    "table_title", "table_index", "row_index", "dim_0", "dim_1", "dim_2", "dim_3", "dim_4", "employee_name", "score", "weight",
)

SCHEMAS = {
    "documents": "id {id}, filename string, file_path string, file_size long, content_text string, created_at timestamp",
    "chunk_jobs": "job_id string, doc_id {id}, strategy_name string, params string, cleaning string, total_chunks long, status string, run string, created_at timestamp",
    "chunks": "chunk_id string, job_id string, doc_id {id}, strategy_name string, chunk_index int, text string, metadata string, fields struct<" + ", ".join(f"`{k}`: string" for k in FIELDS) + ">, parent_id string, char_start int, char_end int",
    "tombstones": "doc_id {id}",
}


class Conflict(RuntimeError):
    """Another commit came between a snapshot and what was made of it."""


def fields_of(metadata: Column) -> Column:
    """The keys of FIELDS of a JSON object, as strings."""
    return F.struct(*[F.get_json_object(metadata, f"$['{k}']").alias(k) for k in FIELDS])


def metadata_equals(filters: dict | None) -> Column:
    """All keys equal, as strings: columns of their own where the key has one, which reaches the scan; else read from the JSON."""
    out = F.lit(True)
    for key, value in (filters or {}).items():
        at = F.col("fields")[key] if key in FIELDS else F.get_json_object("metadata", "$['" + key.replace("'", "\\'") + "']")
        out = out & (at == F.lit(str(value)))
    return out


class Store:
    """The tables under one folder. Ids of documents have one type, that of the first commit: id_type, or else string."""

    def __init__(self, spark: SparkSession, root: str, id_type: str | None = None) -> None:
        self.spark, self.root, self._wanted = spark, root.rstrip("/"), id_type or "string"
        self.log = shared.NumberedFiles(spark, f"{self.root}/_log")
        self.states = shared.NumberedFiles(spark, f"{self.root}/_log/states")

    @property
    def id_type(self) -> str:
        first = next(iter(self.log.numbers()), None)
        return self._wanted if first is None else json.loads(self.log.read(first)).get("id_type", self._wanted)

    def schema(self, table: str) -> str:
        return SCHEMAS[table].replace("{id}", self.id_type)

    # The log.

    def last(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max(self.log.numbers(), default=0)

    def history(self, number: int | None = None) -> list[dict]:
        """Manifests of the commits that a snapshot reads, in order."""
        number = self.last() if number is None else number
        start = max((n for n in self.states.numbers() if n <= number), default=0)
        live = json.loads(self.states.read(start)) if start else []
        for n in self.log.numbers():
            if start < n <= number:
                live = _after(live, json.loads(self.log.read(n)) | {"number": n})
        return live

    def commit(self, tables: dict[str, DataFrame], operation: str, run: str = "", base: int | None = None, replaces: Iterable[str] = ()) -> int:
        """Write rows of each table, then the manifest that makes them count; its number.

        With a base the commit is refused if another one came after that number.
        """
        name = uuid.uuid4().hex
        for table, rows in tables.items():
            self.write(table, rows, name)
        return self.publish(name, sorted(tables), operation, run, base, replaces)

    def write(self, table: str, rows: DataFrame, name: str | None = None) -> str:
        """Rows of a table under a commit's name, a new one unless given. They count when it is published."""
        name = name or uuid.uuid4().hex
        columns = self.spark.createDataFrame([], self.schema(table)).schema
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in columns]).write.option("compression", "zstd").parquet(f"{self.root}/{table}/commit={name}")
        return name

    def written(self, table: str, name: str) -> DataFrame:
        """The rows of one commit."""
        return self.spark.read.schema(self.schema(table)).parquet(f"{self.root}/{table}/commit={name}")

    def publish(self, name: str, tables: list[str], operation: str, run: str = "", base: int | None = None, replaces: Iterable[str] = ()) -> int:
        """Put the manifest of files that are already there under the next free number."""
        manifest = {"commit": name, "tables": tables, "operation": operation, "run": run, "id_type": self.id_type, "replaces": sorted(replaces), "at": time.time()}
        while True:
            number = (self.last() if base is None else base) + 1
            if self.log.publish(number, json.dumps(manifest, ensure_ascii=False)):
                break
            if base is not None:
                raise Conflict(f"commit {number} came first")
        if number % CHECKPOINT == 0:
            self.states.publish(number, json.dumps(self.history(number), ensure_ascii=False))
        return number

    # Snapshots.

    def _rows(self, table: str, number: int | None) -> DataFrame:
        """Every row of the live commits with its commit's number as _number."""
        live = [m for m in self.history(number) if table in m["tables"]]
        schema = f"{self.schema(table)}, commit string"
        if not live:
            return self.spark.createDataFrame([], schema).drop("commit").withColumn("_number", F.lit(0))
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}")
        rows = reader.parquet(*[f"{self.root}/{table}/commit={m['commit']}" for m in live])
        numbers = F.create_map(*[F.lit(x) for m in live for x in (m["commit"], m["number"])])
        return rows.withColumn("_number", F.element_at(numbers, F.col("commit"))).drop("commit")

    def _hidden(self, rows: DataFrame, key: str, doc: str, number: int | None) -> DataFrame:
        """(key, _number) of the rows that a later commit or a tombstone hides."""
        narrow = rows.select(key, doc, "_number").distinct()
        last = narrow.groupBy(F.col(key).alias("_key")).agg(F.max("_number").alias("_last"))
        older = narrow.join(last, F.col(key) == F.col("_key")).where("_number < _last").select(key, "_number")
        gone = self._rows("tombstones", number).groupBy(F.col("doc_id").alias("_gone")).agg(F.max("_number").alias("_when"))
        dead = narrow.join(gone, F.col(doc) == F.col("_gone")).where("_number < _when").select(key, "_number")
        return older.union(dead).distinct()

    def documents(self, number: int | None = None) -> DataFrame:
        rows = self._rows("documents", number)
        return rows.join(self._hidden(rows, "id", "id", number), ["id", "_number"], "left_anti").drop("_number")

    def _jobs(self, number: int | None) -> tuple[DataFrame, DataFrame]:
        rows = self._rows("chunk_jobs", number)
        return rows, self._hidden(rows, "job_id", "doc_id", number)

    def chunk_jobs(self, number: int | None = None) -> DataFrame:
        """Each job's last execution, with the number of its commit."""
        rows, hidden = self._jobs(number)
        return rows.join(hidden, ["job_id", "_number"], "left_anti").withColumnRenamed("_number", "number")

    def chunks(self, number: int | None = None, strategy: str | None = None, filters: dict | None = None) -> DataFrame:
        """Chunks of the jobs' last executions, of one strategy and with equal metadata if asked."""
        rows = self._rows("chunks", number)
        rows = rows.where(F.col("strategy_name") == strategy) if strategy else rows
        rows = rows.where(metadata_equals(filters)) if filters else rows
        return rows.join(self._jobs(number)[1], ["job_id", "_number"], "left_anti").drop("_number")

    # Changes.

    def add_documents(self, docs: DataFrame, run: str = "") -> int:
        """Rows of the documents table; columns that docs lacks are null. Later rows of an id take the place of earlier ones."""
        own = {c.lower(): c for c in docs.columns}
        rows = docs.select(*[(F.col(f"`{own[f.name.lower()]}`") if f.name.lower() in own else F.lit(None)).alias(f.name) for f in self.spark.createDataFrame([], self.schema("documents")).schema])
        return self.commit({"documents": rows}, "add_documents", run)

    def delete_documents(self, ids: DataFrame, id_col: str = "id", run: str = "") -> int:
        """Hide the documents of these ids with their jobs and chunks. Documents added later under the ids are there again."""
        return self.commit({"tombstones": ids.select(F.col(id_col).cast(self.id_type).alias("doc_id")).where("doc_id is not null").distinct()}, "delete_documents", run)

    def compact(self) -> int:
        """The snapshot as one commit in place of all before it; refused if another commit comes first."""
        base = self.last()
        live = self.history(base)
        tables = {"documents": self.documents(base), "chunk_jobs": self.chunk_jobs(base), "chunks": self.chunks(base)}
        held = {t: rows for t, rows in tables.items() if any(t in m["tables"] for m in live)}
        return self.commit(held, "compact", base=base, replaces=[m["commit"] for m in live])

    def vacuum(self, older_than: float = 7 * 86400.0) -> list[str]:
        """Delete files of commits that are in no snapshot from the last one on, if they are older than so many seconds."""
        live, dropped = {m["commit"] for m in self.history()}, []
        for table in SCHEMAS:
            for name in shared.names(self.spark, f"{self.root}/{table}"):
                place = f"{self.root}/{table}/{name}"
                if name.removeprefix("commit=") not in live and shared.modified(self.spark, place) < time.time() - older_than:
                    shared.delete(self.spark, place)
                    dropped.append(place)
        return dropped


def _after(live: list[dict], manifest: dict) -> list[dict]:
    gone = set(manifest.get("replaces", ()))
    return [m for m in live if m["commit"] not in gone] + [manifest]
