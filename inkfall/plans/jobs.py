"""Chunk jobs: ids that a repeated run gives again, and executions that are stored as commits."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfall.operators.cleaning import CleaningConfig, cleaned_texts
from inkfall.operators.preview import preview_chunks, source_preview
from inkfall.plans.registry import chunk
from inkfall.plans.store import Store, fields_of


def _told(params: dict | None) -> str:
    return json.dumps(params or {}, sort_keys=True, ensure_ascii=False)


def told_cleaning(config: CleaningConfig | None) -> str | None:
    """A configuration as JSON; functions by their names."""
    if config is None:
        return None
    name = lambda f: f"{getattr(f, '__module__', '')}.{getattr(f, '__qualname__', repr(f))}" if callable(f) else str(f)
    return json.dumps(asdict(config), sort_keys=True, ensure_ascii=False, default=name)


def job_id(doc: Column, strategy: str, params: dict | None, cleaning: CleaningConfig | None = None) -> Column:
    parts = [F.lit(strategy), F.lit(_told(params)), *([F.lit(told_cleaning(cleaning))] if cleaning else [])]
    return F.sha2(F.concat_ws("|", F.coalesce(doc.cast("string"), F.lit("")), *parts), 256)


def with_ids(chunks: DataFrame, strategy: str, params: dict | None = None, id_col: str = "doc_id", parents: bool = False, cleaning: CleaningConfig | None = None) -> DataFrame:
    """Chunks with job_id, chunk_id and parent_id.

    parent_id is null, as chunks are stored without their parents; `parents` fills it with the id
    that the parent's own chunk has when parents are stored.
    """
    job = job_id(F.col(id_col), strategy, params, cleaning)
    own = F.sha2(F.concat_ws("|", job, F.col("chunk_index").cast("string")), 256)
    parent_job = job_id(F.col(id_col), strategy, {**(params or {}), "return_parents_only": True}, cleaning)
    index = F.get_json_object("metadata", "$.parent_index")
    parent = F.when(index.isNotNull(), F.sha2(F.concat_ws("|", parent_job, index), 256)) if parents else F.lit(None).cast("string")
    return chunks.withColumn("job_id", job).withColumn("chunk_id", own).withColumn("parent_id", parent)


def job_rows(chunks: DataFrame, strategy: str, params: dict | None = None, id_col: str = "doc_id") -> DataFrame:
    """(job_id, doc_id, strategy_name, params, total_chunks, status) of chunks with ids."""
    counts = chunks.groupBy("job_id", id_col).agg(F.count("*").alias("total_chunks"))
    return counts.select("job_id", id_col, F.lit(strategy).alias("strategy_name"), F.lit(_told(params)).alias("params"), "total_chunks", F.lit("completed").alias("status"))


def execute(docs: DataFrame, strategy: str, params: dict | None, out: str, *, embed=None, cleaning: CleaningConfig | None = None, id_col: str = "doc_id", text_col: str = "text", run: str = "", parents: bool = False) -> DataFrame:
    """Chunk every document into the store at `out` by one commit, and return the jobs, one for each document.

    Jobs come from the documents, so one without chunks has its row. Rows of one id are one job. The
    chunks are written once and counted where they are written.
    """
    spark, store = docs.sparkSession, Store(docs.sparkSession, out, docs.schema[id_col].dataType.simpleString())
    found = with_ids(chunk(docs, strategy, params, embed=embed, cleaning=cleaning, id_col=id_col, text_col=text_col), strategy, params, id_col, parents, cleaning)
    rows = found.withColumn("strategy_name", F.lit(strategy)).withColumn("fields", fields_of(F.col("metadata"))).withColumn("doc_id", F.col(id_col))
    name = store.write("chunks", rows)
    counts = store.written("chunks", name).groupBy(F.col("job_id").alias("of")).agg(F.count("*").alias("n"))
    jobs = docs.select(F.col(id_col).alias("doc_id")).distinct().withColumn("job_id", job_id(F.col("doc_id"), strategy, params, cleaning))
    told = jobs.join(counts, F.col("job_id") == F.col("of"), "left").select(
        "job_id", "doc_id", F.lit(strategy).alias("strategy_name"), F.lit(_told(params)).alias("params"), F.lit(told_cleaning(cleaning)).cast("string").alias("cleaning"),
        F.coalesce("n", F.lit(0)).alias("total_chunks"), F.lit("completed").alias("status"), F.lit(run).alias("run"), F.current_timestamp().alias("created_at"),
    )
    store.write("chunk_jobs", told, name)
    number = store.publish(name, ["chunk_jobs", "chunks"], "execute", run)
    return store.written("chunk_jobs", name).withColumn("number", F.lit(number))


def stored_chunks(spark: SparkSession, out: str) -> DataFrame:
    """Chunks of every job's last execution."""
    return Store(spark, out).chunks()


def preview(docs: DataFrame, strategy: str, params: dict | None = None, limit: int = 10, *, embed=None, cleaning: CleaningConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The first chunks of each document with their total, and the text that they cover."""
    cleaned = cleaned_texts(docs, cleaning, text_col)
    shown = preview_chunks(chunk(cleaned, strategy, params, embed=embed, id_col=id_col, text_col=text_col), limit, id_col)
    return shown, source_preview(cleaned, shown, id_col, text_col)
