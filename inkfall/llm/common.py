"""What the operators of this package share: tables written on the way, and small bounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words, as a class of a regular expression.
SPACE = r"[\x20\x09-\x0D]"

#: Largest table, in bytes, that an operator sends to every executor.
BROADCAST_BYTES = 16 << 20

#: Rows of an Arrow batch where each row holds a whole text or its shingles.
TEXT_ROWS = 500

_own_base: list[str] = []


def scratch_base(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one if that is unset and Spark runs locally."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_base:
        _own_base.append("file://" + tempfile.mkdtemp(prefix="inkfall-"))
    return _own_base[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there goes when the driver ends."""
    folder = f"{scratch_base(spark)}/inkfall-{spark.sparkContext.applicationId}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(_remove, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


_cleaned: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone already; the folder is named after the application
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder.

    It cuts the lineage, outlives lost executors and gives each later reader the same rows in
    the same files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, tables are written by way of Arrow batches of so many rows at most, for rows that may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def plain(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns called c0, c1, ..., so that no column of its own meets one of an operator's; what names are called then."""
    columns = df.columns
    low = [c.lower() for c in columns]
    return df.toDF(*[f"c{k}" for k in range(len(columns))]), [f"c{columns.index(n) if n in columns else low.index(n.lower())}" for n in names]


def spare_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
