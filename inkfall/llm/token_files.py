"""Token ids as flat binary files that readers map into memory.

Each range of documents, in ascending order of id, becomes one shard of three files:
`NNNNN.bin`, its ids as unsigned little-endian integers of 16 bits, or 32 where the vocabulary
needs them; `NNNNN.off`, unsigned 64-bit offsets into these, one more than documents; and
`NNNNN.doc`, the documents' 64-bit ids. A manifest in Parquet beside them names the shards with
their counts; the prefix sums of these give each shard's base in the whole corpus.

A task writes under a name of its own attempt and renames at the end, so that a task that runs
again leaves the same files.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, scratch_path, spare_name, text_of
from .tokens import encoder

_NO_ID = -(1 << 63)  # stands for a null id in .doc files


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if urlparse(uri).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def _mapped(uri: str, dtype: str) -> np.ndarray:
    """A file's integers: mapped where the shared folder is a mounted one, else read."""
    system, path = _filesystem(uri)
    if not isinstance(system, pafs.LocalFileSystem):
        with system.open_input_file(path) as f:
            return np.frombuffer(f.readall(), dtype)
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write all documents and return the manifest: (shard, uri, width, n_docs, n_tokens).

    A null text is empty and has the end id alone. A null id comes first. Rows that repeat an id
    stand next to each other, ordered by their text. path must be a folder that all machines share.
    """
    spark = docs.sparkSession
    end = int(end_id).to_bytes(4, "little")
    tie = spare_name(docs, "_tie")
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_of(text_col).alias(text_col), F.xxhash64(text_of(text_col)).alias(tie))
    rows = rows.repartitionByRange(shards or partitions(spark), id_col, tie).sortWithinPartitions(id_col, tie, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = 2 if encode.library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        shard = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if shard is None:
                system, folder = _filesystem(path)
                system.create_dir(folder, recursive=True)
                shard = int(batch.column(2)[0].as_py())
                name = f"{folder}/{shard:05d}"
                part = f"{folder}/.{shard:05d}-{uuid.uuid4().hex}"
                streams = {x: system.open_output_stream(part + x) for x in (".bin", ".off", ".doc")}
                streams[".off"].write(np.zeros(1, "<u8").tobytes())
                n_docs = n_tokens = 0
            counts = []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                ids = encode.ids(data) + end
                counts.append(len(ids) // 4)
                streams[".bin"].write(np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes())
            streams[".off"].write((n_tokens + np.cumsum(counts)).astype("<u8").tobytes())
            keys = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            streams[".doc"].write(keys.astype("<i8").tobytes())
            n_docs += batch.num_rows
            n_tokens += sum(counts)
        if shard is not None:
            for x, stream in streams.items():
                stream.close()
                system.move(part + x, name + x)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "uri": f"{path}/{shard:05d}", "width": width, "n_docs": n_docs, "n_tokens": n_tokens}], schema=_MANIFEST)

    listed = rows.select(id_col, text_col, F.spark_partition_id().alias("shard")).mapInArrow(run, "shard int, uri string, width int, n_docs long, n_tokens long")
    listed.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


_MANIFEST = pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files.

    start counts the ids of all documents before it. ids are little-endian unsigned 32-bit integers.
    """
    shards = sorted(spark.read.parquet(f"{path}/manifest").collect())  # a row for each shard
    base = dict(zip([r.shard for r in shards], np.cumsum([0, *(r.n_tokens for r in shards)]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _mapped(row["uri"] + ".bin", f"<u{row['width']}")
                at = np.asarray(_mapped(row["uri"] + ".off", "<u8")).astype(np.int64)
                keys = np.asarray(_mapped(row["uri"] + ".doc", "<i8"))
                for first in range(0, len(keys), 2000):
                    last = min(first + 2000, len(keys))
                    parts = [np.asarray(ids[at[i] : at[i + 1]]).astype("<u4").tobytes() for i in range(first, last)]
                    some = keys[first:last]
                    out = [pa.array(some, pa.int64(), mask=some == _NO_ID), pa.array(base[row["shard"]] + at[first:last]), pa.array(at[first + 1 : last + 1] - at[first:last]), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*out, pa.array(parts, pa.binary())] if with_ids else out, names=names)

    names = [id_col, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    listed = spark.read.parquet(f"{path}/manifest").select("shard", "uri", "width").repartition(max(1, len(shards)), "shard")
    return listed.mapInArrow(run, schema)


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, **columns) -> DataFrame:
    """Write the files, into the shared folder unless a path is given, and read them back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id, **columns)
    return read_token_files(docs.sparkSession, path, id_col=columns.get("id_col", "doc_id"))
