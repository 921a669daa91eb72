"""Documents from files: every text format by its bytes, PDF by an extractor if one is given."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAIN = (".txt", ".md", ".markdown")


def safe_name(name: str | None) -> str:
    """The last part of an uploaded name; `upload` where nothing is left."""
    base = os.path.basename((name or "").replace("\\", "/"))
    return base if base not in ("", ".", "..") else "upload"


def save_upload(content: bytes, name: str | None, folder: str, doc_id: str) -> tuple[str, int]:
    """Write a file as `{doc_id}_{name}` into a landing folder; its path and size."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder) / f"{doc_id}_{safe_name(name)}"
    path.write_bytes(content)
    return str(path), len(content)


def extract_text(path: str, content: bytes, pdf: Callable[[bytes], list[str]] | None = None) -> str:
    """A file's text: a PDF's elements with blank lines between, else UTF-8 without the bytes that are not.

    A PDF that can't be read counts as bytes like any other file.
    """
    if path.lower().endswith(".pdf") and pdf is not None:
        try:
            return "\n\n".join(str(e) for e in pdf(content))
        except Exception:
            pass
    return content.decode("utf-8", errors="ignore")


def read_documents(spark: SparkSession, path: str, pdf: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(id, filename, file_path, file_size, content_text, created_at) of the files under a path.

    Ids are hashes of paths, so that reading again gives the same ones.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    @F.pandas_udf("string")
    def text(paths: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([extract_text(p, bytes(c), pdf) for p, c in zip(paths, contents, strict=True)], dtype=object)

    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(F.sha2("path", 256).alias("id"), name.alias("filename"), F.col("path").alias("file_path"), F.col("length").alias("file_size"), text("path", "content").alias("content_text"), F.col("modificationTime").alias("created_at"))


def get_document(docs: DataFrame, doc_id: object, id_col: str = "id") -> DataFrame:
    """The row of an id; the filter reaches the scan."""
    return docs.where(F.col(id_col) == F.lit(doc_id)).limit(1)


def upload_id(path: str) -> str:
    """The id in a landing folder's file name."""
    return re.split("_", os.path.basename(path), maxsplit=1)[0]
