"""The folder that driver and executors share, and numbered files that appear there whole or not at all."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_own_base: list[str] = []
_cleaned: set[str] = set()


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


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        fs, path = _fs(spark, folder)
        fs.delete(path, True)
    except Exception:  # the JVM may be gone already; the folder is named after the application
        pass


def _fs(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def names(spark: SparkSession, folder: str) -> list[str]:
    """What is in a folder; nothing where it does not exist."""
    fs, path = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def delete(spark: SparkSession, place: str) -> None:
    fs, path = _fs(spark, place)
    fs.delete(path, True)


def modified(spark: SparkSession, place: str) -> float:
    """When a file or folder last changed, in seconds."""
    fs, path = _fs(spark, place)
    return fs.getFileStatus(path).getModificationTime() / 1000


class NumberedFiles:
    """Text files in one folder, each under a number that is given once.

    A file is written under another name and renamed, which fails where the number is taken. So of two
    writers of one number one wins whole, and a writer that dies leaves nothing that is read.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def numbers(self) -> list[int]:
        return sorted(int(m[1]) for n in names(self.spark, self.folder) if (m := re.fullmatch(r"(\d{20})\.json", n)))

    def path(self, number: int) -> str:
        return f"{self.folder}/{number:020d}.json"

    def read(self, number: int) -> str:
        fs, path = _fs(self.spark, self.path(number))
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, number: int, text: str) -> bool:
        """Whether the text now stands under the number; False if another one does."""
        jvm = self.spark._jvm
        fs, aside = _fs(self.spark, f"{self.folder}/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(text.encode())
        stream.close()
        _, place = _fs(self.spark, self.path(number))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration()) if aside.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(aside, place, options)
            return True
        except Py4JJavaError as error:
            fs.delete(aside, False)
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
