"""Tables of a database over JDBC: reads in parts, and batches that are there once or not at all.

A batch goes to a staging table of its own, by all tasks at once. Then one transaction on the database
moves it: rows of the same keys are deleted, the staged ones are inserted, and the batch's name is noted
in the ledger `inkfall_batches`. A run that breaks off before that leaves no row in the table, and a
batch whose name is in the ledger is not written again, so a job can be repeated as a whole.

A task may commit its rows and be lost before it says so; its repetition then stages them twice. Staged
rows carry their number, so this is seen, and the batch is staged anew.

Statements are of plain SQL, with names quoted as Spark's dialect of the database quotes them. The
driver class must be on the class path of driver and executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "inkfall_batches"
ATTEMPTS = 3
#: Types of the store's columns that are compared or indexed; others are as the dialect has them. Columns
#: with a type of their own should have no nulls, which Spark sends as nulls of the dialect's type.
KEY_TYPES = {"chunk_id": "VARCHAR(64)", "job_id": "VARCHAR(64)", "strategy_name": "VARCHAR(100)", "status": "VARCHAR(32)", "run": "VARCHAR(200)"}


class Database:
    """The database behind a JDBC URL; properties are those of its driver, such as user and password."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> None:
        self.spark, self.url, self.properties = spark, url, dict(properties or {})

    def quoted(self, name: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).quoteIdentifier(name)

    @contextmanager
    def transaction(self):
        """A connection whose statements count together, or not at all if one fails."""
        jvm = self.spark._jvm
        given = jvm.java.util.Properties()
        for key, value in self.properties.items():
            if key == "driver":
                jvm.java.lang.Class.forName(value)
            else:
                given.setProperty(key, value)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, given)
        try:
            connection.setAutoCommit(False)
            yield _Statements(connection)
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def exists(self, table: str) -> bool:
        """Whether there is a table of exactly this name."""
        with self.transaction() as t:
            found = t.connection.getMetaData().getTables(None, None, table, None)  # a pattern, which its own name fits
            while found.next():
                if found.getString("TABLE_NAME") == table:
                    return True
        return False

    # Reading.

    def read(self, table: str, key: str | None = None, parts: int = 1, predicates: Sequence[str] = ()) -> DataFrame:
        """A table's rows. Filters and columns that a query takes reach the database.

        With a key (a number, date or time) parts are even ranges of it, between the least and the
        greatest value there; rows without a key are in the first. With predicates each is a part; they
        must meet every row once. Else one task reads the table.
        """
        if predicates:
            return self.spark.read.jdbc(self.url, self.quoted(table), predicates=list(predicates), properties=self.properties)
        if key is None or parts < 2:
            return self.spark.read.jdbc(self.url, self.quoted(table), properties=self.properties)
        of = self.quoted(key)
        ends = self.spark.read.jdbc(self.url, f"(SELECT min({of}) AS low, max({of}) AS high FROM {self.quoted(table)}) ends", properties=self.properties).first()
        if ends[0] is None:
            return self.spark.read.jdbc(self.url, self.quoted(table), properties=self.properties)
        low, high = (int(e) if isinstance(e, int | float) or hasattr(e, "as_tuple") else e for e in ends)
        return self.spark.read.jdbc(self.url, self.quoted(table), column=key, lowerBound=low, upperBound=high + 1 if isinstance(high, int) else high, numPartitions=parts, properties=self.properties)

    def hex_ranges(self, column: str, parts: int) -> list[str]:
        """Predicates of even ranges of a column of hex digests, the first with nulls. At most 256."""
        parts = max(1, min(parts, 256))
        cuts = [f"{i * 256 // parts:02x}" for i in range(1, parts)]
        of = self.quoted(column)
        bounds = zip([None, *cuts], [*cuts, None], strict=True)
        return [" AND ".join(p for p in (f"{of} >= '{a}'" if a else "", f"{of} < '{b}'" if b else "") if p) + (f" OR {of} IS NULL" if a is None and b else "") or "1 = 1" for a, b in bounds]

    # Writing.

    def batches(self) -> set[str]:
        """Names of the batches that are written."""
        if not self.exists(LEDGER):
            return set()
        return {r[0] for r in self.read(LEDGER).select("batch").collect()}

    def written(self, batch: str) -> bool:
        return self.exists(LEDGER) and not self.read(LEDGER).where(F.col("batch") == batch).isEmpty()

    def write(self, tables: dict[str, DataFrame], batch: str, keys: dict[str, Iterable[str]] | None = None, types: dict[str, str] | None = None, replace: bool = False, batch_rows: int = 5000) -> bool:
        """Rows of tables as one batch, all of them or none; False if the batch was there already.

        Rows with the keys of a new one are replaced; without keys rows are added. With `replace` they
        take the place of all rows. Of rows of one batch with
        the same keys, all are kept. Tables that are not there are made. Structs and arrays are not columns of
        a database: give JSON.
        """
        self._ledger()
        if self.written(batch):
            return False
        types = KEY_TYPES | (types or {})
        staged = {table: f"stage_{hashlib.sha256(f'{table}|{batch}'.encode()).hexdigest()[:24]}" for table in tables}
        try:
            for table, rows in tables.items():
                self._made(table, rows, types)
                self._stage(rows, staged[table], types, batch_rows)
            with self.transaction() as t:
                t.run(f"INSERT INTO {self.quoted(LEDGER)} ({self.quoted('batch')}) VALUES (?)", batch)
                for table, rows in tables.items():
                    target, stage = self.quoted(table), self.quoted(staged[table])
                    if replace:
                        t.run(f"DELETE FROM {target}")
                    elif own := list((keys or {}).get(table, ())):
                        same = " AND ".join(f"s.{self.quoted(k)} = {target}.{self.quoted(k)}" for k in own)
                        t.run(f"DELETE FROM {target} WHERE EXISTS (SELECT 1 FROM {stage} s WHERE {same})")
                    names = ", ".join(map(self.quoted, rows.columns))
                    t.run(f"INSERT INTO {target} ({names}) SELECT {names} FROM {stage}")
        finally:
            for stage in staged.values():
                self._drop(stage)
        return True

    def _types(self, rows: DataFrame, types: dict[str, str]) -> str:
        return ", ".join(f"`{c}` {types[c]}" for c in rows.columns if c in types)

    def _create(self, rows: DataFrame, table: str, mode: str, types: dict[str, str], batch_rows: int) -> None:
        own = self._types(rows, types)
        writer = rows.write.option("createTableColumnTypes", own) if own else rows.write
        writer.option("batchsize", batch_rows).jdbc(self.url, self.quoted(table), mode=mode, properties=self.properties)

    def _ledger(self) -> None:
        if not self.exists(LEDGER):
            with self.transaction() as t:
                t.run(f"CREATE TABLE {self.quoted(LEDGER)} ({self.quoted('batch')} VARCHAR(200) NOT NULL PRIMARY KEY)")

    def _made(self, table: str, rows: DataFrame, types: dict[str, str]) -> None:
        if not self.exists(table):
            self._create(rows.limit(0), table, "append", types, 1)

    def _stage(self, rows: DataFrame, stage: str, types: dict[str, str], batch_rows: int) -> None:
        number = "_row"
        while number in map(str.lower, rows.columns):
            number = f"_{number}"
        numbered, of = rows.withColumn(number, F.monotonically_increasing_id()), self.quoted(number)
        for _ in range(ATTEMPTS):
            self._drop(stage)
            self._create(numbered, stage, "append", types, batch_rows)
            twice = f"(SELECT count(*) AS n, count(DISTINCT {of}) AS d FROM {self.quoted(stage)}) counts"
            found = self.spark.read.jdbc(self.url, twice, properties=self.properties).first()
            if found[0] == found[1]:
                return
        raise RuntimeError(f"rows were staged twice in each of {ATTEMPTS} attempts")

    def _drop(self, table: str) -> None:
        if self.exists(table):
            with self.transaction() as t:
                t.run(f"DROP TABLE {self.quoted(table)}")


class _Statements:
    def __init__(self, connection) -> None:
        self.connection = connection

    def run(self, sql: str, *values: str) -> int:
        """Run one statement; how many rows it changed."""
        statement = self.connection.prepareStatement(sql)
        try:
            for i, value in enumerate(values, 1):
                statement.setString(i, value)
            return statement.executeUpdate()
        finally:
            statement.close()


def export_store(store, database: Database, batch: str, number: int | None = None) -> bool:
    """A snapshot's documents, jobs and chunks in place of those that are there, as one batch.

    The columns of metadata that the store keeps for its scans stay out, as the JSON has them.
    """
    number = store.last() if number is None else number
    tables = {"documents": store.documents(number), "chunk_jobs": store.chunk_jobs(number), "chunks": store.chunks(number).drop("fields")}
    types = {} if store.id_type != "string" else {"id": "VARCHAR(200)", "doc_id": "VARCHAR(200)"}
    return database.write(tables, batch, types=types, replace=True)
