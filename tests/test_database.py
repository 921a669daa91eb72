import uuid

import pytest
from pyspark.sql import functions as F

from inkfall.plans import jobs
from inkfall.plans.store import Store
from inkfall.sources.database import Database, export_store


@pytest.fixture
def database(spark):
    return Database(spark, f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _stages(database):
    with database.transaction() as t:
        found, names = t.connection.getMetaData().getTables(None, None, "stage%", None), []
        while found.next():
            names.append(found.getString("TABLE_NAME"))
    return names


def test_the_store_goes_there_and_back(spark, database, tmp_path):
    store = Store(spark, str(tmp_path / "store"), "bigint")
    docs = spark.createDataFrame([(i, "word " * (60 * i), f"f{i}.txt") for i in range(6)] + [(9, None, None)], "doc_id long, text string, filename string")
    store.add_documents(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content_text"), "filename"))
    jobs.execute(docs, "recursive_character", {"chunk_size": 100}, store.root)
    assert export_store(store, database, "one")
    want = {"documents": store.documents(), "chunk_jobs": store.chunk_jobs(), "chunks": store.chunks().drop("fields")}
    for table, rows in want.items():
        assert _rows(database.read(table).select(rows.columns)) == _rows(rows)
    parts = database.read("chunks", predicates=database.hex_ranges("chunk_id", 5)).select(want["chunks"].columns)
    assert parts.rdd.getNumPartitions() == 5 and _rows(parts) == _rows(want["chunks"])
    # A later snapshot, where one job has fewer chunks and one none, takes the place of the first.
    jobs.execute(docs.where("doc_id > 3").withColumn("text", F.when(F.col("doc_id") == 4, "short")), "recursive_character", {"chunk_size": 100}, store.root)
    store.delete_documents(docs.where("doc_id = 1"), "doc_id")
    assert not export_store(store, database, "one") and export_store(store, database, "two")
    assert _rows(database.read("chunks").select("chunk_id", "text")) == _rows(store.chunks().select("chunk_id", "text"))
    assert _rows(database.read("documents").select("id")) == _rows(store.documents().select("id"))
    assert _rows(database.read("chunk_jobs").select("doc_id", "total_chunks")) == _rows(store.chunk_jobs().select("doc_id", "total_chunks"))
    assert database.batches() == {"one", "two"} and _stages(database) == []


def test_a_failed_write_leaves_no_rows(spark, database):
    good = spark.range(100).withColumn("v", F.lit("x")).repartition(4)
    bad = good.withColumn("v", F.when(F.col("id") < 90, "x").otherwise(F.raise_error(F.lit("broken off"))))
    for tables in ({"a": good, "b": bad}, {"a": bad}):
        with pytest.raises(Exception, match="broken off"):
            database.write(tables, "first")
    assert database.read("a").count() == 0 and database.batches() == set() and _stages(database) == []
    assert database.write({"a": good, "b": good}, "first") and database.read("a").count() == 100
    # The move fails as a whole too: a key that is there already.
    with database.transaction() as t:
        t.run('CREATE TABLE "u" ("id" BIGINT PRIMARY KEY, "v" VARCHAR(9))')
        t.run('INSERT INTO "u" VALUES (7, \'old\')')
    with pytest.raises(Exception):
        database.write({"a": good, "u": good}, "second", types={"v": "VARCHAR(9)"})
    assert database.read("a").count() == 100 and _rows(database.read("u")) == [(7, "old")] and database.batches() == {"first"}
    assert database.write({"u": good}, "second", {"u": ["id"]}, {"v": "VARCHAR(9)"}) and database.read("u").count() == 100


def test_rows_staged_twice_are_seen(spark, database, monkeypatch):
    made, times = Database._create, []

    def twice(self, rows, table, mode, types, batch_rows):
        made(self, rows, table, mode, types, batch_rows)
        if table.startswith("stage") and not times:  # as a task does whose answer is lost
            times.append(1)
            made(self, rows.where("id < 10"), table, "append", types, batch_rows)

    monkeypatch.setattr(Database, "_create", twice)
    assert database.write({"a": spark.range(40)}, "x") and times
    assert _rows(database.read("a")) == [(i,) for i in sorted(range(40), key=lambda i: str((i,)))]


def test_reads_in_parts(spark, database):
    rows = spark.createDataFrame([(i if i % 9 else None, f"t{i}", None) for i in range(200)], "k long, t string, `odd name` double")
    database.write({"Some Table": rows}, "x", types={"t": "VARCHAR(20)"})
    read = database.read("Some Table", "k", 4)
    assert read.rdd.getNumPartitions() == 4 and _rows(read) == _rows(rows)
    plan = read.where("t = 't5'").select("k")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(t,t5)" in plan and "odd name" not in plan
    database.write({"empty": rows.where("false")}, "y")
    assert database.read("empty", "k", 4).count() == 0 and not database.exists("SomeXTable")
