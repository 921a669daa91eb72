import json
import threading

import pytest
from pyspark.sql import functions as F

from inkfall.operators.cleaning import CleaningConfig
from inkfall.plans import jobs, store
from inkfall.plans.store import Store
from inkfall.sources import shared

P = {"chunk_size": 8, "chunk_overlap": 0}


def _docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def _texts(rows):
    return sorted((r.doc_id, r.text) for r in rows.collect())


def test_the_last_commit_wins_whatever_its_run_is_called(spark, tmp_path):
    out = str(tmp_path)
    jobs.execute(_docs(spark, (1, "old text")), "recursive_character", P, out, run="z")
    jobs.execute(_docs(spark, (1, "new text"), (2, "two")), "recursive_character", P, out, run="backfill")
    assert _texts(jobs.stored_chunks(spark, out)) == [(1, "new text"), (2, "two")]
    done = jobs.execute(_docs(spark, (1, ""), (3, None)), "recursive_character", P, out, run="a")
    assert sorted((r.doc_id, r.total_chunks, r.number) for r in done.collect()) == [(1, 0, 3), (3, 0, 3)]
    assert _texts(jobs.stored_chunks(spark, out)) == [(2, "two")]
    told = {r.doc_id: (r.total_chunks, r.number, r.run, r.status) for r in Store(spark, out).chunk_jobs().collect()}
    assert told == {1: (0, 3, "a", "completed"), 2: (1, 2, "backfill", "completed"), 3: (0, 3, "a", "completed")}
    assert _texts(Store(spark, out).chunks(1)) == [(1, "old text")] and Store(spark, out).chunks(0).count() == 0


def test_another_cleaning_or_strategy_is_another_job(spark, tmp_path):
    out, docs = str(tmp_path), _docs(spark, (1, "a  b"))
    for cleaning in (None, CleaningConfig(), CleaningConfig(enable_pii=True), CleaningConfig()):
        jobs.execute(docs, "recursive_character", P, out, cleaning=cleaning)
    jobs.execute(docs, "parent_child", None, out)
    found = Store(spark, out)
    assert found.chunk_jobs().count() == 4 and _texts(found.chunks()) == [(1, "a  b"), (1, "a  b"), (1, "a b"), (1, "a b")]
    assert _texts(found.chunks(strategy="parent_child")) == [(1, "a  b")]
    assert json.loads(found.chunk_jobs().where("cleaning like '%\"enable_pii\": true%'").first().cleaning)["enable_heuristic"] is True


def test_a_run_that_breaks_off_leaves_the_snapshot(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    jobs.execute(_docs(spark, (1, "old")), "recursive_character", P, out)
    before = Store.write

    def fails(self, table, rows, name=None):
        if table == "chunk_jobs":
            raise OSError("gone")
        return before(self, table, rows, name)

    monkeypatch.setattr(Store, "write", fails)
    with pytest.raises(OSError):
        jobs.execute(_docs(spark, (1, "new")), "recursive_character", P, out)
    monkeypatch.setattr(Store, "write", before)
    assert _texts(jobs.stored_chunks(spark, out)) == [(1, "old")]
    assert Store(spark, out).vacuum() == [] and len(Store(spark, out).vacuum(-60)) == 1
    assert _texts(jobs.stored_chunks(spark, out)) == [(1, "old")]


def test_documents_versions_and_tombstones(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(list(r), "id string, filename string, content_text string")
    assert s.documents().count() == 0 and s.chunk_jobs().count() == 0 and s.last() == 0
    s.add_documents(rows(("a", "a.txt", "one"), ("b", "b.txt", "two")))
    s.add_documents(rows(("a", "a.txt", "three")))
    jobs.execute(s.documents(), "recursive_character", P, s.root, id_col="id", text_col="content_text")
    assert {r.id: r.content_text for r in s.documents().collect()} == {"a": "three", "b": "two"}
    s.delete_documents(spark.createDataFrame([("b",), (None,), ("none",)], "id string"))
    assert [r.id for r in s.documents().collect()] == ["a"] and _texts(s.chunks()) == [("a", "three")] and s.chunk_jobs().count() == 1
    s.add_documents(rows(("b", "b.txt", "again")))
    assert {r.id: r.content_text for r in s.documents().collect()} == {"a": "three", "b": "again"} and s.chunk_jobs().count() == 1
    assert {r.id: r.content_text for r in s.documents(1).collect()} == {"a": "one", "b": "two"}


def test_compaction_states_and_conflicts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "CHECKPOINT", 3)
    s = Store(spark, str(tmp_path))
    for i in range(4):
        jobs.execute(_docs(spark, (i % 2, f"text {i}")), "recursive_character", P, s.root)
    assert s.states.numbers() == [3] and len(s.history()) == 4
    s.delete_documents(spark.createDataFrame([("0",)], "id string"))
    want = _texts(s.chunks())
    assert want == [(1, "text 3")]
    number = s.compact()
    assert number == 6 and len(s.history()) == 1 and _texts(s.chunks()) == want and s.chunk_jobs().count() == 1
    assert [r.doc_id for r in s.chunk_jobs(4).orderBy("doc_id").collect()] == [0, 1]
    s.vacuum(-60)
    assert _texts(s.chunks()) == want
    assert s.log.publish(9, "{}") and not s.log.publish(9, "other") and s.log.read(9) == "{}"
    with pytest.raises(store.Conflict):
        s.publish("x", ["chunks"], "late", base=5)


def test_two_writers_at_once_both_stand(spark, tmp_path):
    out = str(tmp_path)
    runs = [threading.Thread(target=jobs.execute, args=(_docs(spark, (i, f"n {i}")), "recursive_character", P, out)) for i in range(3)]
    for t in runs:
        t.start()
    for t in runs:
        t.join()
    assert Store(spark, out).last() == 3 and _texts(jobs.stored_chunks(spark, out)) == [(0, "n 0"), (1, "n 1"), (2, "n 2")]


def test_filters_on_stored_metadata_reach_the_scan(spark, tmp_path):
    out = str(tmp_path)
    docs = _docs(spark, (1, "# one\na\n## two\nb"), (2, "# one\nc"), (3, "no header"))
    jobs.execute(docs, "markdown_structure", None, out)
    s = Store(spark, out)
    assert _texts(s.chunks(filters={"Header 1": "one"})) == [(1, "# one\na"), (1, "## two\nb"), (2, "# one\nc")]
    assert [r.doc_id for r in s.chunks(filters={"Header 1": "one", "Header 2": "two"}).collect()] == [1]
    assert s.chunks(filters={"strip_headers": "false"}).count() == 4 and s.chunks(filters={"strip_headers": False}).count() == 0
    assert s.chunks(filters={"unheard": "x"}).count() == 0 and s.chunks(filters={"Header 3": None}).count() == 0
    plan = s.chunks(filters={"Header 1": "one"})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(fields.`Header 1`,one)" in plan.replace("fields.Header 1", "fields.`Header 1`")
    values = spark.createDataFrame([('{"page_number": 3, "score": 4.5, "type": null}',), ('{"page_number": "3"}',), (None,), ("no json",)], "metadata string").withColumn("fields", store.fields_of(F.col("metadata")))
    assert values.where(store.metadata_equals({"page_number": 3})).count() == 2 and values.where(store.metadata_equals({"score": 4.5})).count() == 1
    assert values.where(store.metadata_equals({"type": "null"})).count() == 0


def test_scratch_is_shared_or_local(spark):
    assert shared.scratch_path(spark, "x") != shared.scratch_path(spark, "x") and shared.names(spark, "/no/such/folder") == []
