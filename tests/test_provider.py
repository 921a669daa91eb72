import json
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from inkfall.operators import preview, retrieval


def _provider(folder, fails=(), seconds=0.0, told="connection reset"):
    """Counts its calls by files, and fails the first times for texts that are named."""

    def provide(texts):
        begun = time.time()
        time.sleep(seconds)
        bad = [t for t in texts if any(f in t for f in fails)]
        number = len(os.listdir(folder))
        tries = sum(json.loads(open(f"{folder}/{n}").read())["bad"] == bad for n in os.listdir(folder)) if bad else 0
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            json.dump({"n": len(texts), "bad": bad, "from": begun, "to": time.time(), "number": number}, out)
        if bad and tries < 2:
            raise OSError(told)
        return [[float(len(t)), 1.0] for t in texts]

    return provide


def _calls(folder):
    return [json.loads(open(f"{folder}/{n}").read()) for n in os.listdir(folder)]


def test_calls_are_full_go_on_together_and_rows_stay_in_order(spark, tmp_path):
    docs = spark.range(0, 150, 1, 1).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = retrieval.embed_texts(docs, "text", _provider(str(tmp_path), seconds=0.2), prefix="", in_flight=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.id, r.vector[0]) for r in rows] == [(i, float(i)) for i in range(150)]
    calls = _calls(tmp_path)
    assert sorted(c["n"] for c in calls) == [22, 32, 32, 32, 32]
    together = max(sum(c["from"] < d["to"] and d["from"] < c["to"] for d in calls) for c in calls)
    assert together > 1 and all(sum(d["from"] <= c["from"] < d["to"] for d in calls) <= 3 for c in calls)


def test_passing_errors_are_tried_again_and_others_not(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "id int, text string").coalesce(1)
    a, b, c = (str(tmp_path / n) for n in "abc")
    for folder in (a, b, c):
        os.mkdir(folder)
    assert retrieval.embed_texts(docs, "text", _provider(a, ["t35"]), wait=0.01).count() == 40
    retrieval.embed_texts(docs, "text", _provider(a, ["t35"]), wait=0.01).collect()
    assert sum("passage: t35" in x["bad"] for x in _calls(a)) >= 3
    with pytest.raises(Exception, match="已重试 1 次: 401 unauthorized"):
        retrieval.embed_texts(docs, "text", _provider(b, ["t35"], told="401 unauthorized"), wait=0.01).collect()
    with pytest.raises(Exception, match="已重试 2 次: connection reset"):
        retrieval.embed_texts(docs, "text", _provider(c, ["t35"]), wait=0.01, retries=2).collect()
    with pytest.raises(Exception, match="gave 0 vectors for"):
        retrieval.embed_texts(docs, "text", lambda texts: []).collect()


def test_bands_empty_results_and_clamped_previews(spark):
    scores = spark.createDataFrame([(0.7,), (0.69,), (0.5,), (0.3,), (0.29,), (-1.0,)], "s double")
    assert [r.b for r in scores.select(retrieval.score_band(F.col("s")).alias("b")).collect()] == ["high", "good", "good", "fair", "low", "low"]
    none = spark.createDataFrame([], "chunk_id int, doc_id int, text string, metadata string, vector array<float>")
    assert retrieval.retrieve(none, "q", retrieval.hashed_vectors(4)) == {"query": "q", "total_results": 0, "results": []}
    chunks = spark.createDataFrame([(d, i) for d, n in ((1, 5), (2, 2)) for i in range(n)], "doc_id int, chunk_index int")
    shown = lambda limit, **k: sorted((r.doc_id, r.chunk_index) for r in preview.preview_chunks(chunks, limit, **k).collect())
    assert shown(3) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]
    for limit in (0, -4, None, float("nan")):
        assert shown(limit) == shown(limit, with_total=False) == [(1, 0), (2, 0)]
    assert len(shown(99)) == len(shown(99, with_total=False)) == 7
