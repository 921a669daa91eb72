import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkfall.streaming import clients, log_source, logs


def _entries(first, n):
    return [{**logs.entry(f"m{i}", logs.LEVELS[i % 5], "test", step=i), "timestamp": float(i)} for i in range(first, first + n)]


def _run(stream, out, name):
    def write(batch, number):
        batch.select("seq", "message").write.mode("overwrite").parquet(f"{out}/{name}/part={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/{name}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def _got(spark, out, name):
    return [(r.seq, r.message) for r in spark.read.schema("seq long, message string").parquet(f"{out}/{name}").orderBy("seq").collect()]


def test_replay_then_live_and_no_repeats_after_a_restart(spark, tmp_path):
    log, out = f"file://{tmp_path}/log", str(tmp_path)
    assert logs.emit(spark, log, _entries(0, 7)) == 7 and logs.emit(spark, log, []) == 7 and logs.emit(spark, log, _entries(7, 5)) == 12
    _run(logs.subscribe(spark, log, replay=8), out, "a")
    assert _got(spark, out, "a") == [(i, f"m{i}") for i in range(4, 12)]
    logs.emit(spark, log, _entries(12, 3))
    logs.emit(spark, log, _entries(15, 4))
    for _ in range(2):
        _run(logs.subscribe(spark, log, replay=8), out, "a")
    assert _got(spark, out, "a") == [(i, f"m{i}") for i in range(4, 19)]
    _run(logs.subscribe(spark, log, replay=0), out, "b")
    logs.emit(spark, log, _entries(19, 1))
    _run(logs.subscribe(spark, log, replay=0), out, "b")
    assert _got(spark, out, "b") == [(19, "m19")]


def test_a_slow_reader_loses_only_the_oldest(spark, tmp_path):
    log, out = f"file://{tmp_path}/log", str(tmp_path)
    logs.emit(spark, log, _entries(0, 3))
    _run(logs.subscribe(spark, log, limit=4), out, "a")
    for k in range(3, 15, 3):
        logs.emit(spark, log, _entries(k, 3))
    _run(logs.subscribe(spark, log, limit=4), out, "a")
    assert [s for s, _ in _got(spark, out, "a")] == [0, 1, 2, 11, 12, 13, 14]
    assert log_source.trim(spark, log, 5) == 3
    _run(logs.subscribe(spark, log), out, "b")
    assert [s for s, _ in _got(spark, out, "b")] == list(range(9, 15)) and logs.emit(spark, log, _entries(15, 1)) == 16


def test_tail_reads_the_last_segments(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    assert logs.tail(spark, log).collect() == []
    for k in range(0, 20, 4):
        logs.emit(spark, log, _entries(k, 4))
    found = logs.tail(spark, log, 6)
    assert [r.seq for r in found.collect()] == list(range(14, 20)) and found.first().extra == {"step": "14"}
    assert [p.first for p in log_source._Folder(log).between(14, 20)] == [12, 16]
    with pytest.raises(ValueError):
        logs.tail(spark, log, 1001)


def test_a_table_becomes_a_log(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    rows = spark.range(1000).select(F.concat(F.lit("e"), "id").alias("id"), (1000 - F.col("id")).cast("double").alias("timestamp"), F.lit("info").alias("level"), F.col("id").cast("string").alias("message"))
    assert log_source.publish_rows(rows, log, "timestamp", "id") == 1000 and logs.emit(spark, log, _entries(0, 2)) == 1002
    found = spark.read.format("inkfall_log").load(log).orderBy("seq").collect()
    assert [r.seq for r in found] == list(range(1002)) and [r.message for r in found[:1000]] == [str(i) for i in range(999, -1, -1)] and found[5].extra is None
    assert log_source.publish_rows(rows.limit(0), f"{log}-none", "id") == 0
    with pytest.raises(ValueError):
        log_source.publish_rows(rows, log, "id")


def test_views_equal_a_batch_model_out_of_order_and_restarted(spark, tmp_path):
    random.seed(5)
    rows = [(f"c{random.choice('aab')}", float(random.randint(0, 50)), i, random.choice(logs.LEVELS), f"m{i}") for i in range(120)]
    random.shuffle(rows)
    schema = "client string, timestamp double, seq long, level string, message string"
    for k in range(4):
        some = rows[k * 30 : k * 30 + 30] + rows[:5]  # some come again
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        clients.keep_views(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", limit=20, level="warn").awaitTermination()
        seen = rows[: k * 30 + 30]
        for v in clients.newest_views(spark, f"{tmp_path}/out").collect():
            last = sorted(r[1:] for r in seen if r[0] == v.client)[-20:]
            assert v.counts == dict(Counter(r[2] for r in last))
            assert [tuple(e) for e in v.entries] == [r for r in last if r[2] == "warn"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "none") != clients._PROVIDER
    assert {r.client: r.batch for r in clients.newest_views(spark, f"{tmp_path}/out").select("client", F.col("batch")).collect()} == {"ca": 4, "cb": 4}
