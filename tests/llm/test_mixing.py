import hashlib
import random

from inkfall.llm import mixing


def test_every_block_keeps_its_window_and_its_share():
    random.seed(1)
    for _ in range(60):
        weights = [random.randint(1, 40) for _ in range(random.randint(1, 9))]
        total, slots = sum(weights), mixing.period(weights)
        assert sorted(s for some in slots for s in some) == list(range(total))
        for w, some in zip(weights, slots):
            for j, slot in enumerate(some):
                assert j * total // w <= slot < -(-(j + 1) * total // w)
            for t in range(total + 1):
                assert abs(sum(s < t for s in some) - t * w / total) < 1


def test_schedule(spark):
    random.seed(2)
    sources = ["a"] * 700 + ["b"] * 150 + ["c"] * 90 + [None] * 4 + ["new"] * 3
    rows = [(i, s, "keep") for i, s in enumerate(sources)] + [(5, "a", "again"), (None, "b", "no id")]
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, rank string")
    weights = {"a": 5, "b": 3, "c": 2, "absent": 9}
    out = mixing.schedule(docs, weights, other=1, block_docs=4).collect()
    assert len(out) == len(rows) and len({r._position for r in out}) == len(out)
    group = lambda s: s if s in weights else None
    parts = {"a": 5, "b": 3, "c": 2, None: 1}
    order = {}
    for i, s, _ in rows:
        order.setdefault(group(s), []).append((i is not None, hashlib.md5(str(i).encode()).hexdigest() if i is not None else "", i or 0))
    where = {g: sorted(v) for g, v in order.items()}
    for r in out:
        w = parts[group(r.source)]
        assert r._release == r._block * 11 // w and r._deadline == -(-(r._block + 1) * 11 // w) and r._release <= r._slot < r._deadline
        if r.doc_id not in (5, None):
            assert r._block == where[group(r.source)].index((True, hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id)) // 4
    mixed = [r for r in out if r._in_mix]
    horizon = max(r._slot for r in mixed) + 1
    for t in range(1, horizon + 1):
        for g in ("a", "b", "c"):
            n = len([r for r in mixed if group(r.source) == g and r._slot < t]) / 4
            assert abs(n - t * parts[g] / 11) < 1
    stored = mixing.mix(docs, weights, other=1, block_docs=4)
    assert stored.columns == docs.columns
    want = [(r.doc_id, r.source) for r in sorted(mixed, key=lambda r: r._position)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.source)) for r in stored.collect())


def test_empty_table_and_no_weights(spark):
    docs = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mix(docs, {"a": 1}).count() == 0
    some = spark.createDataFrame([(i, "x") for i in range(20)], "doc_id long, source string")
    assert mixing.schedule(some, {"a": 1}, block_docs=4).where("_in_mix").count() == 20


def test_the_whole_goes_on_past_short_sources(spark):
    random.seed(3)
    sizes = {"a": 700, "b": 150, "c": 3, "new": 50, None: 4}
    sources = [s for s, n in sizes.items() for _ in range(n)]
    random.shuffle(sources)
    docs = spark.createDataFrame(list(enumerate(sources)), "doc_id long, source string")
    weights = {"a": 5, "b": 3, "c": 2, "absent": 9}
    mixed = mixing.mix(docs, weights, other=1, block_docs=4, whole=True)
    assert mixed.columns == docs.columns and sorted(r.doc_id for r in mixed.collect()) == list(range(len(sources)))
    placed = mixing.schedule(docs, weights, other=1, block_docs=4, whole=True).orderBy("_position").collect()
    assert all(r._in_mix for r in placed) and len({r._position for r in placed}) == len(placed)
    group = lambda s: s if s in weights else None
    parts, left, want = {"a": 5, "b": 3, "c": 2, None: 1}, {"a": 175, "b": 38, "c": 1, None: 14}, []
    while any(left.values()):
        live, done, t = [g for g in parts if left[g]], dict.fromkeys(parts, 0), 0
        total = sum(parts[g] for g in live)
        while True:  # earliest deadline first, until the next in turn has no more blocks
            g = min((g for g in live if done[g] * total // parts[g] <= t), key=lambda g: (-(-(done[g] + 1) * total // parts[g]), live.index(g)))
            if not left[g]:
                break
            want.append(g)
            done[g], left[g], t = done[g] + 1, left[g] - 1, t + 1
            assert all(abs(done[x] - t * parts[x] / total) < 1 for x in live)
    blocks = sorted({(r._position // 4, group(r.source)) for r in placed}, key=lambda b: b[0])
    assert blocks == list(enumerate(want))


def test_names_of_the_operator_are_free(spark):
    names = ["_hash", "_group", "_piece", "_own", "_rank", "_position", "position", "in_mix", "c0", "_g"]
    rows = [(i, "ab"[i % 2], *[f"{n}{i}" for n in names]) for i in range(40)]
    docs = spark.createDataFrame(rows, ["doc_id", "source", *names])
    mixed = mixing.mix(docs, {"a": 2}, block_docs=4, whole=True)
    assert mixed.columns == docs.columns and sorted(map(tuple, mixed.collect())) == rows


def test_order_is_read_from_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", "ab"[i % 3 % 2], "own") for i in range(500)], "doc_id long, part string, source string, _metadata string")
    want = [r.doc_id for r in mixing.schedule(docs, {"a": 1, "b": 3}, block_docs=2, whole=True).orderBy("_position").collect()]
    mixing.mix(docs, {"a": 1, "b": 3}, block_docs=2, whole=True).write.option("maxRecordsPerFile", 60).parquet(f"{tmp_path}/a")
    stored = spark.read.parquet(f"{tmp_path}/a")
    rows = mixing.in_order(stored).collect()
    assert len(stored.inputFiles()) > 8 and rows[0].asDict().keys() == {"doc_id", "part", "source", "_metadata", "_position"}
    assert [(r._position, r.doc_id, r._metadata) for r in sorted(rows, key=lambda r: r._position)] == [(k, i, "own") for k, i in enumerate(want)]
    rows = mixing.in_order(mixing.mix(docs, {"a": 1, "b": 3}, block_docs=2, whole=True)).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r._position)] == want
    stored.where("doc_id < 100").write.parquet(f"{tmp_path}/b/k=1")
    stored.where("doc_id >= 100").write.parquet(f"{tmp_path}/b/k=2")
    rows = mixing.in_order(spark.read.parquet(f"{tmp_path}/b")).collect()
    assert sorted(r._position for r in rows) == list(range(500)) and {r.doc_id for r in rows} == set(range(500))
