import hashlib
import random
import re

from inkfall.llm import exact_dedup


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def _rows():
    random.seed(1)
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\tb", "a\xa0b", "A b", "é", "long " * 30_000, "long  " * 30_000]
    texts += ["".join(random.choices(["x", " ", "\n", "y"], k=random.randint(0, 6))) for _ in range(150)]
    rows = [(1000 - i, t, i) for i, t in enumerate(texts)] + [(7, "hot", 0)] * 2 + [(8 + i, "hot" if i % 2 else " hot".strip(), 0) for i in range(300)]
    return rows + [(None, "hot", 0), (None, "only without id", 0), (5, "same id, other text", 0), (5, "and another", 0)]


def test_groups_match_brute_force(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id int")
    by = {}
    for i, t, _ in rows:
        by.setdefault(_norm(t), []).append(i)
    for bits in (None, 1 << 16, 64):  # in a tiny filter every row is possibly repeated
        got = exact_dedup.exact_groups(docs, bits=bits).collect()
        assert len(got) == len(rows)
        kept = {}
        for r in got:
            kept.setdefault(r.text_sha256, []).append(r.kept)
        for t, ids in by.items():
            sha = hashlib.sha256(t.encode()).hexdigest()
            least = min((i for i in ids if i is not None), default=None)
            some = [r for r in got if r.text_sha256 == sha]
            assert {(r.keep_id, r.group_size) for r in some} == {(least, len(ids))} and sorted(map(str, ids)) == sorted(str(r.doc_id) for r in some)
            assert sum(r.kept for r in some) == 1 and all(r.doc_id == least for r in some if r.kept)


def test_the_way_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    rows = [(i, f"text {i % 40}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in exact_dedup.exact_groups(docs).collect() if r.kept) == list(range(40))
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == list(range(40))


def test_drop_copies(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, _sha int")
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    got = out.collect()
    by = {}
    for i, t, _ in rows:
        by.setdefault(_norm(t), []).append(i)
    assert sorted(_norm(r.text) for r in got) == sorted(by)
    for r in got:
        ids = by[_norm(r.text)]
        assert r.doc_id == min((i for i in ids if i is not None), default=None)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0 and exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_names_of_the_operator_are_free(spark):
    names = ["sha", "group", "keep", "rows", "maybe", "_slot0", "_bucket0", "_bitmap1", "_size", "c0"]
    rows = [(i, f"text {i % 4}", *[f"{n}{i}" for n in names]) for i in range(8)] + [(0, "text 0", *[f"{n}0" for n in names])]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == rows[:4]


def test_single_texts_are_not_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(60)], "doc_id long, text string")
    for room in (exact_dedup.BROADCAST_BYTES, 1 << 13):  # groups sent; a filter of the groups sent
        monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", room)
        monkeypatch.setattr(exact_dedup, "GROUP_BYTES", 1 if room > 1 << 13 else 1 << 20)
        out = exact_dedup.drop_copies(docs)
        assert sorted(r.doc_id for r in out.collect()) == list(range(40))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" in plan if room == 1 << 13 else "Union" not in plan
        if room > 1 << 13:
            assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
