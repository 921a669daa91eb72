import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from inkfall.llm import quality


def _clean(n):
    return " ".join("".join(random.choices(["ka", "lo", "mi", "tu", "re"], k=random.randint(1, 4))) for _ in range(n))


def _junk(n):
    return random.choice([lambda: " | ".join(_clean(n).split()), lambda: " ".join(w + "$$$" for w in _clean(n).split()), lambda: " ".join([_clean(1)] * n)])()


def _brute(text):
    """Buckets by the definition, one feature at a time, with whole numbers."""
    odd, mask = int(quality._ODD), (1 << 64) - 1

    def bucket(h, salt):
        return ((h + salt) * odd & mask) >> (64 - quality.BITS)

    def hashed(s):
        h = 0
        for k, c in enumerate(s):
            x = (ord(c) + 1) * 0xBF58476D1CE4E5B9 & mask
            h += (x ^ (x >> 31)) * pow(odd, k, 1 << 64)
        return h & mask

    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    grams = [bucket(hashed(text[i : i + n]), n) for n in range(1, quality.GRAMS + 1) for i in range(len(text) - n + 1)]
    return sorted(grams + [bucket(hashed(w), 0) for w in words] + [bucket(0, quality.GRAMS + 1) for a, b in zip(words, words[1:]) if a == b])


def test_features_against_brute_force():
    random.seed(2)
    for text in ["", " ", "a", "ab ab  ab\nç😀 ab", *("".join(random.choices("ab \n😀é", k=60)) for _ in range(40))]:
        assert sorted(np.concatenate([np.zeros(0, np.int64), *quality.features(text)]).tolist()) == _brute(text)


def test_chunks_give_the_same_features(monkeypatch):
    random.seed(3)
    text = _clean(400) + " " + "x" * 300 + " " + _clean(100)
    whole = _brute(text)
    monkeypatch.setattr(quality, "_CHUNK", 1000)
    assert len(list(quality.features(text))) > 2
    assert sorted(np.concatenate(list(quality.features(text))).tolist()) == whole


def _tables(spark, n=240, wrong=lambda i: False):
    random.seed(4)
    good = {i: int(random.random() < 0.7) for i in range(n)}
    docs = [(i, (_clean if good[i] else _junk)(random.randint(8, 60))) for i in range(n)]
    marks = [(i, 1 - g if wrong(i) else g) for i, g in good.items() if i % 5]
    return good, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")


def test_held_out_accuracy_and_no_look_at_held_out_labels(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    good, docs, marks = _tables(spark, wrong=held)  # wrong labels on all rows that must not be read
    model = quality.learn(docs, marks)
    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    some = [i for i in got if held(i)]
    assert len(some) > 40 and sum((got[i] >= 0.7) == good[i] for i in some) >= 0.95 * len(some)
    again = quality.learn(docs.repartition(7), marks.repartition(3))
    assert np.array_equal(again.table, model.table) and again.offset == model.offset


def test_the_table_is_the_softmax_of_the_mean():
    random.seed(5)
    texts, labels = [_clean(20) for _ in range(30)] + [_junk(20) for _ in range(30)], [1] * 30 + [0] * 30
    table = quality.train(texts, labels)
    model = quality.calibrated(table, texts, labels, 0.5)
    for t in texts:
        assert abs(model.output(t) - table[_brute(t)].astype(float).mean()) < 1e-9
    assert min(model.score(t) for t in texts[:30]) > max(model.score(t) for t in texts[30:])


def test_nulls_empty_tables_one_label_and_names(spark):
    _, docs, marks = _tables(spark, 60)
    odd = spark.createDataFrame([(None, "a b"), (7, None), (8, ""), (9, " "), (9, "x" * 400_000)], "doc_id long, text string")
    model = quality.learn(docs.union(odd), marks.union(spark.createDataFrame([(None, 1), (3, None), (9, 1), (9, 0)], "doc_id long, quality int")))
    more = odd.withColumn("score", F.lit(1)).withColumn("quality_score", F.lit(2)).withColumn("c0", F.lit(3))
    got = quality.score(more, model)
    assert got.columns == ["doc_id", "text", "score", "quality_score", "c0", "quality_score_"]
    rows = got.collect()
    assert len(rows) == 5 and all(0 <= r.quality_score_ <= 1 for r in rows) and rows[1].quality_score_ == rows[2].quality_score_
    assert quality.score(docs.limit(0), model).collect() == []
    none = quality.learn(docs, marks.limit(0))
    assert {r.quality_score for r in quality.score(docs, none).collect()} == {0.5}
    only = quality.learn(docs, marks.where("quality = 1"))
    assert min(r.quality_score for r in quality.score(docs, only).collect()) > 0.9


def test_one_id_in_very_many_rows_keeps_the_sample_bounded(spark):
    _, docs, marks = _tables(spark, 60)
    same = spark.range(3000).select(F.lit(11).cast("long").alias("doc_id"), F.concat(F.lit("ka "), F.col("id").cast("string")).alias("text"))
    model = quality.learn(docs.union(same), marks, sample_docs=20)
    assert len(quality.score(same, model).collect()) == 3000
