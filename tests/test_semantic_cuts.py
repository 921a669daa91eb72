"""Semantic chunks in one pass hold to those by rows of sentences."""

import math
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from inkfall.operators import retrieval, semantic, semantic_cuts
from inkfall.plans import catalogue

PIECES = ["one two", "三 四", "五。", "!", "?", ". ", ".　", "\n", " \n ", "\x1c", " x", "𝒳𝒴.", "６", "...", "a\xa0b", "﻿", "Word", " ", "\t"]
IDS = "doc_id int, text string"


def _texts(n):
    r = random.Random(7)
    return ["".join(r.choice(PIECES) for _ in range(r.choice([3, 12, 40, 90]))) for _ in range(n)] + [None, "", " \n", "a. b. c.", "a. b. c. d.", "same. " * 40]


def _vector(text):
    r = random.Random(zlib.crc32(text[:12].encode()))
    return [r.uniform(-3, 3) for _ in range(5)]


def _odd_vector(text):
    """Null, without length, shorter, with a null, or plain, by the text."""
    vector = _vector(text)
    return [None, [0.0] * 5, vector[:3], [None, *vector[1:]], [], vector, vector, vector][zlib.crc32(text.encode()) % 8]


def _chunks(df, embed, params):
    found = semantic.semantic(df, params, embed)
    return found.schema, sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("params", [{"breakpoint_threshold": 80.0}, {"breakpoint_type": "standard_deviation", "breakpoint_threshold": 0.7, "buffer_size": 2}, {"breakpoint_type": "interquartile", "breakpoint_threshold": 0.3, "buffer_size": 0}])
def test_one_pass_cuts_as_rows_of_sentences_do(spark, params):
    df = spark.createDataFrame(list(enumerate(_texts(120))), IDS).repartition(3)
    for of in (_vector, _odd_vector):
        provider = lambda texts, of=of: [of(t) for t in texts]
        schema, want = _chunks(df, lambda d, c, p=provider: retrieval.embed_texts(d, c, p), params)
        assert len(want) > 200 and any(r[2] is None for r in want)
        for in_flight in (0, 3):
            got = _chunks(df, retrieval.Embedding(provider, batch=7, in_flight=in_flight), params)
            assert [(f.name, f.dataType) for f in got[0]] == [(f.name, f.dataType) for f in schema] and got[1] == want


def test_nothing_is_shuffled(spark):
    found = catalogue.queries()["q28_semantic_documents"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(word in plan for word in ("Exchange", "Window", "Join"))


def test_each_row_is_a_document(spark):
    texts = ["a b. c d. e f. g h.", "x. y.", "p q. r s. t u. v w."]
    df = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2])], IDS).coalesce(1)
    found = semantic.semantic(df, {"buffer_size": 0, "breakpoint_threshold": 50.0}, retrieval.Embedding(retrieval.hashed_vectors(), in_flight=0)).collect()
    whole, text = [], ""
    for row in found:
        whole, text = (whole + [text], "") if row.chunk_index == 0 else (whole, text)
        text += row.text
    assert [*whole[1:], text] == texts and [r.doc_id for r in found if r.chunk_index == 0] == [1, 1, None]


def test_calls_are_full_and_short_documents_wait_for_none():
    class Docs:
        schema = T.StructType([T.StructField("doc_id", T.IntegerType()), T.StructField("text", T.StringType())])

        def mapInArrow(self, run, schema):
            return run

    def batches():
        for k in range(6):
            read.append(len(asked))
            texts = ["short."] * 9000 if k in (2, 3) else ["a. b. c. d. e. f. g."] * 10
            yield pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int32()), pa.array(texts)], ["doc_id", "text"])

    asked, read, got = [], [], []
    provider = lambda texts: asked.append(len(texts)) or [[float(len(t))] for t in texts]
    for batch in semantic_cuts.cut(Docs(), retrieval.Embedding(provider, batch=35, in_flight=0), "percentile", 95.0, 1)(batches()):
        got.append((len(read), batch.num_rows))
    assert asked == [35] * 8 and sum(n for _, n in got) == 18000 + 40
    assert [n for k, n in got if k <= 4][:4] == [4096] * 4  # given on before what comes next is read


def test_hashed_vectors_count_words():
    texts = ["Red fox　red", "", "İ x\x1cy Σας", "fox " * 50]
    want = []
    for text in texts:
        vector = [0.0] * 8
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            vector[h % 8] += 1.0 if h >> 16 & 1 else -1.0
        want.append(vector)
    provider = retrieval.hashed_vectors(8)
    assert provider(texts) == want and provider([]) == [] and provider.array(texts).tolist() == want


def test_what_is_not_a_number_is_above_all():
    nan = float("nan")
    assert semantic_cuts.breaks([0.1, nan, 0.2, None, 0.3], "percentile", 50.0) == [1, 4]
    assert semantic_cuts.breaks([0.1, nan], "standard_deviation", 1.0) == [] and semantic_cuts.breaks([None, None], "percentile", 50.0) == []
    near = semantic_cuts.Neighbours()
    assert near.of([[1.0, nan], [1.0, 1.0]])[0] is None and near.of([[1.0, 1.0]]) == pytest.approx([1.0])
    assert math.isnan(semantic_cuts.Neighbours().of([[1.0, nan], [1.0, 1.0]])[1])
