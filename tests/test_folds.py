import random

import pytest

from inkfall.operators import folds, splitting

POOLS = [["a", " "], ["ab", " ", "\n", "\n\n", "xyzw" * 5, "日本😀", " 　"], ["word", "x" * 40, "\n\n", " "], ["aa", "a", "\n\n", "  "]]


@pytest.mark.parametrize("size,overlap", [(30, 8), (10, 9), (12, 0), (40, 40)])
def test_folds_split_as_the_definition_does(spark, size, overlap):
    random.seed(size)
    texts = ["".join(random.choices(random.choice(POOLS), k=random.randint(0, 100))) for _ in range(250)] + [None, "", " \n ", "it's \\ 'x'" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [tuple(c) for c in r.c] for r in df.select("i", folds.recursive("t", size, overlap, splitting.SEPARATORS).alias("c")).collect()}
    assert [got[i] for i in range(len(texts))] == [[c[:3] for c in splitting.recursive_chunks(t or "", size, overlap)] for t in texts]


def test_native_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, "one two three four five", 9), (2, None, 8)], "doc_id int, text string, `a b` int")
    params = {"chunk_size": 9, "chunk_overlap": 4}
    want = splitting.recursive_character(df, params)
    got = splitting.recursive_character(df, params, native=True)
    assert got.columns == want.columns and got.collect() == want.collect()
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
