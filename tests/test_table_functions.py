import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from inkfall.plans import registry, table_functions


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(8)
    words = ["alpha", "be", "x" * 30, "\n", "\n\n", "# head\n", "## sub\n", "甲：", "\nuser: ", "日本語。", "😀", "a\tb", '"q" \\ /']
    texts = [" ".join(random.choices(words, k=random.randint(1, 120))) for _ in range(40)]
    texts += [None, "", "   ", "user: a\n\nbot: b\n\nuser: c", "<table><tr><th>ID</th><th>n</th></tr><tr><td>1</td><td>x</td></tr><tr><td>2</td><td>同上</td></tr></table>"]
    table = spark.createDataFrame([(i, t, i * 0.5) for i, t in enumerate(texts)], "doc_id long, text string, weight double")
    table.createOrReplaceTempView("texts_for_functions")
    table_functions.register(spark)
    return table


CASES = [
    ("recursive_character", {}), ("recursive_character", {"chunk_size": 60, "chunk_overlap": 20}), ("parent_child", {"parent_chunk_size": 200, "child_chunk_size": 50, "child_chunk_overlap": 10}), ("parent_child", {"return_parents_only": True}),
    ("markdown_structure", {}), ("markdown_structure", {"strip_headers": True}), ("pdf_table_layout", {"chunk_size": 100}), ("dialogue_aware", {"exchange_size": 3}), ("html_table", {}), ("html_table", {"template_style": "primary_key_based"}), ("complex_table", {}),
]


@pytest.mark.parametrize("name,params", CASES)
def test_rows_are_those_of_the_dataframe_form(spark, docs, name, params):
    told = "".join(f", {k} => {str(v).lower() if isinstance(v, bool) else repr(v)}" for k, v in params.items())
    got = spark.sql(f"SELECT * FROM {name}(TABLE(texts_for_functions){told})")
    assert got.columns == ["doc_id", "weight", "chunk_index", "text", "metadata", "char_start", "char_end"]
    whole = docs.withColumn("text", F.coalesce("text", F.lit("")))
    want = registry.chunk(whole, name, params).select("doc_id", "chunk_index", "text", "metadata", "char_start", "char_end")
    assert sorted(map(tuple, got.drop("weight").collect())) == sorted(map(tuple, want.collect()))


def test_inside_a_larger_query(spark, docs):
    got = spark.sql("SELECT doc_id, count(*) AS n FROM recursive_character(TABLE(SELECT doc_id, upper(text) AS body FROM texts_for_functions WHERE doc_id < 5), text_col => 'body', chunk_size => 100, chunk_overlap => 0) WHERE char_end > 0 GROUP BY doc_id")
    want = registry.chunk(docs.where("doc_id < 5"), "recursive_character", {"chunk_size": 100, "chunk_overlap": 0}).groupBy("doc_id").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("call,message", [
    ("recursive_character(TABLE(texts_for_functions), chunk => 4)", "unknown parameters"), ("recursive_character(TABLE(texts_for_functions), text_col => 'no')", "no column no"), ("recursive_character(1)", "must be a table"),
    ("recursive_character(TABLE(SELECT text, 1 AS char_start FROM texts_for_functions))", "columns that the result has too"),
])
def test_wrong_calls_are_found_when_analysed(spark, docs, call, message):
    with pytest.raises(AnalysisException, match=message):
        spark.sql(f"SELECT * FROM {call}").schema


def test_a_function_of_ones_own(spark, docs):
    def words(text, params):
        for i, w in enumerate(text.split()[: params["most"]]):
            yield w, "{}", i, i + 1

    spark.udtf.register("first_words", table_functions.table_function(words, {"most": 2}))
    got = spark.sql("SELECT text FROM first_words(TABLE(SELECT 'a b c' AS text), most => 1)").collect()
    assert [r.text for r in got] == ["a"]
