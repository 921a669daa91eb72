import random

import pytest

from inkfall.operators.headings import markdown_sections
from inkfall.operators.markdown import markdown_structure

LINES = ["# a", "## b", "### c", "#### d e", "#", "##", "#no", "", "", "x", "y  z", "  # far ", "```", "```py", "``` a ```", "~~~", "x", "é 日本😀", 'q " \\ q', "​", "a​b", "　# w\xa0v", "##### five", "a", "#\tt", " ​ "]


def _rows(df, native, **params):
    out = markdown_structure(df, params, native=native)
    if native:
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    return out.columns, sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("strip", [False, True])
def test_folds_give_the_sections_of_the_definition(spark, strip):
    random.seed(strip)
    texts = ["\n".join(random.choices(LINES, k=random.randint(0, 30))) for _ in range(400)]
    texts += [None, "", " \n ", "# foo bar\nfoo", "# a\n# b\n\n\n", "a\n\nb\n# h\na  \nb", "it's \\ 'x'\n# it's"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id int, text string, `a b` int").repartition(4)
    assert _rows(df, True, strip_headers=strip) == _rows(df, False, strip_headers=strip)


def test_long_texts_and_headers_of_ones_own(spark):
    long = "\n".join(f"{'#' * (i % 5 + 1)} title {i}\n\nbody {i}  of\n\nmore" for i in range(700))
    df = spark.createDataFrame([(1, long), (2, "line\n" * 3000), (3, "## x\n!! y\ntext\n## z\nlast")], "doc_id int, text string")
    heads = [("##", "Part"), ("!!", "Note")]
    assert _rows(df, True) == _rows(df, False)
    assert _rows(df, True, headers=heads) == _rows(df, False, headers=heads)
    one_name = {"headers": [("#", "a"), ("##", "a")]}
    assert markdown_structure(df, one_name).collect() == markdown_structure(df, one_name, native=False).collect()
    with pytest.raises(ValueError):
        markdown_sections("text", one_name["headers"], False)


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert _rows(df, True)[1] == []
