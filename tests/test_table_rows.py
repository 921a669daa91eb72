import json
import random
import time

import pytest
from pyspark.sql import functions as F

from inkfall.operators.row_tables import html_table

CELLS = ["", "", "x", " y。", "同上", "如上", "同2行", "特征同 3 层", "见第1行", "参考 9 行", "见２行", "12", "-3.50", "007", "-0", "1e5", "2.5e3", "5.2 kg", "３.5米", 'q"\\', "a。", "同上。", "同0行"]
HEADS = [["id", "b"], ["名称", "b", "b"], ["h"], ["a", "b", "c", "a"], ["编 号", "深度"]]


def _table(r: random.Random) -> str:
    heads = r.choice(HEADS)
    wide = f'<tr><th colspan="{len(heads)}">标题 {r.randint(0, 9)}</th></tr>' if r.random() < 0.3 and len(heads) > 1 else ""
    top = "".join(f"<th>{h}</th>" for h in heads)
    head = r.choice([f"<thead>{wide}<tr>{top}</tr></thead>", f"{wide}<tr>{top}</tr>", "", "<thead></thead>"])
    rows = "".join("<tr>" + "".join(f"<td>{r.choice(CELLS)}</td>" for _ in range(r.choice([len(heads), len(heads), 1, len(heads) + 1]))) + "</tr>" for _ in range(r.randint(0, 6)))
    return f"<table>{head}{rows}</table>"


def _rows(df, params, native):
    out = html_table(df, params, native=native)
    return out.columns, sorted((r.doc_id, r.chunk_index, r.text, r["a b"], json.loads(r.metadata), list(json.loads(r.metadata)["raw_data"])) for r in out.collect())


@pytest.mark.parametrize("params", [{}, {"template_style": "primary_key_based", "skip_empty_rows": False}, {"enable_reference_resolution": False}])
def test_expressions_tell_what_the_definition_does(spark, params):
    r = random.Random(len(params))
    texts = ["".join(_table(r) for _ in range(r.randint(0, 3))) for _ in range(300)] + [None, "", "no table", "<table></table>"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id int, text string, `a b` int").repartition(4)
    got, want = _rows(df, params, True), _rows(df, params, False)
    assert got[0] == want[0] and len(got[1]) == len(want[1]) > 300
    for a, b in zip(*(x[1] for x in (got, want)), strict=True):
        assert a == b


def test_a_long_table(spark):
    body = "".join(f"<tr><td>{i if i % 3 else ''}</td><td>{'同上' if i % 500 == 2 else i}</td></tr>" for i in range(3000))
    df = spark.createDataFrame([(1, f"<table><tr><th>id</th><th>b</th></tr>{body}</table>", 7)], "doc_id int, text string, `a b` int")
    assert _rows(df, {}, True) == _rows(df, {}, False)


def _referring(n: int) -> str:
    body = "".join(f"<tr><td>{i}</td><td>{('x', '同上', f'同{i - 1}行', f'见第{i + 2}行')[i % 4]}</td></tr>" for i in range(n))
    return f"<table><tr><th>id</th><th>b</th></tr>{body}</table>"


def test_references_take_time_in_proportion_to_the_rows(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, _referring(n))], "doc_id int, text string")
        began = time.perf_counter()
        found = html_table(df).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("chunk_index").alias("last")).first()
        assert (found.n, found.last) == (n, n - 1) and found.chars > 20 * n
        return time.perf_counter() - began

    seconds(2000)
    short = min(seconds(2000) for _ in range(3))
    assert seconds(32000) < 48 * short  # 16 times the rows; 256 times the pairs of them


def test_numbers_of_rows_of_any_length_and_script(spark):
    far = "9" * 5000
    rows = "".join(f"<tr><td>{i}</td><td>{v}</td></tr>" for i, v in enumerate(["x", f"同{far}行", "见第٢行", "同" + "0" * 5000 + "1行"]))
    df = spark.createDataFrame([(1, f"<table><tr><th>id</th><th>b</th></tr>{rows}</table>", 7)], "doc_id int, text string, `a b` int")
    got = _rows(df, {}, True)
    assert got == _rows(df, {}, False)
    told = [json.loads(json.dumps(r[4]["raw_data"]["b"])) for r in got[1]]
    assert told[1] == f"同{far}行" and told[2] == f"见第٢行（参考1行：同{far}行）" and told[3].endswith("1行（即（0行）：x）")


def test_columns_named_like_those_on_the_way(spark):
    df = spark.createDataFrame([(1, _referring(3) * 2, 7, "k")], "doc_id int, text string, _t_rows int, _T string")
    out = html_table(df)
    assert out.columns == ["doc_id", "_t_rows", "_T", "chunk_index", "text", "metadata", "char_start", "char_end"]
    assert [(r.chunk_index, r._t_rows, r._T, json.loads(r.metadata)["table_index"], json.loads(r.metadata)["row_index"]) for r in out.collect()] == [(i, 7, "k", i // 3, i % 3) for i in range(6)]
