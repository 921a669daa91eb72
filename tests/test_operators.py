import json
import random
import re

import pytest
from pyspark.sql import functions as F

from inkfall.operators import html, cleaning, markdown, preview, retrieval, row_tables, score_tables, semantic, splitting
from inkfall.plans import jobs, registry


def _clean(spark, texts, **config):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r for r in cleaning.clean(df, cleaning.CleaningConfig(**config)).orderBy("doc_id").collect()]


def test_whitespace_golden(spark):
    text = "com\\u3000\\u3000\\u3000多余空格  和  …乱码     \n\n  \n 行首有多余空格的行  "
    row = _clean(spark, [text])[0]
    assert row.cleaned_text == "com 多余空格 和 …乱码\n\n行首有多余空格的行"
    assert [c.op for c in row.changes] == ["skip", "unicode_escape_decode", "whitespace_normalize"] and row.cleaned
    assert _clean(spark, ["", None, "plain"])[2].cleaned is False


def test_whitespace_matches_a_model(spark):
    random.seed(1)
    alphabet = ["a", " ", "\n", "\r", "\t", "　", "\xa0", "​", "\x1c", "\x85", "😀"]
    texts = ["".join(random.choices(alphabet, k=random.randint(1, 25))) for _ in range(1500)]

    def model(t):
        t = t.replace("\r\n", "\n").replace("\r", "\n")
        t = re.sub(r"^ +", "", re.sub(r"\n +", "\n", t))
        t = re.sub(r"\n{3,}", "\n\n", re.sub("[ \t　\xa0]+\n", "\n", t))
        t = re.sub(r" {2,}", " ", re.sub("[　\xa0 -​  ]", " ", t))
        return t.replace("\t", " ").strip()

    assert [r.cleaned_text for r in _clean(spark, texts)] == [model(t) for t in texts]


def test_cleaning_leaves_columns_of_any_name(spark):
    names = ["_text", "_new", "_changes", "_masked", "c0", "cleaned_text", "Metadata", "a.b"]
    df = spark.createDataFrame([("a  b", *[f"v{i}" for i in range(len(names))])], ", ".join(f"`{n}` string" for n in ["text", *names]))
    config = cleaning.CleaningConfig(enable_pii=True, enable_semantic_filter=True, use_presidio=True, entity_masker=lambda t: (t, 0))
    got = cleaning.clean(df, config)
    assert got.columns == ["text", *names, "cleaned_text_", "cleaned", "changes", "metadata_"]
    assert list(got.first()[:10]) == ["a  b", *[f"v{i}" for i in range(len(names))], "a b"]
    assert cleaning.cleaned_texts(df, config).collect() == [("a b", *[f"v{i}" for i in range(len(names))])]


def test_pii_golden(spark):
    text = "我叫张三，电话是13800138000，邮箱zhangsan@test.com\n备用手机：13912345678，身份证号：110101199001011234"
    texts = [text, "zhangsan@example.com", "a 张三 b 李四 c", "010-12345678", "会议 纪要"]
    got = _clean(spark, texts, enable_heuristic=False, enable_pii=True)
    assert got[0].cleaned_text == "我叫张三，电话是138****8000，邮***@test.com\n备用手机：139****5678，身份证号：110101********1234"
    assert [r.cleaned_text for r in got[1:4]] == ["z***@example.com", "a 张XX b 李XX c", "010-****5678"]
    assert got[0].metadata.total_masked == 4 and got[0].metadata.pii_types_masked == sorted(["手机号", "邮箱", "身份证号"])


def test_filter_golden(spark):
    lines = ["第 1 页 / 共 10 页", "Page 3 of 9", " 3 / 12", "免责声明：无", "Disclaimer: none", "Notice: x", "机密文件", "Confidential draft", "© 2026", "Copyright x", "www.example.com", "-----"]
    got = _clean(spark, [f"body\n{line}\ntail" for line in lines] + ["机密内容：项目计划书", "hide me\nkeep"], enable_heuristic=False, enable_semantic_filter=True, custom_filter_rules=("^hide.*$",))
    assert all(re.sub(r"\n+", "\n", r.cleaned_text) == "body\ntail" for r in got[:12])
    assert got[12].cleaned_text == "机密内容：项目计划书" and got[13].cleaned_text == "\nkeep"
    assert got[0].metadata.rules == ["页眉页脚-页码"] and got[13].changes[0].rule == "自定义规则: ^hide.*$"
    with pytest.raises(re.error):
        cleaning.line_rules(("(",))


def test_recursive_closed_form_and_positions(spark):
    text = "".join(random.choices("abcdefgh", k=1234))
    got = splitting.recursive_chunks(text, 100, 20)
    assert [(a, b) for _, a, b, *_ in got] == [(i * 80, min(i * 80 + 100, 1234)) for i in range(len(got))]
    random.seed(3)
    for _ in range(200):
        t = "".join(random.choices(["ab", " ", "\n", "\n\n", "xyzw" * 5], k=60))
        for chunk, start, end, *_ in splitting.recursive_chunks(t, 30, 8):
            assert len(chunk) <= 30 and chunk == chunk.strip() and t[start:end] == chunk
    df = spark.createDataFrame([(1, "one two three four five"), (2, None), (3, "")], "doc_id int, text string")
    rows = splitting.recursive_character(df, {"chunk_size": 9, "chunk_overlap": 4}).orderBy("doc_id", "chunk_index").collect()
    assert [(r.text, r.char_start, r.char_end) for r in rows] == [("one two", 0, 7), ("three", 8, 13), ("four", 14, 18), ("five", 19, 23)]
    with pytest.raises(ValueError):
        splitting.split_text("x", 5, 6)


def test_parent_child(spark):
    text = "".join(random.choices("abc", k=1000))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = splitting.parent_child(df, {"parent_chunk_size": 300, "child_chunk_size": 100, "child_chunk_overlap": 10}).collect()
    assert all(text[r.char_start : r.char_end] == r.text for r in rows)
    assert json.loads(rows[0].metadata)["parent_text_preview"] == text[:100] + "..."
    parents = splitting.parent_child(df, {"parent_chunk_size": 300, "return_parents_only": True}).collect()
    assert [len(r.text) for r in parents] == [300, 300, 300, 100]


def test_markdown():
    text = "# a\nx\n## b\ny\n# c\nz"
    heads = list(markdown.HEADERS)
    assert markdown.sections(text, heads, False) == [("# a\nx", {"Header 1": "a"}), ("## b\ny", {"Header 1": "a", "Header 2": "b"}), ("# c\nz", {"Header 1": "c"})]
    assert markdown.sections(text, heads, True)[1] == ("y", {"Header 1": "a", "Header 2": "b"})
    assert markdown.sections("# a\n## b\n\ntext", heads, False) == [("# a  \n## b  \ntext", {"Header 1": "a", "Header 2": "b"})]
    fenced = markdown.sections("# a\n```\n# no header\n\n```\nend", heads, False)
    assert fenced == [("# a\n```\n# no header\n\n```\nend", {"Header 1": "a"})]
    assert markdown.sections("", heads, False) == [] and markdown.sections("#no", heads, False) == [("#no", {})]


def test_semantic_and_dialogue(spark):
    docs = spark.createDataFrame([(1, "甲：你好。\n\n乙：在吗？\n\n甲：天气好。\n\n乙：是的！"), (2, "no marks here"), (3, "前言\n甲：一 \n乙：二"), (4, "")], "doc_id int, text string")
    rounds = semantic.rounds(docs).orderBy("doc_id", "i").collect()
    assert [(r.speaker, r.said) for r in rounds if r.doc_id == 1] == [("甲", "你好。"), ("乙", "在吗？"), ("甲", "天气好。"), ("乙", "是的！")]
    assert [(r.speaker, r.full_text) for r in rounds if r.doc_id == 3] == [("前言\n甲", "前言\n甲：一"), ("乙", "乙：二")]  # a mark may begin on the line before
    whole = semantic.dialogue(docs).orderBy("doc_id").collect()
    assert [r.text for r in whole if r.doc_id == 1] == [docs.first().text] and json.loads(whole[0].metadata)["exchange_count"] == 2
    assert (whole[1].text, whole[1].char_end) == ("no marks here", 13)

    def embed(df, column):
        return df.withColumn("vector", F.when(F.col(column).contains("天气"), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))))

    parts = semantic.dialogue(docs.where("doc_id = 1"), embed=embed).orderBy("chunk_index").collect()
    assert [p.text for p in parts] == ["甲：你好。\n\n乙：在吗？", "甲：天气好。\n\n乙：是的！"] and parts[1].char_start == 14
    sents = semantic.sentences(spark.createDataFrame([(1, "One.  Two! 三。四？ five")], "doc_id int, text string")).orderBy("i").collect()
    assert [(s.sentence, s.start, s.end) for s in sents] == [("One.", 0, 4), ("Two!", 6, 10), ("三。", 11, 13), ("四？", 13, 15), ("five", 16, 20)]
    text = "a. b. 天气. c. d."
    cut = semantic.semantic(spark.createDataFrame([(1, text), (2, "x. y."), (3, "")], "doc_id int, text string"), {"buffer_size": 0, "breakpoint_threshold": 60}, embed).orderBy("doc_id", "chunk_index").collect()
    assert "".join(r.text for r in cut if r.doc_id == 1) == text and [r.text for r in cut if r.doc_id == 1] == ["a. b.", " 天气.", " c. d."]
    assert [r.text for r in cut if r.doc_id > 1] == ["x. y.", ""]
    with pytest.raises(RuntimeError):
        semantic.semantic(docs)
    with pytest.raises(ValueError):
        semantic.threshold("none", 1, None)


BOREHOLE = """<table><thead><tr><th colspan="3">XX矿区ZK01钻孔地层特征</th></tr><tr><th>层位</th><th>深度(m)</th><th>岩性描述</th></tr></thead><tbody>
<tr><td>1</td><td>0-5.2</td><td>褐黄色含砾粉质粘土，可塑，含少量植物根系。</td></tr><tr><td>2</td><td>5.2-12.8</td><td>灰黄色粉砂，饱和，中密，主要成分为石英。</td></tr>
<tr><td>3</td><td>12.8-20</td><td>特征同2层</td></tr><tr><td>4</td><td>20-31</td><td>青灰色全风化花岗岩，岩芯呈砂状，手捏易碎。</td></tr><tr><td>5</td><td>31-40</td><td>同上</td></tr></tbody></table>"""


def test_html_table_golden(spark):
    got = row_tables.table_chunks(BOREHOLE, True, "primary_key_based")
    assert got[0][0] == "在XX矿区ZK01钻孔地层特征中，关于【1】的记录显示：深度(m)为0-5.2，岩性描述为褐黄色含砾粉质粘土，可塑，含少量植物根系。"
    assert "特征同2层（即（2行）：灰黄色粉砂，饱和，中密，主要成分为石英。）" in got[2][0] and "同上（即：青灰色全风化花岗岩，岩芯呈砂状，手捏易碎。）" in got[4][0]
    assert json.loads(got[3][1])["numeric_fields"] == {"层位": 4}
    odd = "<table><tr><td>a<br>b<p>c</p>d</td><td colspan=2><img src=u alt=v><img src=w></td></tr><tr><td></td><td>见1</td><td>12.5m</td></tr></table><table><tr><td colspan=x>1</td></tr></table>"
    table, = row_tables.read_tables(odd)
    assert table.headers == ["列1", "列2", "列3"] and table.cells[0] == ["a，bc d", "[图片: v(u)][图片: w]", "[图片: v(u)][图片: w]"] and table.cells[1][0] == "a，bc d"
    assert row_tables.table_chunks("no table") == []
    implied = "<table><tr><th colspan=2>信息</th></tr><tr><td>名字</td><td>地方</td></tr><tr><td>x</td><td>1e5</td></tr></table>"
    text, meta = row_tables.table_chunks(implied)[0]
    assert text == "信息中，名字为x，地方为1e5。" and json.loads(meta)["numeric_fields"] == {}
    df = spark.createDataFrame([(1, BOREHOLE), (2, None)], "doc_id int, text string")
    assert row_tables.html_table(df).count() == 5 and row_tables.table_overview(df).first().row_count == 5


def _scores(extra="", first=("研发", "进度", "按时交付", "30%", "标准甲"), score="95"):
    return f"""<table><tr><th rowspan=2>组别</th><th rowspan=2>考核项</th><th rowspan=2>考核指标</th><th rowspan=2>权重</th><th rowspan=2>考核标准</th><th colspan=2>姓名：甲</th><th colspan=2>姓名：乙</th></tr>
<tr><th>评分</th><th>评分理由</th><th>评分</th><th>评分理由</th></tr>
<tr><td rowspan=2>{first[0]}1</td><td>{first[1]}</td><td>{first[2]}</td><td>{first[3]}</td><td>{first[4]}</td><td>{score}</td><td>好</td><td>/</td><td></td></tr>
<tr><td>质量</td><td>缺陷率</td><td>30%</td><td>标准乙</td><td>88分</td><td>-</td><td>70</td><td>一般</td></tr>{extra}</table>"""


def test_score_tables(spark):
    got = score_tables.score_chunks(_scores())
    assert [t.split("\n")[0] for t, _ in got] == ["在【研发1】的绩效考核中，员工【甲】，在【进度-按时交付】上，得分为【95】分，评分理由：【好】。", "在【研发1】的绩效考核中，员工【甲】，在【质量-缺陷率】上，得分为【88分】分。", "在【研发1】的绩效考核中，员工【乙】，在【质量-缺陷率】上，得分为【70】分，评分理由：【一般】。"]
    assert got[0][0].split("\n")[1] == "（背景信息：指标权重：30%；考核标准：标准甲）" and json.loads(got[1][1])["score"] == 88.0
    by_weight = score_tables.score_chunks(_scores(), "weight_split", 2)
    assert by_weight[0][0] == "在【研发1】的绩效考核中，员工【甲】，在权重【30%】的考核指标上表现如下：\n- 进度-按时…：得分为【95】分（评分理由：好）。\n- 质量-缺陷…：得分为【88分】分。\n（背景信息：指标权重：30%；考核标准：标准…）"
    assert [json.loads(m)["indicator_count"] for _, m in by_weight] == [2, 1]
    wide = _scores("<tr>" + "<td>1</td>" * 12 + "</tr>")
    df = spark.createDataFrame([(1, _scores()), (2, wide), (3, "none")], "doc_id int, text string")
    assert sorted(r.doc_id for r in score_tables.complex_table(df).collect()) == [1, 1, 1]
    with pytest.raises(IndexError):
        score_tables.score_chunks(wide)
    flat = "<table><tr><th>考核项</th><th>评分信息</th><th>评分信息</th><th>评分信息</th><th>评分信息</th></tr><tr><td>考核项</td><td>张三</td><td>评分理由</td><td>李四</td><td>评分理由</td></tr><tr><td>进度</td><td>1</td><td>x</td><td>2</td><td>y</td></tr></table>"
    assert score_tables.score_chunks(flat) == []
    named = flat.replace("<td>张三</td><td>评分理由</td>", "<td>张三</td><td>评分</td>")
    assert [json.loads(m)["employee_name"] for _, m in score_tables.score_chunks(named)] == ["张三", "李四"]


def test_retrieval(spark):
    rows = [(f"c{i}", i, f"text {i}" * 200, json.dumps({"Header 1": f"h{i % 2}", "n": i}), [float(i % 3), 1.0]) for i in range(9)] + [("zero", 99, "z", None, [0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id int, text string, metadata string, vector array<double>")
    got = retrieval.search(chunks, [1.0, 1.0], 3).collect()
    assert [(r.chunk_id, r.score) for r in got] == [("c1", 1.0), ("c4", 1.0), ("c7", 1.0)] and len(got[0].text) == 500
    assert {r.chunk_id for r in retrieval.search(chunks, [1.0, 1.0], 100, {"Header 1": "h1"}).collect()} == {"c1", "c3", "c5", "c7"}
    assert [r.score for r in retrieval.search(chunks.where("chunk_id = 'zero'"), [1.0, 1.0]).collect()] == [0.0]
    with pytest.raises(ValueError):
        retrieval.search(chunks, [1.0], 101)
    embedded = retrieval.embed_texts(chunks.select("chunk_id", "text"), "text", retrieval.hashed_vectors(8), batch=4)
    assert all(len(r.vector) == 8 for r in embedded.collect())
    assert retrieval.test_embedding(retrieval.hashed_vectors(4))["dim"] == 4

    def down(_):
        raise OSError("connection refused")

    assert retrieval.test_embedding(down)["error"] == "connection" and retrieval.health_check(down)[0] is False


def test_preview_and_highlight(spark):
    docs = spark.createDataFrame([(1, "x" * 1000), (2, "y" * 3000)], "doc_id int, text string")
    chunks = splitting.recursive_character(docs.where("doc_id = 1"), {"chunk_size": 100, "chunk_overlap": 30})
    shown = preview.preview_chunks(chunks, 3)
    assert {r.total_chunks for r in shown.collect()} == {14} and shown.count() == 3
    parts = {r.doc_id: len(r.source_preview) for r in preview.source_preview(docs, shown).collect()}
    assert parts == {1: 440, 2: 2000}
    segs = preview.highlight(shown, docs.where("doc_id = 1")).orderBy("seg_start").collect()
    assert [(s.seg_start, s.seg_end, s.chunk_index) for s in segs] == [(0, 100, 0), (100, 170, 1), (170, 240, 2), (240, 1000, None)]


def test_jobs_and_registry(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one  two\n\nthree"), (2, "four")], "doc_id int, text string")
    done = jobs.execute(docs, "recursive_character", {"chunk_size": 8, "chunk_overlap": 0}, str(tmp_path), cleaning=cleaning.CleaningConfig()).collect()
    assert {(r.doc_id, r.total_chunks, r.status) for r in done} == {(1, 2, "completed"), (2, 1, "completed")}
    stored = jobs.stored_chunks(spark, str(tmp_path))
    assert stored.count() == 3 and stored.where("parent_id is not null").count() == 0
    jobs.execute(docs, "recursive_character", {"chunk_size": 8, "chunk_overlap": 0}, str(tmp_path), cleaning=cleaning.CleaningConfig())
    assert jobs.stored_chunks(spark, str(tmp_path)).count() == 3
    assert registry.list_strategies(spark).count() == 8
    with pytest.raises(ValueError):
        registry.chunk(docs, "nothing")
    for name in ("parent_child", "markdown_structure", "pdf_table_layout", "dialogue_aware", "html_table", "complex_table"):
        assert registry.chunk(docs, name).columns == ["doc_id", "chunk_index", "text", "metadata", "char_start", "char_end"]
    shown, source = jobs.preview(docs, "recursive_character", {"chunk_size": 8, "chunk_overlap": 0}, 1)
    assert shown.count() == 2 and source.count() == 2
    elements = spark.createDataFrame([(1, "a table text", [("a table", "table", 1, None, None), ("text", "text", 2, None, None)])], "doc_id int, text string, elements array<struct<text: string, type: string, page_number: int, parser: string, page_range: string>>")
    got = registry.chunk(elements, "pdf_table_layout").orderBy("chunk_index").collect()
    assert [(r.text, r.char_start, r.char_end) for r in got] == [("a table", 0, 7), ("text", 8, 12)] and json.loads(got[0].metadata)["element_type"] == "table"


def test_runs_stand_beside_each_other(spark, tmp_path):
    first, second = (spark.createDataFrame([r], "doc_id int, text string") for r in ((1, "one two"), (2, "three")))
    for docs in (first, second, second):
        jobs.execute(docs, "recursive_character", None, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in jobs.stored_chunks(spark, str(tmp_path)).collect()) == [(1, "one two"), (2, "three")]


def test_chunks_are_cleaned_by_all_that_is_asked_for(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    config = cleaning.CleaningConfig(enable_pii=True, use_presidio=True, encoding_fixer=lambda t: t.replace("a", "é"), entity_masker=lambda t: (t.replace("b", "*"), 1))
    assert [r.text for r in registry.chunk(docs, "recursive_character", cleaning=config).collect()] == ["é *"]
    cleaning.CLEANERS["shout"] = lambda c: F.upper(c)
    own = cleaning.CleaningConfig(custom_cleaners=("shout",))
    assert [r.text for r in registry.chunk(docs, "recursive_character", cleaning=own).collect()] == ["A B"]
    done = cleaning.clean(docs, own).first()
    assert done.cleaned_text == "A B" and done.changes[-1].op == "shout"
    del cleaning.CLEANERS["shout"]


def test_deep_html():
    deep = html.parse("<td>" + "<b>" * 5000 + "x" + "</b>" * 5000 + "<p>y</p>z</td>").first("td")
    assert html.cell_text(deep) == "xy z" and deep.same() == deep.same()


def test_search_by_text_and_without_vectors(spark):
    provider = retrieval.hashed_vectors(16)
    rows = [(1, 7, "query: red fox", '{"a": "b"}', provider(["query: red fox"])[0]), (2, 7, "other", None, provider(["blue sea"])[0]), (3, 7, "none", None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id int, doc_id int, text string, metadata string, vector array<float>")
    found = retrieval.retrieve(chunks, "red fox", provider, top_k=5)
    assert found["query"] == "red fox" and found["total_results"] == 2
    assert found["results"][0]["chunk_id"] == "1" and found["results"][0]["score"] == 1.0 and found["results"][0]["metadata"] == {"a": "b"} and found["results"][1]["metadata"] == {}
    said = ["401 x", "connection reset", "rate limit", "model m not found", "400 bad input", "odd"]
    assert [retrieval._kind_of(e) for e in said] == ["auth", "connection", "rate_limit", "not_found", "bad_request", "unknown"]
