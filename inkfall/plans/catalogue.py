"""Every query of the library with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfall.operators import cleaning, preview, retrieval, row_tables, score_tables, semantic, splitting
from inkfall.operators.markdown import markdown_structure
from inkfall.plans import jobs, registry
from inkfall.plans.splitting_sql import splitting_sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        _QUERIES[run.__name__] = run
        if sql:
            _SQL[run.__name__] = sql
        return run

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk statistics by language of cleaned documents."""
    docs = _t(spark, sf_dir, "documents")
    text = cleaning.mask_pii(cleaning.normalise_whitespace(F.col("text")))
    chunks = splitting.recursive_character(docs.select("doc_id", "lang", text.alias("text")))
    return chunks.groupBy("lang").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg(F.length("text")), 2).alias("mean_chars"))


@_query()
def q00_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


@_query(r"""
WITH t AS (SELECT doc_id, replace(replace(text, ' the ', '  the ' || chr(9)), '. ', '.' || chr(160) || chr(10) || ' ') || ' ' AS x FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n +', chr(10), 'g'), '\A +', '') AS x FROM t),
b AS (SELECT doc_id, regexp_replace(regexp_replace(x, '[ \t\x{3000}\x{a0}]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS x FROM a),
c AS (SELECT doc_id, replace(regexp_replace(regexp_replace(x, '[\x{3000}\x{a0}\x{2000}-\x{200b}\x{202f}\x{205f}]', ' ', 'g'), ' {2,}', ' ', 'g'), chr(9), ' ') AS x FROM b)
SELECT doc_id, regexp_replace(x, '\A[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{3000}]+|[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{3000}]+\z', '', 'g') AS cleaned_text FROM c
""")
def q01_clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.expr(r"concat(replace(replace(text, ' the ', concat('  the ', char(9))), '. ', concat('.', char(160), char(10), ' ')), ' ')")
    docs = _t(spark, sf_dir, "documents").select("doc_id", spaced.alias("text"))
    return cleaning.clean(docs).select("doc_id", "cleaned_text")


@_query(r"""
SELECT doc_id, regexp_replace(text, '([\p{L}\p{N}_.-])[\p{L}\p{N}_.-]*@([\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]{2,4})\b', '\1***@\2', 'g') AS masked
FROM documents
""")
def q02_mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pattern, kept = cleaning.PII_RULES[2]
    return _t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", pattern, kept).alias("masked"))


@_query("""
WITH k AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS n FROM customer)
SELECT c_custkey, 'tel ' || '13' || substr(n, 1, 1) || '****' || substr(n, 6, 4) || ' or 010-****' || substr(n, 6, 4) || ', id 110101********' || substr(n, 7, 3) || 'X end' AS masked, 3 AS n_masked FROM k
""")
def q03_mask_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    text = F.concat(F.lit("tel 13"), n, F.lit(" or 010-"), F.substring(n, 2, 8), F.lit(", id 11010119"), n, F.lit("X end"))
    docs = _t(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    out = cleaning.clean(docs, cleaning.CleaningConfig(enable_heuristic=False, enable_pii=True))
    return out.select("c_custkey", F.col("cleaned_text").alias("masked"), F.col("metadata.total_masked").alias("n_masked"))


@_query("""
SELECT c_custkey, '客户 ' || CASE c_custkey % 3 WHEN 0 THEN '张' WHEN 1 THEN '李' ELSE '欧' END || 'XX 编号' || c_custkey AS masked FROM customer
""")
def q04_mask_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("CASE c_custkey % 3 WHEN 0 THEN '张三' WHEN 1 THEN '李四光' ELSE '欧阳小明' END")
    text = F.concat(F.lit("客户 "), name, F.lit(" 编号"), F.col("c_custkey").cast("string"))
    return _t(spark, sf_dir, "customer").select("c_custkey", cleaning.mask_pii(text).alias("masked"))


_FOOTERS = "'第 1 页 / 共 9 页', 'Page 3 of 9', ' 3 / 12 ', '免责声明：无', 'Disclaimer: none', 'Notice: x', '机密文件', 'Confidential draft', '© 2026', 'copyright x', 'www.example.com', '=========='"


@_query("""
WITH r(k, rule) AS (VALUES (0, '页眉页脚-页码'), (1, '页眉页脚-页码英文'), (2, '页眉页脚-简写页码'), (3, '免责声明'), (4, '免责声明英文'), (5, '通知声明'), (6, '保密标记'), (7, '保密标记英文'), (8, '版权声明'), (9, '版权声明英文'), (10, '网址页脚'), (11, '装饰分隔线'))
SELECT doc_id, 'body ' || doc_id || chr(10) || chr(10) || 'tail' AS cleaned_text, rule, 1 AS n FROM documents JOIN r ON doc_id % 12 = k
""")
def q05_semantic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(f"concat('body ', doc_id, char(10), element_at(array({_FOOTERS}), cast(doc_id % 12 as int) + 1), char(10), 'tail')")
    docs = _t(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    out = cleaning.clean(docs, cleaning.CleaningConfig(enable_heuristic=False, enable_semantic_filter=True))
    first = F.col("changes")[0]
    return out.select("doc_id", "cleaned_text", first["rule"].alias("rule"), first["count"].alias("n"))


def _solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without white space."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\s+", "").alias("text")).where("text <> ''")


_SOLID = r"t AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS x FROM documents), s AS (SELECT doc_id, x, length(x) AS n FROM t WHERE x <> '')"
_PIECES = f"{_SOLID}, c AS (SELECT doc_id, x, n, unnest(range(CAST(1 + ceil(greatest(0, n - 500) / 450.0) AS BIGINT))) AS i FROM s)"


@_query(f"""WITH {_PIECES}
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substr(x, 1 + i * 450, 500) AS text, CAST(i * 450 AS INTEGER) AS char_start, CAST(least(i * 450 + 500, n) AS INTEGER) AS char_end FROM c
""")
def q06_recursive_solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.recursive_character(_solid(spark, sf_dir)).drop("metadata")


@_query(splitting_sql(500, 50, """doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, text, '{"chunk_size":500,"chunk_overlap":50}' AS metadata, CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end"""))
def q07_recursive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.recursive_character(_t(spark, sf_dir, "documents").select("doc_id", "text"))


@_query(f"""
WITH {_SOLID}, p AS (SELECT doc_id, n, unnest(range(CAST(ceil(n / 2000.0) AS BIGINT))) AS p, x FROM s),
q AS (SELECT doc_id, p, x, least(2000, n - p * 2000) AS m FROM p),
c AS (SELECT *, unnest(range(CAST(1 + ceil(greatest(0, m - 400) / 350.0) AS BIGINT))) AS i FROM q)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, i) - 1 AS INTEGER) AS chunk_index, CAST(p AS VARCHAR) AS parent_index, CAST(i AS VARCHAR) AS child_index,
  CAST(p * 2000 + i * 350 AS INTEGER) AS char_start, CAST(p * 2000 + least(i * 350 + 400, m) AS INTEGER) AS char_end, substr(x, CAST(p * 2000 + i * 350 + 1 AS BIGINT), CAST(least(400, m - i * 350) AS BIGINT)) AS text FROM c
""")
def q08_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splitting.parent_child(_solid(spark, sf_dir))
    of = lambda k: F.get_json_object("metadata", f"$.{k}").alias(k)
    return out.select("doc_id", "chunk_index", of("parent_index"), of("child_index"), "char_start", "char_end", "text")


@_query("""
WITH d AS (SELECT doc_id, lang, source FROM documents)
SELECT doc_id, 0 AS chunk_index, '# ' || lang || chr(10) || 'intro ' || doc_id AS text, lang AS h1, NULL AS h2 FROM d
UNION ALL SELECT doc_id, 1, '## ' || source || chr(10) || 'more', lang, source FROM d
UNION ALL SELECT doc_id, 2, '# end  ' || chr(10) || 'last ' || doc_id, 'end', NULL FROM d
""")
def q09_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('# ', lang, char(10), 'intro ', doc_id, char(10), '## ', source, char(10), 'more', char(10), '# end', char(10), char(10), 'last ', doc_id)")
    out = markdown_structure(_t(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    of = lambda k: F.get_json_object("metadata", f"$['{k}']")
    return out.select("doc_id", "chunk_index", "text", of("Header 1").alias("h1"), of("Header 2").alias("h2"))


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("doc_id", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n\n").alias("text"))


@_query(r"""
SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS i, role AS speaker, regexp_replace(text, '\A\s+|\s+\z', '', 'g') AS said FROM conversations
""")
def q10_dialogue_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.rounds(_talks(spark, sf_dir)).select("doc_id", "i", "speaker", "said")


_EXCHANGES = r"""r AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, regexp_replace(role || ': ' || text, '\A\s+|\s+\z', '', 'g') AS full_text FROM conversations)"""


@_query(f"""WITH {_EXCHANGES}
SELECT doc_id, CAST(i // 2 AS INTEGER) AS i, string_agg(full_text, chr(10) || chr(10) ORDER BY i) AS full_text, CAST(count(*) AS INTEGER) AS round_count FROM (SELECT doc_id, i, full_text FROM r) GROUP BY doc_id, i // 2
""")
def q11_dialogue_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.exchanges(semantic.rounds(_talks(spark, sf_dir))).select("doc_id", "i", "full_text", "round_count")


_NEXT = """n AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, lead(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings),
d AS (SELECT label, vec_id, CASE WHEN w IS NOT NULL THEN list_cosine_similarity(v, w) END AS sim FROM n)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").alias("vector"))


@_query(f"""WITH {_NEXT}
SELECT label, vec_id, CAST(coalesce(sum(CASE WHEN sim < 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS topic FROM d
""")
def q12_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.topics(_vectors(spark, sf_dir), 0.05, "label", "vec_id").select("label", "vec_id", "topic")


@_query(f"""WITH {_NEXT}, e AS (SELECT label, vec_id, 1.0::DOUBLE - sim AS dist FROM d),
s AS (SELECT label, quantile_cont(dist, 0.95::DOUBLE) AS p, avg(dist) + 1.5::DOUBLE * stddev_pop(dist) AS sd, avg(dist) + 1.5::DOUBLE * (quantile_cont(dist, 0.75::DOUBLE) - quantile_cont(dist, 0.25::DOUBLE)) AS iq FROM e GROUP BY label),
m AS (SELECT 'percentile' AS method, label, p AS t FROM s UNION ALL SELECT 'standard_deviation', label, sd FROM s UNION ALL SELECT 'interquartile', label, iq FROM s)
SELECT method, label, vec_id, CAST(coalesce(sum(CASE WHEN dist > t THEN 1 ELSE 0 END) OVER (PARTITION BY method, label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS segment FROM e JOIN m USING (label)
""")
def q13_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = semantic.distances(_vectors(spark, sf_dir), "label", "vec_id")
    parts = [semantic.breakpoints(rows, m, a, "label", "vec_id").select(F.lit(m).alias("method"), "label", "vec_id", "segment") for m, a in (("percentile", 95.0), ("standard_deviation", 1.5), ("interquartile", 1.5))]
    return parts[0].union(parts[1]).union(parts[2])


@_query(r"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^。！？.!?\n]*[。！？.!?\n]|[^。！？.!?\n]+') AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS k FROM p),
s AS (SELECT doc_id, k, regexp_replace(x, '\A[\x09-\x0d\x1c-\x20\x{85}\x{a0}]+|[\x09-\x0d\x1c-\x20\x{85}\x{a0}]+\z', '', 'g') AS sentence FROM u),
n AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS i, sentence FROM s WHERE sentence <> '')
SELECT doc_id, i, sentence, concat_ws(' ', lag(sentence) OVER w, sentence, lead(sentence) OVER w) AS combined FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i)
""")
def q14_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.windows(semantic.sentences(_t(spark, sf_dir, "documents"))).select("doc_id", "i", "sentence", "combined")


@_query("""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
SELECT CAST(vec_id AS VARCHAR) AS chunk_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 4) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) DESC, vec_id LIMIT 10
""")
def q15_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _t(spark, sf_dir, "embeddings")
    query = table.where("vec_id = 0").first().embedding
    return retrieval.search(table, query, 10, None, "embedding", "vec_id")


@_query("""
SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '3' AND json_extract_string(props, '$.k') IS NOT NULL
""")
def q16_metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").where(retrieval.metadata_filter({"k": 3}, "props")).select("event_id", "event_type")


def _rows(cells: Column, tag: str = "td") -> Column:
    return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))


def _page(rows: DataFrame, key: str, order: str, head: str) -> DataFrame:
    """A table a document from rows (key, order, html of the row)."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "html"))), lambda r: r["html"]), "")
    return rows.groupBy(F.col(key).alias("doc_id")).agg(F.concat(F.lit("<p>x</p><table>" + head), lines, F.lit("</table>")).alias("text"))


@_query("""
SELECT n_regionkey AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS chunk_index,
  '在Nations中，关于【' || n_nationkey || '】的记录显示：name为' || n_name || '，size为' || (n_nationkey * 2) || 'm。' AS text,
  CAST(n_nationkey AS VARCHAR) AS id_number, CAST(CAST(n_nationkey * 2 AS DOUBLE) AS VARCHAR) AS size_number FROM nation
""")
def q17_html_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    cells = F.array(key, F.concat(F.lit("<b>"), F.col("n_name"), F.lit("</b>")), F.concat((F.col("n_nationkey") * 2).cast("string"), F.lit("m")))
    rows = _t(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", _rows(cells).alias("html"))
    pages = _page(rows, "n_regionkey", "n_nationkey", "<thead><tr><th colspan=3>Nations</th></tr><tr><th>ID</th><th>name</th><th>size</th></tr></thead>")
    out = row_tables.html_table(pages, {"template_style": "primary_key_based"})
    of = lambda k: F.get_json_object("metadata", f"$.numeric_fields.{k}")
    return out.select("doc_id", "chunk_index", "text", of("ID").alias("id_number"), of("size").alias("size_number"))


@_query("""
WITH s AS (SELECT s_nationkey AS doc_id, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier),
v AS (SELECT *, first_value(s_name) OVER (PARTITION BY doc_id, i // 3 ORDER BY i) AS filled, first_value('note ' || s_suppkey) OVER (PARTITION BY doc_id, i // 2 ORDER BY i) AS above FROM s)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, '列1为' || s_suppkey || '，列2为' || filled || '，列3为' || CASE i % 2 WHEN 0 THEN above ELSE '同上（即：' || above || '）' END || '。' AS text FROM v
""")
def q18_fill_and_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    rows = _t(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name", i.alias("i"))
    cells = F.array(F.col("s_suppkey").cast("string"), F.when(F.col("i") % 3 == 0, F.col("s_name")).otherwise(""), F.when(F.col("i") % 2 == 0, F.concat(F.lit("note "), F.col("s_suppkey").cast("string"))).otherwise("同上"))
    pages = _page(rows.select("s_nationkey", "s_suppkey", _rows(cells).alias("html")), "s_nationkey", "s_suppkey", "")
    return row_tables.html_table(pages).select("doc_id", "chunk_index", "text")


_SCORE_HEAD = "<tr><th>组别</th><th>考核项</th><th>考核指标</th><th>权重</th><th>考核标准</th><th colspan=2>姓名：甲</th><th colspan=2>姓名：乙</th></tr><tr><th></th><th></th><th></th><th></th><th></th><th>评分</th><th>评分理由</th><th>评分</th><th>评分理由</th></tr>"


def _score_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, bal = F.col("s_suppkey").cast("string"), F.floor(F.abs("s_acctbal"))
    second = F.when(F.col("s_suppkey") % 4 == 0, "/").otherwise((bal % 100).cast("string"))
    cells = F.array(F.lit("G1"), F.concat(F.lit("item"), key), F.col("s_name"), F.concat((F.col("s_suppkey") % 3).cast("string"), F.lit("%")), F.concat(F.lit("std"), key), (bal % 50).cast("string"), F.concat(F.lit("why "), key), second, F.lit("-"))
    rows = _t(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", _rows(cells).alias("html"))
    return _page(rows, "s_nationkey", "s_suppkey", _SCORE_HEAD)


_SCORES = """l AS (
  SELECT s_nationkey AS doc_id, s_suppkey, s_name, '甲' AS employee, 0 AS e, CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) % 50 AS VARCHAR) AS score, 'why ' || s_suppkey AS reason, (s_suppkey % 3) || '%' AS weight FROM supplier
  UNION ALL SELECT s_nationkey, s_suppkey, s_name, '乙', 1, CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) % 100 AS VARCHAR), '', (s_suppkey % 3) || '%' FROM supplier WHERE s_suppkey % 4 <> 0)"""


@_query(f"""WITH {_SCORES}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s_suppkey, e) - 1 AS INTEGER) AS chunk_index,
  '在【G1】的绩效考核中，员工【' || employee || '】，在【item' || s_suppkey || '-' || s_name || '】上，得分为【' || score || '】分' || CASE WHEN reason <> '' THEN '，评分理由：【' || reason || '】' ELSE '' END || '。' || chr(10) || '（背景信息：指标权重：' || weight || '；考核标准：std' || s_suppkey || '）' AS text FROM l
""")
def q19_score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_tables.complex_table(_score_pages(spark, sf_dir)).select("doc_id", "chunk_index", "text")


@_query(f"""WITH {_SCORES},
g AS (SELECT doc_id, employee, weight, count(*) AS n, min(s_suppkey * 2 + e) AS first,
  string_agg('- item' || s_suppkey || '-' || s_name || '：得分为【' || score || '】分' || CASE WHEN reason <> '' THEN '（评分理由：' || reason || '）' ELSE '' END || '。', chr(10) ORDER BY s_suppkey) AS lines,
  string_agg('考核标准：std' || s_suppkey, '；' ORDER BY s_suppkey) AS norms FROM l GROUP BY doc_id, employee, weight)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS chunk_index, CAST(n AS VARCHAR) AS indicators,
  '在【G1】的绩效考核中，员工【' || employee || '】，在权重【' || weight || '】的考核指标上表现如下：' || chr(10) || lines || chr(10) || '（背景信息：指标权重：' || weight || '；' || norms || '）' AS text FROM g
""")
def q20_weight_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_tables.complex_table(_score_pages(spark, sf_dir), {"template_style": "weight_split"})
    return out.select("doc_id", "chunk_index", F.get_json_object("metadata", "$.indicator_count").alias("indicators"), "text")


@_query(f"""WITH {_PIECES}
SELECT doc_id, max(n_chunks) AS total_chunks, substr(any_value(x), 1, CAST(max(least(i * 450 + 500, n)) + 200 AS BIGINT)) AS source_preview
FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_chunks FROM c) WHERE i < 3 GROUP BY doc_id
""")
def q21_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _solid(spark, sf_dir)
    shown = preview.preview_chunks(splitting.recursive_character(docs), 3)
    totals = shown.groupBy("doc_id").agg(F.max("total_chunks").alias("total_chunks"))
    return preview.source_preview(docs, shown).join(totals, "doc_id").select("doc_id", "total_chunks", "source_preview")


@_query(f"""WITH {_PIECES}, h AS (SELECT doc_id, n, i, greatest(i * 450, CASE WHEN i = 0 THEN 0 ELSE i * 450 + 50 END) AS a, least(i * 450 + 500, n) AS b FROM c)
SELECT doc_id, CAST(a AS INTEGER) AS seg_start, CAST(b AS INTEGER) AS seg_end, CAST(i AS INTEGER) AS chunk_index, CAST(i % 8 AS INTEGER) AS colour FROM h WHERE b > a
UNION ALL SELECT doc_id, CAST(max(b) AS INTEGER), CAST(max(n) AS INTEGER), -1, -1 FROM h GROUP BY doc_id HAVING max(n) > max(b)
""")
def q22_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _solid(spark, sf_dir)
    return preview.highlight(splitting.recursive_character(docs), docs).na.fill(-1)


@_query("""
SELECT * FROM (VALUES ('recursive_character', '递归字符分块', 2), ('semantic', '语义分块', 6), ('markdown_structure', 'Markdown 结构分块', 1), ('pdf_table_layout', 'PDF 表格版面分块', 5), ('parent_child', '父子双粒度分块', 3), ('dialogue_aware', '对话体语义分块', 5), ('html_table', 'HTML 表格分块', 3), ('complex_table', '复杂多维表格分块', 2)) AS t(name, label, n_params)
""")
def q23_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.list_strategies(spark).select("name", "label", F.expr("json_array_length(param_schema)").alias("n_params"))


@_query("SELECT event_type AS level, count(*) AS n FROM events GROUP BY event_type")
def q24_log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log stream, counted by level until the input is used up."""
    from inkfall.streaming import logs

    schema = _t(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumnRenamed("event_type", "level")
    name = f"log_levels_{uuid.uuid4().hex}"
    run = logs.level_counts(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@_query("""
SELECT c_custkey, pii_type, CAST(n AS INTEGER) AS n, '掩码了 ' || n || ' 个' || pii_type AS detail
FROM customer, (VALUES ('手机号', 2), ('固定电话', 1), ('邮箱', 1), ('身份证号', 1), ('中文姓名', 2)) AS t(pii_type, n)
""")
def q31_pii_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the masking of each kind reports."""
    text = F.concat(F.lit("客户 张三 电话 13800138000 或 139"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit("，010-12345678，zhang"), F.col("c_custkey"), F.lit("@example.com，110101199001011234 。"))
    found = cleaning.clean(_t(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), cleaning.CleaningConfig(enable_heuristic=False, enable_pii=True))
    return found.select("c_custkey", F.explode("changes").alias("c")).where("c.op = 'pii_mask'").select("c_custkey", "c.pii_type", F.col("c.count").alias("n"), "c.detail")


@_query("""
SELECT p_partkey, p_name || '，' || p_brand || ' ' || '[图片: ' || p_type || '(u' || p_partkey || ')] <b>' || p_size || ' end' AS text FROM part
""")
def q25_cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.expr("concat('<table><tr><td> ', p_name, '<br/><p>', p_brand, '</p><img src=\"u', p_partkey, '\" alt=\"', p_type, '\">', char(10), '  <i>&lt;b&gt;', p_size, '</i>', char(10), 'end</td></tr></table>')")
    out = row_tables.html_table(_t(spark, sf_dir, "part").select("p_partkey", cell.alias("text")))
    return out.select("p_partkey", F.get_json_object("metadata", "$.raw_data.列1").alias("text"))


@_query(f"""WITH {_PIECES}
SELECT doc_id, 'recursive_character' AS strategy_name, count(*) AS total_chunks, 'completed' AS status FROM c GROUP BY doc_id
""")
def q26_job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = jobs.with_ids(registry.chunk(_solid(spark, sf_dir), "recursive_character"), "recursive_character")
    return jobs.job_rows(chunks, "recursive_character").select("doc_id", "strategy_name", "total_chunks", "status")


@_query("""
WITH r AS (SELECT conv_id AS doc_id, role || ': ' || text AS x, turn FROM conversations), t AS (SELECT doc_id, string_agg(x, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n FROM r GROUP BY doc_id)
SELECT doc_id, text, 0 AS char_start, CAST(length(text) AS INTEGER) AS char_end FROM t
""")
def q27_dialogue_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an embedder every conversation is one chunk."""
    return registry.chunk(_talks(spark, sf_dir), "dialogue_aware").select("doc_id", "text", "char_start", "char_end")


@_query()
def q28_semantic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic chunks with hashed words as vectors."""
    embed = retrieval.Embedding(retrieval.hashed_vectors(), in_flight=0)
    return registry.chunk(_t(spark, sf_dir, "documents").select("doc_id", "text"), "semantic", {"breakpoint_threshold": 80.0}, embed=embed)


@_query("""
SELECT page_id, 0 AS n_rows FROM pages
""")
def q29_pages_without_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no tables, so row chunks are none."""
    pages = _t(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    found = row_tables.html_table(pages).groupBy(F.col("page_id").alias("_id")).agg(F.count("*").cast("int").alias("n"))
    return pages.join(found, F.col("page_id") == F.col("_id"), "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n_rows"))


@_query("""
SELECT event_id AS id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS timestamp FROM events ORDER BY ts DESC, event_id DESC LIMIT 500
""")
def q30_log_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkfall.streaming import logs

    log = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("timestamp"))
    return logs.history(log, 500)


def queries() -> dict[str, Query]:
    from inkfall.plans import catalogue_services  # noqa: F401 - it adds its queries to these

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
