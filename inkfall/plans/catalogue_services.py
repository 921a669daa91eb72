"""Queries of what stores, serves and streams: the chunk store, table functions, the log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfall.operators import row_tables, splitting
from inkfall.operators.markdown import markdown_structure
from inkfall.plans import jobs, table_functions
from inkfall.plans.catalogue import _PIECES, _SOLID, _page, _query, _rows, _t
from inkfall.plans.splitting_sql import _SPACES, splitting_sql
from inkfall.plans.store import Store
from inkfall.sources import shared


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without white space, empty ones too."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "").alias("text"))


@_query(r"""
WITH t AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) AS n FROM documents WHERE doc_id % 7 <> 0),
r AS (SELECT doc_id, n, unnest(range(CASE WHEN n = 0 OR doc_id % 3 = 0 THEN 0 ELSE CAST(1 + ceil(greatest(0, n - 500) / 450.0) AS BIGINT) END)) AS i FROM t),
p AS (SELECT doc_id, n, unnest(range(CAST(ceil(n / 2000.0) AS BIGINT))) AS p FROM t),
q AS (SELECT doc_id, least(2000, n - p * 2000) AS m FROM p),
c AS (SELECT doc_id, m, unnest(range(CAST(1 + ceil(greatest(0, m - 400) / 350.0) AS BIGINT))) AS i FROM q)
SELECT doc_id, 'recursive_character' AS strategy_name, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS number, count(i) AS total_chunks, count(i) AS n_stored, CAST(coalesce(sum(CASE WHEN i IS NOT NULL THEN least(500, n - i * 450) END), 0) AS BIGINT) AS n_chars
FROM t LEFT JOIN r USING (doc_id, n) GROUP BY doc_id
UNION ALL
SELECT doc_id, 'parent_child', 3, count(i), count(i), CAST(coalesce(sum(CASE WHEN i IS NOT NULL THEN least(400, m - i * 350) END), 0) AS BIGINT) FROM t LEFT JOIN c USING (doc_id) GROUP BY doc_id
""")
def q32_three_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three executions, of which the second empties every third document's job, and a deletion: what the last snapshot holds."""
    store, docs = Store(spark, shared.scratch_path(spark, "executions"), "bigint"), _dense(spark, sf_dir)
    jobs.execute(docs, "recursive_character", None, store.root, run="z")
    jobs.execute(docs.where("doc_id % 3 = 0").withColumn("text", F.lit("")), "recursive_character", None, store.root, run="backfill")
    jobs.execute(docs, "parent_child", None, store.root, run="a")
    store.delete_documents(docs.where("doc_id % 7 = 0"), "doc_id")
    held = store.chunks().groupBy("job_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return store.chunk_jobs().join(held, "job_id", "left").select("doc_id", "strategy_name", "number", "total_chunks", F.coalesce("n", F.lit(0)).alias("n_stored"), F.coalesce("chars", F.lit(0)).cast("long").alias("n_chars"))


@_query(f"""
WITH {_SOLID} SELECT doc_id, CAST(4000 + 350 AS INTEGER) AS char_start, substr(x, 4351, CAST(least(400, least(2000, n - 4000) - 350) AS BIGINT)) AS text FROM s WHERE n - 4000 > 400
""")
def q33_stored_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third parent's second child, found by the metadata that the store keeps as columns."""
    root = shared.scratch_path(spark, "stored")
    jobs.execute(_dense(spark, sf_dir), "parent_child", None, root)
    return Store(spark, root).chunks(strategy="parent_child", filters={"parent_index": 2, "child_index": 1, "granularity": "child"}).select("doc_id", "char_start", "text")


@_query(f"""
WITH {_PIECES.replace("500", "400").replace("450", "370")}
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, '{{"chunk_size":400,"chunk_overlap":30}}' AS metadata, substr(x, 1 + i * 370, 400) AS text, CAST(i * 370 AS INTEGER) AS char_start, CAST(least(i * 370 + 400, n) AS INTEGER) AS char_end FROM c
""")
def q34_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents without white space, asked for in SQL."""
    table_functions.register(spark)
    source = F.regexp_replace("text", r"\s+", "").alias("body")
    return spark.sql("SELECT * FROM recursive_character(TABLE({docs}), chunk_size => 400, chunk_overlap => 30, text_col => 'body')", docs=_t(spark, sf_dir, "documents").select("doc_id", source).where("body <> ''"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of the log."""
    return _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("timestamp"), F.col("event_type").alias("level"), F.col("props").alias("message"))


@_query("""
WITH e AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, count(*) OVER () AS n FROM events)
SELECT event_type AS level, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(event_id) AS BIGINT) AS ids FROM e WHERE seq >= n - 2000 GROUP BY event_type
""")
def q35_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a log, of which a new subscriber gets the last 2000."""
    from inkfall.streaming import log_source, logs

    log, name = shared.scratch_path(spark, "log"), f"replay_{uuid.uuid4().hex}"
    log_source.publish_rows(_entries(spark, sf_dir).withColumn("id", F.col("seq").cast("string")).withColumn("order", F.col("seq")), log, "timestamp", "order")
    counts = logs.subscribe(spark, log, replay=2000).groupBy("level").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum(F.col("id").cast("long")).alias("ids"))
    counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@_query("""
WITH e AS (SELECT CAST(user_id % 8 AS VARCHAR) AS client, event_type, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT client, event_type AS level, count(*) AS n FROM e WHERE k <= 1000 GROUP BY client, event_type
""")
def q36_client_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by level of the last 1000 entries of eight clients, which get them out of order and in several batches."""
    from inkfall.streaming import clients

    place = shared.scratch_path(spark, "clients")
    rows = _entries(spark, sf_dir).withColumn("client", (F.col("user_id") % 8).cast("string")).drop("user_id")
    rows.repartition(6, F.xxhash64("seq")).write.parquet(f"{place}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{place}/in")
    clients.keep_views(stream, f"{place}/out", f"{place}/checkpoint", level="error").awaitTermination()
    return clients.newest_views(spark, f"{place}/out").select("client", F.explode("counts").alias("level", "n"))


_PLACED = "doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, text, CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end"


@_query(splitting_sql(800, 50, _PLACED))
def q37_pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as texts without a PDF behind them."""
    return splitting.pdf_text(_t(spark, sf_dir, "documents").select("doc_id", "text")).drop("metadata")


@_query(splitting_sql(2000, 0, _PLACED + ", CAST(chunk_index AS VARCHAR) AS parent_index"))
def q38_parents_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = splitting.parent_child(_t(spark, sf_dir, "documents").select("doc_id", "text"), {"return_parents_only": True})
    return found.withColumn("parent_index", F.get_json_object("metadata", "$.parent_index")).drop("metadata")


@_query(splitting_sql(300, 100, _PLACED))
def q39_recursive_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splitting by column expressions alone."""
    return splitting.recursive_character(_t(spark, sf_dir, "documents").select("doc_id", "text"), {"chunk_size": 300, "chunk_overlap": 100}, native=True).drop("metadata")


def _by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as Markdown: the first letter of a line makes it a header, the end of a block of code, or neither."""
    text = F.col("text")
    for letters, mark in (("A-D", "# "), ("F-M", "## "), ("N-Z", "### "), ("E", "``` ")):
        text = F.regexp_replace(text, f"(?md)^(?=[{letters}])", mark)
    return _t(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@_query(rf"""
WITH l AS (
  SELECT doc_id, i, CASE WHEN regexp_matches(x, '^[A-D]') THEN '# ' || x WHEN regexp_matches(x, '^[F-M]') THEN '## ' || x WHEN regexp_matches(x, '^[N-Z]') THEN '### ' || x WHEN x LIKE 'E%' THEN '``` ' || x ELSE x END AS x
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
), c AS (
  SELECT doc_id, i, regexp_replace(trim(x, {_SPACES}), '[\p{{Cc}}\p{{Cf}}\p{{Co}}\p{{Zl}}\p{{Zp}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]', '', 'g') AS x FROM l
), f AS (
  SELECT *, sum(CASE WHEN x LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS fenced FROM c
), h AS (
  SELECT *, CASE WHEN fenced THEN NULL WHEN x = '#' OR x LIKE '# %' THEN 1 WHEN x = '##' OR x LIKE '## %' THEN 2 WHEN x = '###' OR x LIKE '### %' THEN 3 END AS level FROM f
), o AS (
  SELECT *, max(CASE WHEN level = 1 THEN i END) OVER w AS i1, max(CASE WHEN level <= 2 THEN i END) OVER w AS i2, max(CASE WHEN level <= 3 THEN i END) OVER w AS i3,
    sum(CASE WHEN level IS NOT NULL OR x = '' AND NOT fenced THEN 1 ELSE 0 END) OVER w AS paragraph
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), p AS (
  SELECT doc_id, paragraph, min(i) AS i, max(i1) AS i1, max(i2) AS i2, max(i3) AS i3, string_agg(x, chr(10) ORDER BY i) AS part, arg_max(x, i) AS last
  FROM o WHERE x <> '' OR fenced GROUP BY doc_id, paragraph
), n AS (
  SELECT p.*, a.x AS h1, CASE WHEN b.level = 2 THEN b.x END AS h2, CASE WHEN d.level = 3 THEN d.x END AS h3
  FROM p LEFT JOIN h a ON a.doc_id = p.doc_id AND a.i = i1 LEFT JOIN h b ON b.doc_id = p.doc_id AND b.i = i2 LEFT JOIN h d ON d.doc_id = p.doc_id AND d.i = i3
), t AS (
  SELECT doc_id, i, part, last, trim(substr(h1, 2), {_SPACES}) AS h1, trim(substr(h2, 3), {_SPACES}) AS h2, trim(substr(h3, 4), {_SPACES}) AS h3 FROM n
), m AS (
  SELECT *, CASE WHEN h1 IS NULL THEN 0 ELSE 1 END + CASE WHEN h2 IS NULL THEN 0 ELSE 1 END + CASE WHEN h3 IS NULL THEN 0 ELSE 1 END AS depth FROM t
), q AS (
  SELECT *, CASE WHEN lag(i) OVER w IS NOT NULL AND (lag(h1) OVER w IS NOT DISTINCT FROM h1 AND lag(h2) OVER w IS NOT DISTINCT FROM h2 AND lag(h3) OVER w IS NOT DISTINCT FROM h3 OR lag(depth) OVER w < depth AND lag(last) OVER w LIKE '#%') THEN 0 ELSE 1 END AS begins
  FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), r AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM q)
SELECT doc_id, CAST(section - 1 AS INTEGER) AS chunk_index, string_agg(part, '  ' || chr(10) ORDER BY i) AS text, arg_max(struct_pack(h := h1), i).h AS h1, arg_max(struct_pack(h := h2), i).h AS h2, arg_max(struct_pack(h := h3), i).h AS h3
FROM r GROUP BY doc_id, section
""")
def q40_markdown_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents under headers and with blocks of code, by column expressions alone."""
    out = markdown_structure(_by_lines(spark, sf_dir))
    of = lambda k: F.get_json_object("metadata", f"$['{k}']")
    return out.select("doc_id", "chunk_index", "text", of("Header 1").alias("h1"), of("Header 2").alias("h2"), of("Header 3").alias("h3"))


@_query("""
WITH c AS (SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS k, row_number() OVER w - 1 AS i, lead(CAST(c_custkey AS VARCHAR)) OVER w AS next, lag(CAST(c_custkey AS VARCHAR)) OVER w AS above, lag(CAST(c_custkey AS VARCHAR), 2) OVER w AS second FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
n AS (SELECT *, CASE i % 4 WHEN 0 THEN 'note ' || k WHEN 1 THEN '同上（即：note ' || above || '）' WHEN 2 THEN '同' || (i - 1) || '行（即（' || second || '行）：note ' || second || '）' ELSE '见第' || (i + 2) || '行' || coalesce('（参考' || next || '行：note ' || next || '）', '') END AS note FROM c)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, '在Customers中，关于【' || k || '】的记录显示：note为' || note || '。' AS text, k AS id_number, note AS raw_note, CAST(i AS VARCHAR) AS row_index FROM n
""")
def q41_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a row of its nation's table, whose notes refer to the row above, to one before and to the next, by number."""
    i = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    note = F.when(i % 4 == 0, F.concat(F.lit("note "), F.col("c_custkey"))).when(i % 4 == 1, "同上").when(i % 4 == 2, F.concat(F.lit("同"), i - 1, F.lit("行"))).otherwise(F.concat(F.lit("见第"), i + 2, F.lit("行")))
    # Few and long documents: of so many partitions hardly any has two of them, and their number is kept.
    spread = _t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey").repartition(100, "c_nationkey")
    rows = spread.select("c_nationkey", "c_custkey", _rows(F.array(F.col("c_custkey").cast("string"), note)).alias("html"))
    pages = _page(rows, "c_nationkey", "c_custkey", "<thead><tr><th colspan=2>Customers</th></tr><tr><th>id</th><th>note</th></tr></thead>")
    out = row_tables.html_table(pages, {"template_style": "primary_key_based"})
    of = lambda k: F.get_json_object("metadata", f"$.{k}")
    return out.select("doc_id", "chunk_index", "text", of("numeric_fields.id").alias("id_number"), of("raw_data.note").alias("raw_note"), of("row_index").alias("row_index"))
