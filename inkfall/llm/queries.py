"""The queries of this package, one for each operator, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, langid, mixing, packing, pii, quality, ranking, simhash, substrings, token_files, topk, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql(r"SELECT -7L AS conv_id, turn, role, r'\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    return chat.digests(chat.format_chats(turns))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(_table(spark, sf_dir, "documents"), size=3, radius=3)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeated_windows(_table(spark, sf_dir, "documents"), size=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=5, every=50, scale=256)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (langid.remainder("doc_id") == 2).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"), F.col("_entropy").alias("entropy"))


#: Target weights, a parameter of the query and of the pipeline's stage: as much of each named source,
#: and a fifth of that of all others together. They are not taken from the sizes of any table.
MIX_WEIGHTS = {f"src{i}": 5 for i in range(20)}
MIX_OTHER, MIX_BLOCK = 1, 16


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.schedule(_table(spark, sf_dir, "documents").select("doc_id", "source"), MIX_WEIGHTS, other=MIX_OTHER, block_docs=MIX_BLOCK, whole=True)
    return placed.select("doc_id", "source", *[F.col(f"_{c}").alias(c) for c in ("block", "release", "deadline", "slot", "position", "in_mix")])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(kind) for kind in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(pii.span_list("pii_base"), 256).alias("base_sha256"), pii.span_list("pii_spans").alias("spans"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, quality.learn(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality")), name="score")
    return found.select("doc_id", (langid.remainder("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(_table(spark, sf_dir, "embeddings"))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS first,
    length(text) + length(text) - length(replace(text, '\', ''))
      + (SELECT coalesce(sum(length(x) - 1), 0) FROM (SELECT unnest(regexp_extract_all(text, '#+')) AS x))
      + (length(text) - length(replace(replace(text, '</turn>', ''), '</part>', ''))) // 7 AS esc_chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(esc_chars + CASE WHEN first THEN length(role) + 6 + 8 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP8_SQL = """
WITH RECURSIVE weights AS (
  SELECT 'src' || i AS name, 5 AS weight FROM range(20) AS r(i) UNION ALL SELECT '', 1
), docs AS (
  SELECT doc_id, source, coalesce(w.name, '') AS name, md5(CAST(doc_id AS VARCHAR)) AS hash
  FROM documents LEFT JOIN (SELECT name FROM weights WHERE name <> '') w ON source = w.name
), used AS (
  SELECT name, weight, (n + 15) // 16 AS blocks, row_number() OVER (ORDER BY name = '', name) AS k
  FROM weights JOIN (SELECT name, count(*) AS n FROM docs GROUP BY name) USING (name)
), p AS (
  SELECT list(weight ORDER BY k) AS w, list(blocks ORDER BY k) AS b, list(CAST(0 AS BIGINT) ORDER BY k) AS zero FROM used
), edf AS (  -- slot by slot; where the next in turn has no block left, the others start a new schedule
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS base, zero AS j, zero AS done, list_transform(w, lambda x: CAST(x AS BIGINT)) AS live,
    CAST(NULL AS BIGINT) AS k, CAST(NULL AS BIGINT) AS block, CAST(NULL AS BIGINT) AS release, CAST(NULL AS BIGINT) AS deadline FROM p
  UNION ALL
  SELECT slot, base, list_transform(j, lambda x, i: x + CASE WHEN i = pick THEN 1 ELSE 0 END), list_transform(done, lambda x, i: x + CASE WHEN i = pick THEN 1 ELSE 0 END), live,
    pick, done[pick], base + j[pick] * total // live[pick], base + ((j[pick] + 1) * total + live[pick] - 1) // live[pick]
  FROM (
    SELECT *, CAST(list_min(list_transform(j, lambda x, i: CASE WHEN live[i] > 0 AND x * total // live[i] <= slot - base
      THEN ((x + 1) * total + live[i] - 1) // live[i] * 1000 + i END)) % 1000 AS BIGINT) AS pick
    FROM (
      SELECT slot, CASE WHEN ends THEN slot ELSE base END AS base, CASE WHEN ends THEN zero ELSE j END AS j, done,
        CASE WHEN ends THEN rest ELSE live END AS live, CAST(list_sum(CASE WHEN ends THEN rest ELSE live END) AS BIGINT) AS total
      FROM (
        SELECT *, b[turn] = done[turn] AS ends, list_transform(w, lambda x, i: CASE WHEN done[i] < b[i] THEN CAST(x AS BIGINT) ELSE 0 END) AS rest FROM (
          SELECT *, CAST(list_min(list_transform(j, lambda x, i: CASE WHEN live[i] > 0 AND x * total // live[i] <= slot - base
            THEN ((x + 1) * total + live[i] - 1) // live[i] * 1000 + i END)) % 1000 AS BIGINT) AS turn
          FROM (SELECT slot + 1 AS slot, base, j, done, live, w, b, zero, CAST(list_sum(live) AS BIGINT) AS total FROM edf, p WHERE slot + 1 < list_sum(b))
        )
      )
    )
  )
), ranked AS (
  SELECT docs.*, u.k, row_number() OVER (PARTITION BY u.k ORDER BY hash, doc_id) - 1 AS rank FROM docs JOIN used u USING (name)
)
SELECT doc_id, source, block, release, deadline, slot, slot * 16 + rank % 16 AS position, true AS in_mix
FROM ranked r JOIN edf s ON r.k = s.k AND s.block = rank // 16
"""

OP5_SQL = """
WITH t AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM t q JOIN t d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""

OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)
), tf AS (
  SELECT doc_id, row, term, count(*) AS tf FROM words GROUP BY doc_id, row, term
), lengths AS (
  SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row
), whole AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (row), whole GROUP BY item_id, doc_id, row
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
) WHERE rank <= 50
"""


def _op13_sql(rounds: int = 6) -> str:
    """One pair of steps a round: parts to their nearest entries, entries to the means of their parts."""
    nearest = "SELECT vec_id, part, any_value(v) AS v, min(dist) AS dist, arg_min(entry, (dist, entry)) AS entry FROM (SELECT p.*, c.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS dist FROM p JOIN {books} c USING (part)) GROUP BY vec_id, part"
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(books=f'c{r}')})")
        steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT part, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
    FROM (SELECT part, entry, i, CAST(sum(v[i]) AS BIGINT) AS total, count(*) AS n FROM a{r}, (SELECT unnest(range(1, each + 1)) AS i FROM width) GROUP BY part, entry, i)
    GROUP BY part, entry
  ) m USING (part, entry)
)""")
    return f"""
WITH t AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), width AS (SELECT max(len(v)) // 8 AS each FROM t), p AS MATERIALIZED (
  SELECT vec_id, part, v[part * each + 1 : part * each + each] AS v FROM t, width, (SELECT unnest(range(8)) AS part)
), firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM t ORDER BY vec_id LIMIT 16
), c0 AS (SELECT part, entry, v FROM p JOIN firsts USING (vec_id)),
{", ".join(steps)},
z AS ({nearest.format(books=f"c{rounds}")}),
found AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM z GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM found JOIN t USING (vec_id)
"""


OP13_SQL = _op13_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_best_fit_packing, op3_simhash_near_dedup, op4_substring_dedup, op5_exact_top_k, op6_token_files, op7_exact_dedup, op8_mixing, op9_pii, op10_language_id, op11_ranked_search, op12_quality_classifier, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op5_exact_top_k": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op8_mixing": OP8_SQL, "op11_ranked_search": OP11_SQL, "op13_vector_codes": OP13_SQL}
