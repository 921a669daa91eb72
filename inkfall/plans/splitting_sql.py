"""SQL of recursive splitting, the oracle of the queries over texts with separators.

Pieces of each level are rows; runs of small ones are merged step by step by one recursive table, all
runs at once, and a second one finds the places, all documents at once.
"""

from __future__ import annotations

_LEVELS = [("chr(10) || chr(10)", "0", "0"), ("chr(10)", "i", "0"), ("' '", "a", "i")]
_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(32) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


def splitting_sql(size: int, overlap: int, columns: str) -> str:
    """Chunks of documents: `columns` may name doc_id, chunk_index (bigint from 0), text, char_start and char_end."""
    step, levels, pieces = max(1, size - overlap), [], []
    for k, (separator, a, b) in enumerate(_LEVELS, 1):
        source = "SELECT doc_id, 0 AS a, 0 AS b, text AS x FROM d" if k == 1 else f"SELECT doc_id, {a} AS a, {b} AS b, p AS x FROM l{k - 1} WHERE length(p) >= {size}"
        levels.append(f"""l{k} AS MATERIALIZED (
  SELECT doc_id, a, b, i, CASE WHEN i = 1 THEN x ELSE {separator} || x END AS p
  FROM (SELECT doc_id, a, b, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, a, b, string_split(x, {separator}) AS parts FROM ({source})))
  WHERE i > 1 OR x <> ''
)""")
        pieces.append(f"SELECT doc_id, {k} AS level, a, b, i, p, length(p) AS n FROM l{k}")
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{", ".join(levels)},
slices AS (
  SELECT doc_id, a, b, i, unnest(range(CAST(ceil((greatest(length(p) - {size}, 0) + {step}) / {step}.0) AS BIGINT))) AS j, p FROM l3 WHERE length(p) >= {size}
), small AS (
  SELECT *, sum(CASE WHEN n >= {size} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, level, a, b ORDER BY i) AS run FROM ({" UNION ALL ".join(pieces)})
), laid AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id, level, a, b, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM small WHERE n < {size}
), runs AS MATERIALIZED (
  SELECT row_number() OVER () AS run_id, * FROM (
    SELECT doc_id, level, a, b, list(i ORDER BY i) AS places, list(p ORDER BY i) AS ps, list(n ORDER BY i) AS ns, list(CAST(before AS BIGINT) ORDER BY i) AS befores FROM laid GROUP BY doc_id, level, a, b, run
  )
), merging AS (
  SELECT run_id, CAST(2 AS BIGINT) AS r, CAST(1 AS BIGINT) AS lo, ns[1] AS total, CAST(NULL AS BIGINT) AS from_, CAST(NULL AS BIGINT) AS to_ FROM runs
  UNION ALL
  SELECT run_id, r + 1, next, befores[r] - befores[next] + ns[r], CASE WHEN full_ THEN lo END, CASE WHEN full_ THEN r - 1 END
  FROM (
    SELECT m.run_id, r, lo, befores, ns, total + ns[r] > {size} AS full_,
      CASE WHEN total + ns[r] > {size} THEN lo + len(list_filter(befores[lo : r - 1], lambda x: befores[r] - x > least({overlap}, {size} - ns[r]))) ELSE lo END AS next
    FROM merging m JOIN runs USING (run_id) WHERE r <= len(ns)
  )
), spans AS (
  SELECT run_id, from_, to_ FROM merging WHERE from_ IS NOT NULL
  UNION ALL SELECT run_id, lo, len(ns) FROM merging JOIN runs USING (run_id) WHERE r = len(ns) + 1
), found AS (
  SELECT doc_id, CASE level WHEN 1 THEN places[from_] ELSE a END AS k1, CASE level WHEN 1 THEN 0 WHEN 2 THEN places[from_] ELSE b END AS k2, CASE level WHEN 3 THEN places[from_] ELSE 0 END AS k3, CAST(0 AS BIGINT) AS k4, array_to_string(ps[from_ : to_], '') AS raw
  FROM spans JOIN runs USING (run_id)
  UNION ALL SELECT doc_id, a, b, i, j, substr(p, 1 + j * {step}, {size}) FROM slices
), chunks AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k1, k2, k3, k4) - 1 AS chunk_index, chunk AS text FROM (SELECT *, trim(raw, {_SPACES}) AS chunk FROM found) WHERE chunk <> ''
), placed AS (
  SELECT doc_id, CAST(-1 AS BIGINT) AS chunk_index, '' AS text, CAST(0 AS BIGINT) AS char_start, CAST({overlap} AS BIGINT) AS char_end FROM d
  UNION ALL
  SELECT doc_id, chunk_index, text, char_start, char_start + length(text) FROM (
    SELECT c.doc_id, c.chunk_index, c.text, greatest(0, p.char_end - {overlap}) + instr(substr(d.text, greatest(0, p.char_end - {overlap}) + 1), c.text) - 1 AS char_start
    FROM placed p JOIN chunks c ON c.doc_id = p.doc_id AND c.chunk_index = p.chunk_index + 1 JOIN d ON d.doc_id = p.doc_id
  )
)
SELECT {columns} FROM placed WHERE chunk_index >= 0
"""
