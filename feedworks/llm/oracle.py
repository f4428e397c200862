"""DuckDB SQL of the operators that SQL can express, over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc_of_byte(value: int) -> int:
    for _ in range(8):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


# crc32 of one byte after another, by the table of all bytes' remainders.
_CRC_TABLE = ", ".join(str(_crc_of_byte(i)) for i in range(256))
_CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, octet_length(encode({0})) + 1),
    lambda i: ('0x' || hex(encode({0})[i:i]))::BIGINT),
    lambda c, b: xor(v[xor(c, b) % 256 + 1], c // 256)), 4294967295)"""

OP11 = f"""
WITH RECURSIVE crc AS (SELECT [{_CRC_TABLE}]::BIGINT[] AS v),
run AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc,
         translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), '{_UPPER}', '{_LOWER}') AS w
  FROM documents
),
counted AS (SELECT doc, w, count(*) AS k FROM run GROUP BY ALL),
hashed AS (SELECT w, k, {_CRC32.format("(doc || ':' || w)")} AS h FROM counted, crc),
edited AS (
  SELECT k, CASE WHEN h % 31 = 0
    THEN substring(w, 1, (h % length(w))::INT) || substring(w, (h % length(w))::INT + 2) ELSE w END AS word
  FROM hashed
),
vocab AS (
  SELECT word, sum(k)::BIGINT AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
),
-- Every word without each of its code points.
gap AS (
  SELECT word, n, i, substring(word, 1, i::INT - 1) || substring(word, i::INT + 1) AS short
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)
),
longer AS (SELECT DISTINCT g.word AS a, g.n AS an, v.word AS b, v.n AS bn FROM gap g JOIN vocab v ON g.short = v.word),
pair AS (
  SELECT DISTINCT x.word AS a, y.word AS b, y.n AS bn
  FROM gap x JOIN gap y ON x.i = y.i AND x.short = y.short AND length(x.word) = length(y.word) AND x.word <> y.word
  UNION ALL SELECT a, b, bn FROM longer
  UNION ALL SELECT b, a, an FROM longer
),
best AS (
  SELECT a, b, bn, count(*) OVER (PARTITION BY a) AS n_near,
         row_number() OVER (PARTITION BY a ORDER BY bn DESC, b) AS place
  FROM pair
),
formed AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN bn >= 10 * n THEN b END AS form, CASE WHEN bn >= 10 * n THEN bn END AS form_n
  FROM vocab LEFT JOIN (SELECT * FROM best WHERE place = 1) ON a = word
),
way AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL
  SELECT way.word, f.form, step + 1 FROM way JOIN formed f ON f.word = way.root WHERE f.form IS NOT NULL
),
ends AS (SELECT word, arg_max(root, step) AS root FROM way GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""

_NOT_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(table: str) -> str:
    return f"regexp_extract_all(translate({table}.text, '{_UPPER}', '{_LOWER}'), '{_NOT_TERM}')"


OP12 = f"""
WITH item AS (SELECT row_number() OVER () AS item, item_id, {_terms("benchmark")} AS terms FROM benchmark),
doc AS (SELECT row_number() OVER () AS doc, doc_id, {_terms("documents")} AS terms FROM documents),
size AS (SELECT doc, doc_id, len(terms)::BIGINT AS n FROM doc WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM size),
post AS (SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM doc) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2.0 * docs + 2)::DOUBLE / (2.0 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM post, total GROUP BY term, docs
),
asked AS (SELECT item, term, count(*)::BIGINT AS times FROM (SELECT item, unnest(terms) AS term FROM item) GROUP BY ALL),
scored AS (
  SELECT item, doc, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN post USING (term) JOIN size USING (doc), total
  GROUP BY ALL
),
ranked AS (
  SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked JOIN item USING (item) WHERE rank <= 10
"""

OP13 = """
WITH able AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pair AS (
  SELECT q.r, q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(
    list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)
  ))) AS score
  FROM able q JOIN able v ON q.r <> v.r AND len(q.embedding) = len(v.embedding)
  WHERE q.vec_id % 100 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score, vec_id) AS rank FROM pair)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

ORACLE = {"op11_spelling_variants": OP11, "op12_ranked_search": OP12, "op13_nearest_vectors": OP13}
