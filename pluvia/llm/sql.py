"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from pluvia.llm.shared import LOWER, UPPER

EXACT_DEDUP = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""

WARC = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, url, n AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

QUALITY = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, words[i : i + 7] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d)
), found AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM found, range(8) t(k) WHERE n > 1 GROUP BY doc_id
), base AS (
  SELECT d.doc_id, text, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         len(regexp_extract_all(text, '\p{L}')) AS letters,
         len(regexp_extract_all(text, '\p{Lu}')) AS capitals,
         len(regexp_extract_all(text, '[!?]')) AS shouts,
         len(string_split(text, chr(10))) AS n_lines
  FROM base
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT 10 * n_symbols > 2 * n_words AND NOT word_chars < 2 * n_words
         AND NOT word_chars > 20 * n_words AND NOT 2 * capitals > letters
         AND NOT 2 * letters < word_chars AND NOT 2 * shouts > n_words
         AND NOT 100 * n_dup_lines > 50 * n_lines AS kept
FROM judged
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, words[i : i + 4] AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM d)
  WHERE len(words) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.b) AS component_id,
       d.doc_id = min(r.b) AS kept
FROM d LEFT JOIN sizes s USING (doc_id) JOIN reached r ON r.a = d.doc_id GROUP BY d.doc_id
"""

HARD_NEGATIVES = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
)
SELECT anchor AS anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY anchor, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n USING (anchor)
WHERE NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""

SUBSTRING_DEDUP = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, words[i : i + 12] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)
), judged AS (
  SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY win) AS gone FROM windows
), covered AS (
  SELECT doc_id, list(DISTINCT i + k) AS places FROM judged, range(13) t(k) WHERE gone GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
         CASE WHEN places IS NULL THEN words
              ELSE [words[j] FOR j IN range(1, len(words) + 1) IF NOT list_contains(places, j)]
         END AS rest
  FROM d LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(rest, ' ')) AS kept_sha256
FROM kept
"""


def statements() -> dict[str, str]:
    return {
        "op4_warc": WARC,
        "op6_quality_rules": QUALITY,
        "op9_near_dedup": NEAR_DEDUP,
        "op10_exact_dedup": EXACT_DEDUP,
        "op11_hard_negatives": HARD_NEGATIVES,
        "op12_substring_dedup": SUBSTRING_DEDUP,
    }
