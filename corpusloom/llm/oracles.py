"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from corpusloom.llm.licenses import BLOCK, MARK, TEMPLATES

OP10_RULE_CASCADE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), places AS (
  SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3
), windows AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM places
), repeated AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) > 1
), covered AS (
  SELECT rid, count(DISTINCT place) AS n
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM repeated) GROUP BY rid
), m AS (
  SELECT doc_id, len(words) AS n_words,
         coalesce(CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars > 30 * n_words
            OR word_chars < 2 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM f
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({i}, {_quoted(name)}, {_quoted(t)})" for i, (name, t) in enumerate(TEMPLATES))
_CUES = "(?i)licen[cs]|copyright|copyleft|public domain|rights reserved|spdx|hereby granted|redistribution"
_TERM = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"

OP4_LICENSES = rf"""
WITH files AS (
  SELECT doc_id, text,
         CASE WHEN doc_id % 20 = 0 THEN coalesce(source, '') || '/LICENSE-' || doc_id
              WHEN doc_id % 20 = 1 THEN concat_ws('/', source, lang, CAST(doc_id % 1000 - doc_id % 100 AS VARCHAR)) || '/LICENSE-' || doc_id
              ELSE concat_ws('/', source, lang, CAST(doc_id % 1000 - doc_id % 100 AS VARCHAR)) || '/' || doc_id || '.txt' END AS path
  FROM documents
), dirs AS (
  SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS directory,
         path LIKE '%/LICENSE-%' AS is_licence, text FROM files
), passages AS (
  SELECT path, line FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM files)
  WHERE regexp_matches(line, '{_CUES}')
  UNION ALL
  SELECT path, line FROM (
    SELECT path, regexp_replace(regexp_replace(unnest(regexp_extract_all(text, '{BLOCK}')), '(?m)^{MARK}', ' ', 'g'),
                                chr(10), ' ', 'g') AS line
    FROM files WHERE regexp_matches(text, '{_CUES}'))
  WHERE regexp_matches(line, '{_CUES}')
  UNION ALL
  SELECT path, text AS line FROM dirs WHERE is_licence AND text IS NOT NULL
), texts AS (
  SELECT line, count(*) AS times FROM passages GROUP BY line
), terms AS (
  SELECT line, times, term, count(*) AS tf
  FROM (SELECT line, times, unnest(regexp_extract_all(lower(line), '{_TERM}')) AS term FROM texts)
  GROUP BY ALL
), total AS (
  SELECT coalesce(sum(times), 0) AS n FROM texts
), rarity AS (
  SELECT term, ln((1 + n) / (1 + sum(times))) + 1 AS idf FROM terms, total GROUP BY term, n
), weighted AS (
  SELECT line, term, tf * idf AS weight FROM terms JOIN rarity USING (term)
), norms AS (
  SELECT line, sqrt(sum(weight * weight)) AS norm FROM weighted GROUP BY line
), wording(template, license, wording) AS (VALUES {_TEMPLATES}
), own AS (
  SELECT template, license, term, tf * coalesce(idf, ln(1 + n) + 1) AS other
  FROM (SELECT template, license, term, count(*) AS tf
        FROM (SELECT template, license, unnest(regexp_extract_all(lower(wording), '{_TERM}')) AS term FROM wording)
        GROUP BY ALL) LEFT JOIN rarity USING (term), total
), lengths AS (
  SELECT template, sqrt(sum(other * other)) AS length FROM own GROUP BY template
), dots AS (
  SELECT line, template, license, sum(weight * other / length) AS dot
  FROM weighted JOIN own USING (term) JOIN lengths USING (template) GROUP BY ALL
), scored AS (
  SELECT line, license, round(dot / norm, 6) AS score FROM dots JOIN norms USING (line)
), best AS (
  SELECT line, license, score FROM scored
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license) = 1
), named AS (
  SELECT path, license AS own_license, score FROM passages JOIN best USING (line) WHERE score >= 0.7
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1
), speaking AS (
  SELECT DISTINCT directory AS place, own_license AS license, score FROM dirs JOIN named USING (path) WHERE is_licence
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY score DESC, own_license) = 1
), nearest AS (
  SELECT directory, place AS from_directory, license
  FROM (SELECT DISTINCT directory FROM dirs) JOIN speaking
    ON directory = place OR starts_with(directory, place || '/') OR place = ''
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY length(place) DESC) = 1
)
SELECT doc_id, path, own_license, score, coalesce(own_license, license) AS license,
       CASE WHEN own_license IS NULL THEN from_directory END AS inherited_from
FROM dirs LEFT JOIN named USING (path) LEFT JOIN nearest USING (directory)
"""

OP12_HARD_NEGATIVES = r"""
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM sound a JOIN sound r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

OP13_WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), named AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
           (CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT
         ) + 1, 1)), '') AS payload_digest,
         min(page_id) OVER (PARTITION BY payload) AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM named
"""

ORACLES: dict[str, str] = {
    "op4_licenses": OP4_LICENSES,
    "op10_rule_cascade": OP10_RULE_CASCADE,
    "op12_hard_negatives": OP12_HARD_NEGATIVES,
    "op13_warc": OP13_WARC,
}
