"""DuckDB SQL of the operators that SQL can express; constants come from the operators.

Not expressible: op1 (span positions of regular expressions), op4 (the encoder), op5 and op10
(fitted models), op7 (CRC-32), op9 (min-hash windows). These are tested against brute force.
"""

from __future__ import annotations

from . import mixing, ngram_join, quality_rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BLANK = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _list(items) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + "]"


EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

MIX = f"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
         (('0x' || left(md5('0:' || coalesce(doc_id::VARCHAR, '')), 12))::BIGINT + 0.5) / {2**48}.0 AS u,
         CASE WHEN length(coalesce(text, '')) = 0 THEN 1.0 ELSE greatest({mixing.LEAST_QUALITY}, 1.0 - 5.0 * (length(text) - length(translate(text, '#*$%&|<>!', ''))) / length(text)) END AS q
  FROM documents
), z AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sidx FROM d GROUP BY source
), w AS (
  SELECT *, [{', '.join(map(str, mixing.WEIGHTS))}][sidx % {len(mixing.WEIGHTS)} + 1] AS weight FROM z
), r AS (
  SELECT *, {mixing.CAP} * source_size / weight AS ratio,
         ({mixing.SHARE} * sum(source_size) OVER () - {mixing.CAP} * coalesce(sum(source_size) OVER (ORDER BY {mixing.CAP} * source_size / weight, sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY {mixing.CAP} * source_size / weight, sidx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, round(least({mixing.CAP} * source_size, (SELECT arg_min(level, (ratio, sidx)) FROM r WHERE level <= ratio) * weight), 6) AS target FROM r
), k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM k)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM e
"""

JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w
), x AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {ngram_join.PERCENT} * (max(a.n) + max(b.n) - count(*))
), l AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), c AS (
  SELECT doc_id, doc_id AS r FROM s UNION SELECT l.b, c.r FROM c JOIN l ON c.doc_id = l.a
)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id) USING (doc_id)
"""

_Q = quality_rules
RULES = f"""
WITH f AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents
), c AS (
  SELECT *, length(t) AS chars, length(t) - length(translate(t, {_BLANK}, '')) AS space, length(t) - length(translate(t, '#*$%&|<>', '')) AS symbols,
         length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS low, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS up, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digit,
         length(t) - length(translate(t, '.,;:!?''"()-', '')) AS punct,
         list_filter(string_split(t, chr(10)), lambda y: length(translate(y, {_BLANK}, '')) > 0) AS lines,
         list_transform(list_filter(w, lambda y: list_contains({_list(_Q.WRITTEN)}, y)), lambda y: lower(y)) AS hits
  FROM f
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, d) AS n FROM (SELECT doc_id, i, w[i] AS a, w[i+1] AS b, w[i+2] AS d FROM f, unnest(range(1, len(w) - 1)) u(i))
), rep AS (
  SELECT doc_id, sum(least(3, i - prev))::BIGINT AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -3) AS prev FROM g WHERE n > 1) GROUP BY doc_id
), h AS (
  SELECT doc_id, lang, chars, len(w) AS n_words, [low, up, digit, space, punct, symbols, chars - low - up - digit - space - punct - symbols] AS ch,
         list_transform({_list(_Q.ALL_COMMON)}, lambda k: len(list_filter(hits, lambda y: y = k))) || [len(w) - len(hits)] AS wh,
         chars - space AS word_chars, symbols, len(lines) - len(list_distinct(lines)) AS dups
  FROM c
), cu AS (
  SELECT doc_id, lang, chars, k, ch[k] AS v FROM h, range(1, {len(_Q.CLASSES) + 1}) u(k)
), cr AS (SELECT lang, k, sum(v) / greatest(sum(sum(v)) OVER (PARTITION BY lang), 1) AS q FROM cu GROUP BY lang, k),
wu AS (
  SELECT doc_id, lang, n_words, k, wh[k] AS v FROM h, range(1, {len(_Q.ALL_COMMON) + 2}) u(k)
), wr AS (SELECT lang, k, sum(v) / greatest(sum(sum(v)) OVER (PARTITION BY lang), 1) AS q FROM wu GROUP BY lang, k),
js AS (
  SELECT 'c' AS kind, cu.doc_id, v / greatest(chars, 1) AS p, q FROM cu JOIN cr ON cu.k = cr.k AND cu.lang IS NOT DISTINCT FROM cr.lang
  UNION ALL SELECT 'w', wu.doc_id, v / greatest(n_words, 1), q FROM wu JOIN wr ON wu.k = wr.k AND wu.lang IS NOT DISTINCT FROM wr.lang
), jd AS (
  SELECT doc_id, kind, round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)), 6) AS d FROM js GROUP BY doc_id, kind
), o AS (
  SELECT h.*, coalesce(rep.n, 0) AS n_repeat_words, jc.d AS char_distance, jw.d AS word_distance
  FROM h LEFT JOIN rep USING (doc_id) JOIN jd jc ON jc.doc_id = h.doc_id AND jc.kind = 'c' JOIN jd jw ON jw.doc_id = h.doc_id AND jw.kind = 'w'
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines, n_repeat_words,
       (n_words < {_Q.BASE_MIN_WORDS} OR 100 * n_repeat_words > {_Q.BASE_MAX_REPEAT} * n_words) AS base_failed,
       NOT (n_words < {_Q.BASE_MIN_WORDS} OR 100 * n_repeat_words > {_Q.BASE_MAX_REPEAT} * n_words)
         AND NOT ((chars >= {_Q.MIN_CHARS} AND char_distance > {_Q.MAX_CHAR_DISTANCE}) OR (n_words >= {_Q.MIN_WORDS} AND word_distance > {_Q.MAX_WORD_DISTANCE})) AS kept,
       char_distance, word_distance
FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": MIX, "op3_ngram_join": JACCARD, "op6_quality_rules": RULES, "op8_exact_dedup": EXACT_DEDUP}
