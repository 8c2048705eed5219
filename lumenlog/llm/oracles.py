"""SQL for the queries that SQL can express, for DuckDB."""

from __future__ import annotations

import re

from . import licenses, quality

BLANKS = r"[^\x20\x09-\x0D]"


def op1() -> str:
    """Measures, sketches, thresholds and verdicts."""
    own = quality
    shift = lambda v: f"greatest(length(bin({v})) - {own.BITS}, 0)"
    cell = lambda v: f"(({v} >> {shift(v)}) << {shift(v)})"
    rate = lambda part, whole: f"CAST(({part}) * 10000 // greatest({whole}, 1) AS BIGINT)"
    rates = ", ".join(f"{rate(part, whole)} AS r_{k}, {rate(f'greatest({part} - CAST(ceil({roots} * sqrt({part})) AS BIGINT), 0)', whole)} AS l_{k}" for k, (part, whole, roots) in own.RULES.items())
    sketch = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, {'r' if k in own.COMMON else 'l'}_{k} AS v FROM m WHERE NOT base_failed" for k in own.RULES)
    verdict = " AND ".join(f"{cell(f'l_{k}')} <= most_{k}" for k in own.RULES)
    return rf"""WITH d AS (SELECT doc_id, coalesce('=' || lang, 'null') AS lang, coalesce('=' || source, 'null') AS source, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, regexp_extract_all(t, '{BLANKS}+') AS words, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{BLANKS}')] AS lines FROM d),
  win AS (SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS window5 FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
  twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, window5) > 1),
  rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
  m0 AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
  m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {rates} FROM m0),
  sk AS (SELECT lang, source, rule, {cell('v')} AS cell, count(*) AS n FROM ({sketch}) GROUP BY ALL),
  og AS (SELECT lang, source, rule, sum(n)::BIGINT AS own FROM sk GROUP BY ALL), lg AS (SELECT lang, rule, sum(own)::BIGINT AS total FROM og GROUP BY ALL), ag AS (SELECT rule, sum(own)::BIGINT AS whole FROM og GROUP BY ALL),
  lc AS (SELECT lang, rule, cell, sum(n)::BIGINT AS n FROM sk GROUP BY ALL), ac AS (SELECT rule, cell, sum(n)::BIGINT AS n FROM sk GROUP BY ALL),
  parts AS (SELECT lang, source, rule, cell, n * {own.PARTS} AS n FROM sk
    UNION ALL SELECT lang, source, rule, cell, {own.PARTS} * least({own.PRIOR}, total) * n // total FROM og JOIN lg USING (lang, rule) JOIN lc USING (lang, rule)
    UNION ALL SELECT og.lang, source, og.rule, cell, {own.PARTS} * ({own.PRIOR} - total) * n // whole FROM og JOIN lg USING (lang, rule) JOIN ag USING (rule) JOIN ac USING (rule) WHERE total < {own.PRIOR}),
  mc AS (SELECT lang, source, rule, cell, sum(sum(n)) OVER (PARTITION BY lang, source, rule ORDER BY cell) AS seen, sum(sum(n)) OVER (PARTITION BY lang, source, rule) AS in_all, coalesce(sum(sum(n) FILTER (cell = 0)) OVER (PARTITION BY lang, source, rule), 0) AS none FROM parts GROUP BY lang, source, rule, cell),
  q AS (SELECT lang, source, rule, min(cell) FILTER (seen * 100 >= in_all * 50) AS middle, min(cell) FILTER (seen * 100 >= in_all * {own.PERCENT}) AS upper_, min(cell) FILTER (cell > 0 AND (in_all - none) * 100 >= in_all * {own.LEAST} AND (seen - none) * 100 >= (in_all - none) * {own.RARE}) AS rare FROM mc GROUP BY ALL),
  g AS (SELECT lang, source, {', '.join(f"max(CASE WHEN upper_ > 0 THEN upper_ + {own.STRETCH} * (upper_ - middle) ELSE coalesce(rare - 1, {own.OFF}) END) FILTER (rule = '{k}') AS most_{k}" for k in own.RULES)} FROM q GROUP BY lang, source)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {verdict} AS kept FROM m LEFT JOIN g USING (lang, source)"""


def op7(width: int = 2, percent: int = 80) -> str:
    """All pairs that share a shingle, then the smallest id reachable."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BLANKS}+') AS words FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + {width - 1}], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - {width - 2}))) AS i FROM w WHERE len(words) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
    WHERE 100 * least(na.n, nb.n) >= {percent} * greatest(na.n, nb.n) GROUP BY a.doc_id, b.doc_id),
  e AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * both_ >= {percent} * (na.n + nb.n - both_)),
  both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
  reach AS (SELECT DISTINCT x AS doc_id, x AS other FROM both_ways UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.other),
  c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
  SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id"""


def op8() -> str:
    """Grams joined with template positions, votes by diagonal, bands, labels."""
    rows, number = [], 0
    for texts, k in ((licenses.PHRASES, licenses.PHRASE_GRAM), (licenses.NOTICES, licenses.NOTICE_GRAM)):
        for text, label in texts.items():
            words = re.sub(licenses.SEPARATORS, " ", text.lower()).split()
            grams = len(words) - k + 1
            rows += [f"('{' '.join(words[i : i + k])}', {k}, {number}, '{label}', {i}, {grams})" for i in range(grams)]
            number += 1
    found = f"(t.k = {licenses.PHRASE_GRAM} AND votes = grams)"
    notice = f"(t.k = {licenses.NOTICE_GRAM} AND share >= {licenses.FOUND})"
    label = lambda test: f"coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER ({test.replace('t.', '')}))), ','), '')"
    return rf"""WITH tp(gram, k, template, label, place, grams) AS (VALUES {', '.join(rows)}),
  w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
  pos AS (SELECT doc_id, words, unnest(range(len(words))) AS p FROM w),
  g AS (SELECT doc_id, p, k, array_to_string(words[p + 1 : p + k], ' ') AS gram FROM pos, (VALUES ({licenses.PHRASE_GRAM}), ({licenses.NOTICE_GRAM})) ks(k)),
  dg AS (SELECT doc_id, template, g.k, label, grams, p - place AS diagonal, count(*) AS votes, min(p) AS lo, max(p) AS hi FROM g JOIN tp ON tp.gram = g.gram AND tp.k = g.k GROUP BY ALL),
  b0 AS (SELECT *, CASE WHEN k = {licenses.NOTICE_GRAM} AND diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {licenses.GAP} THEN 0 ELSE 1 END AS begins FROM dg),
  b1 AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS band FROM b0),
  b2 AS (SELECT doc_id, template, k, label, grams, band, sum(votes) AS votes, min(diagonal) AS diagonal, max(hi) - min(lo) AS span FROM b1 GROUP BY ALL),
  b AS (SELECT *, CASE WHEN span <= 2 * grams THEN least(votes / grams, 1.0) END AS share FROM b2),
  r AS (SELECT doc_id, count(*) FILTER ({found.replace('t.', '')}) AS n_base, min(diagonal) FILTER ({found.replace('t.', '')}) AS first_word, max(diagonal) FILTER ({found.replace('t.', '')}) AS last_word,
    {label(found)} AS base_labels, {label(found + ' OR ' + notice)} AS labels, coalesce(max(share), 0.0) AS score FROM b GROUP BY doc_id)
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM w LEFT JOIN r ON r.doc_id = w.doc_id"""


FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
SQUARES = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
FLOOR = "(s - ((s % n) + n) % n) // n"


def op11(parts: int = 8, entries: int = 16, scale: int = 4096, rounds: int = 6) -> str:
    """Every part against every entry, a round a step."""
    steps = ""
    for k in range(rounds + 1):
        steps += f"""a{k} AS MATERIALIZED (SELECT v.r, v.part, min(struct_pack(d := CAST({SQUARES} AS BIGINT), e := c.e)) AS m FROM v JOIN c{k} c ON c.part = v.part GROUP BY v.r, v.part),
"""
        if k < rounds:
            steps += f"""c{k + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(f.q, c.q) AS q FROM c{k} c LEFT JOIN (SELECT part, e, list(CAST({FLOOR} AS BIGINT) ORDER BY i) AS q FROM (SELECT v.part, a.m.e AS e, i, sum(v.q[i]) AS s, count(*) AS n FROM v JOIN a{k} a ON a.r = v.r AND a.part = v.part, (SELECT unnest(range(1, len(v.q) + 1)) AS i) GROUP BY v.part, a.m.e, i) GROUP BY part, e) f ON f.part = c.part AND f.e = c.e),
"""
    return f"""WITH u AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings WHERE {FINITE}),
v AS MATERIALIZED (SELECT r, vec_id, part, p[part * (len(p) // {parts}) + 1 : (part + 1) * (len(p) // {parts})] AS q FROM u, (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, e, q FROM (SELECT part, q, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM v) WHERE e < {entries}),
{steps}t AS (SELECT r, string_agg(lower(printf('%02x', m.e)), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, e)) AS sha FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM u JOIN t ON t.r = u.r, s"""


def op12(window: int = 10) -> str:
    """Windows of items joined with all runs of as many words of documents."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""WITH b AS (SELECT item_id, {words} AS words FROM benchmark),
  iw AS MATERIALIZED (SELECT DISTINCT item_id, least(len(words), {window}) AS size, array_to_string(words[i : i + least(len(words), {window}) - 1], ' ') AS w FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - {window}, 0) + 2)) AS i FROM b WHERE len(words) > 0)),
  d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
  dw AS (SELECT r, i, size, array_to_string(words[i : i + size - 1], ' ') AS w FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM iw) WHERE len(words) >= size)),
  m AS MATERIALIZED (SELECT dw.r, dw.i, dw.size, iw.item_id FROM dw JOIN iw ON iw.w = dw.w AND iw.size = dw.size),
  h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM m)) GROUP BY r),
  n AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY r)
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN n ON n.r = d.r"""


def op13(size: int = 64, k: int = 8, scale: int = 1024, rounds: int = 10, seed: int = 3) -> str:
    """Every vector against every centroid, a round a step."""
    steps = ""
    for turn in range(rounds + 1):
        steps += f"""a{turn} AS MATERIALIZED (SELECT v.r, min(struct_pack(d := CAST({SQUARES} AS BIGINT), e := c.e)) AS m FROM v, c{turn} c GROUP BY v.r),
"""
        if turn < rounds:
            steps += f"""c{turn + 1} AS MATERIALIZED (SELECT c.e, coalesce(f.q, c.q) AS q FROM c{turn} c LEFT JOIN (SELECT e, list(CAST({FLOOR} AS BIGINT) ORDER BY i) AS q FROM (SELECT a.m.e AS e, i, sum(v.q[i]) AS s, count(*) AS n FROM v JOIN a{turn} a ON a.r = v.r, (SELECT unnest(range(1, {size + 1})) AS i) GROUP BY a.m.e, i) GROUP BY e) f ON f.e = c.e),
"""
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {size} AND {FINITE}),
c0 AS MATERIALIZED (SELECT e, q FROM (SELECT q, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS e FROM v) WHERE e < {k}),
{steps}s AS (SELECT e, sha256(array_to_string(q, ',')) AS sha FROM c{rounds})
SELECT vec_id, CAST(m.e AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.e) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256 FROM v JOIN a{rounds} a ON a.r = v.r JOIN s ON s.e = a.m.e"""
