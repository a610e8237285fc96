"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from logstream.llm import licenses

QUALITY = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS phrase
  FROM docs, unnest(range(1, len(words) - 1)) AS u(i)),
repeats AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, phrase) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n
  FROM repeats, unnest([0, 1, 2]) AS u(j) GROUP BY doc_id),
lines AS (
  SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM docs),
doubled AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, len(words) AS n_words,
    CAST(length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(doubled.n, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words
  FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN doubled USING (doc_id)),
ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed
  FROM ruled WHERE source IS NOT NULL GROUP BY source),
spread AS (
  SELECT m, avg((failed / n - m) * (failed / n - m)) - m * (1 - m) * avg(1 / n) AS between_hosts
  FROM hosts, (SELECT sum(failed) / sum(n) AS m FROM hosts) GROUP BY m),
prior AS (
  SELECT m, CASE WHEN between_hosts > 0
    THEN least(greatest(m * (1 - m) / between_hosts - 1, 1.0), 1e6) ELSE 1e6 END AS weight
  FROM spread),
rated AS (
  SELECT source, n + weight AS total, (failed + m * weight) / (n + weight) AS rate
  FROM hosts, prior),
rejected AS (
  SELECT source FROM rated
  WHERE rate - 1.645 * sqrt(rate * (1 - rate) / (total + 1)) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM rejected)) AS kept
FROM ruled
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
items AS (SELECT item_id, {_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size,
    array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS phrase
  FROM items, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS u(i)
  WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, i, size, array_to_string(words[i : i + size - 1], ' ') AS phrase
  FROM docs, sizes, unnest(range(1, len(words) - size + 2)) AS u(i)),
hits AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, phrase)),
hit_words AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, size)) AS u(j)
  GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

WARC = r"""
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
    sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT hex, min(page_id) AS first FROM payloads GROUP BY hex)
SELECT page_id, payload_bytes,
  array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
      (strpos('0123456789abcdef', substr(hex || '00', 1 + (5 * i) // 4, 1)) - 1) * 16 +
      (strpos('0123456789abcdef', substr(hex || '00', 2 + (5 * i) // 4, 1)) - 1)
    ) >> (3 - (5 * i) % 4)) % 32, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM payloads JOIN firsts USING (hex)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id,
    array_to_string(words[i : i + least(len(words), 5) - 1], ' ') AS shingle
  FROM docs, unnest(range(1, len(words) - least(len(words), 5) + 2)) AS u(i)
  WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have
  FROM shingles AS a JOIN shingles AS b USING (shingle) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b
  WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
reached AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other),
roots AS (SELECT doc_id, min(other) AS smallest FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles,
  least(doc_id, coalesce(smallest, doc_id)) AS component_id,
  least(doc_id, coalesce(smallest, doc_id)) = doc_id AS kept
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)
"""

# Marks of the chat template, and anything like one of its control strings.
_LIKE_CONTROL = (
    r"<\\*<SYS>>|<\\*</SYS>>|\[\\*INST\]|\[\\*/INST\]|<\\*s>|<\\*/s>|\[\\*TURN\]|\[\\*/TURN\]|\[\\*AS\]"
)

CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(body)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(body, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + len(regexp_extract_all(body, '{_LIKE_CONTROL}'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 17 + length(role) + len(regexp_extract_all(role, '{_LIKE_CONTROL}')) END) AS BIGINT)
    AS formatted_chars
FROM turns GROUP BY conv_id
"""

_TEMPLATES = ",\n".join(
    f"({number}, '{one.label}', {str(one.base).lower()}, '{one.words}')"
    for number, one in enumerate(licenses.TEMPLATES)
)

LICENSES = rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
templates AS (
  SELECT template, label, base, string_split(phrase, ' ') AS own
  FROM (VALUES {_TEMPLATES}) AS t(template, label, base, phrase)),
pairs AS (
  SELECT template, label, base, len(own) - 1 AS pairs, i AS place, own[i + 1] AS a, own[i + 2] AS b
  FROM templates, unnest(range(0, len(own) - 1)) AS u(i)),
found AS (
  SELECT doc_id, i AS start, words[i + 1] AS a, words[i + 2] AS b
  FROM docs, unnest(range(0, len(words) - 1)) AS u(i)),
votes AS (
  SELECT doc_id, template, label, base, pairs, start - place AS diagonal,
    list(DISTINCT place) AS places
  FROM found JOIN pairs USING (a, b) GROUP BY ALL),
exact AS (
  SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word
  FROM votes WHERE base AND len(places) = pairs GROUP BY doc_id),
stepped AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= {licenses.GAP} THEN 0 ELSE 1 END AS apart
  FROM votes WHERE NOT base WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
passages AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS passage FROM stepped),
covers AS (
  SELECT p.doc_id, p.label, len(list_distinct(flatten(list(q.places)))) / any_value(p.pairs) AS cover
  FROM passages p JOIN passages q
    ON q.doc_id = p.doc_id AND q.template = p.template AND q.passage = p.passage
    AND q.diagonal >= p.diagonal
    AND q.diagonal - p.diagonal + p.pairs + 1 <= (p.pairs + 1) / {licenses.LEAST_COVER}
  GROUP BY p.doc_id, p.label, p.template, p.diagonal),
named AS (
  SELECT doc_id, label, true AS base, CAST(1 AS DOUBLE) AS cover
  FROM votes WHERE base AND len(places) = pairs
  UNION ALL SELECT doc_id, label, false, cover FROM covers),
told AS (
  SELECT doc_id, max(cover) AS score,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label)
      FILTER (base OR cover >= {licenses.LEAST_COVER}), '') AS labels
  FROM named GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM docs LEFT JOIN exact USING (doc_id) LEFT JOIN told USING (doc_id)
"""

HARD_NEGATIVES = """
WITH vectors AS (
  SELECT vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS other_id, a.label = v.label AS same,
    CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score
  FROM vectors a, vectors v WHERE a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10
"""
