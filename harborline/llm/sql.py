"""The same results in plain SQL, for the queries that SQL can express."""

SQL = {
    "op3_chat_rotation": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
         coalesce(CAST(floor(turn / 64) AS BIGINT), -1) AS part
  FROM conversations),
views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
lines AS (
  SELECT s.conv_id, perspective, part, turn, speaker, text, speaker = perspective AS own,
         '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
           ELSE 'user name=' || speaker END || chr(10) AS head,
         text || '<|im_end|>' || chr(10) AS body
  FROM said s JOIN views v ON s.conv_id IS NOT DISTINCT FROM v.conv_id),
ends AS (
  SELECT *, sum(length(head) + length(body)) OVER w AS ending, row_number() OVER w AS place
  FROM lines WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, part, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY place) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN CAST(CAST(ending - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(ending AS BIGINT) AS VARCHAR) END,
                           ';' ORDER BY place), '') AS mask,
       CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS BIGINT) AS trained_chars
FROM ends GROUP BY ALL""",
    "op4_source_mixing": r"""
WITH measured AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM measured GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight, 2 * source_size AS most FROM sizes),
ends AS (SELECT *, most / weight AS ends_at, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM weighted),
levels AS (
  SELECT *, (budget - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM ends WINDOW w AS (ORDER BY ends_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
reached AS (SELECT arg_min(level, ends_at) AS level FROM levels WHERE level < ends_at),
plan AS (
  SELECT e.source, source_size, weight, CAST(floor(budget) AS BIGINT) AS budget,
         CASE WHEN r.level IS NULL OR ends_at <= r.level THEN CAST(most AS DOUBLE) ELSE weight * r.level END AS target
  FROM ends e CROSS JOIN reached r),
queued AS (
  SELECT m.source, key, doc_id, size, turn, budget,
         (turn * source_size + sum(size) OVER (PARTITION BY m.source, turn ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)) / weight AS finish
  FROM measured m JOIN plan p ON m.source IS NOT DISTINCT FROM p.source CROSS JOIN (VALUES (0), (1)) t(turn)),
run AS (
  SELECT *, sum(size) OVER (ORDER BY finish, turn, source NULLS LAST, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM queued),
times AS (SELECT doc_id, source, key, size, count(DISTINCT turn) AS times FROM run WHERE upto <= budget GROUP BY ALL)
SELECT m.doc_id, CAST(m.size AS BIGINT) AS size, source_size, target, CAST(m.size * coalesce(times, 0) AS BIGINT) AS taken
FROM measured m JOIN plan p ON m.source IS NOT DISTINCT FROM p.source
LEFT JOIN times t ON m.source IS NOT DISTINCT FROM t.source AND m.key = t.key AND m.doc_id IS NOT DISTINCT FROM t.doc_id AND m.size = t.size""",
    "op13_phrase_collocations": r"""
WITH lowered AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM words, (VALUES (1), (2), (3), (4), (5)) s(size)),
counts AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM places GROUP BY ALL HAVING count(*) >= 100),
split AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size >= 2),
parts AS (
  SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(f) AS longer
  FROM split, generate_series(1, 5) a(i), generate_series(1, 5) b(j) WHERE i < j AND j <= size AND j - i + 1 < size GROUP BY ALL),
kept AS (SELECT s.* FROM split s LEFT JOIN parts p USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * f),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM kept, generate_series(1, 4) c(k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n,
         (1000::HUGEINT * a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cuts c JOIN counts x ON c.lang = x.lang AND c.first = x.phrase JOIN counts y ON c.lang = y.lang AND c.rest = y.phrase
  JOIN totals t ON c.lang = t.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000""",
}
