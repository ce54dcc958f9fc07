"""DuckDB SQL for the queries that SQL can express."""

QUALITY_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), u AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), g AS (
  SELECT r, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS gram FROM u WINDOW p AS (PARTITION BY r ORDER BY i)
), k AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g WHERE gram IS NOT NULL
), c AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM k WHERE n > 1) GROUP BY r
), l AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), ll AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT d.r, doc_id, host, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN ll USING (r) LEFT JOIN c USING (r)
), s AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    (10 * n_symbols > n_words)::INT + (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
      + (10 * n_dup_lines > 3 * n_lines)::INT + (10 * n_repeat_words > 3 * n_words)::INT AS n_soft
  FROM m
), h AS (
  SELECT host, count(*) AS n, sum((base_failed OR n_soft > 0)::INT) AS n_failed FROM s GROUP BY host
), p AS (
  SELECT sum(n_failed) / sum(n) AS m, var_pop(n_failed / n) AS spread, avg(1 / n) AS noise FROM h
), q AS (
  SELECT m, CASE WHEN spread - m * (1 - m) * noise > 0
    THEN least(10000.0, greatest(1.0, m * (1 - m) / (spread - m * (1 - m) * noise) - 1)) ELSE 10000.0 END AS s FROM p
), v AS (
  SELECT host, round((n_failed + m * s) / (n + s), 6) AS host_rate FROM h, q
), x AS (
  SELECT *, CASE WHEN host_rate >= 0.8 THEN 'block' WHEN host_rate >= 0.3 THEN 'watch' ELSE 'pass' END AS host_verdict FROM v
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (host_verdict = 'block' OR host_verdict = 'watch' AND n_soft > 0) AS kept,
  n_soft, host_rate, host_verdict
FROM s JOIN x USING (host)
"""

CHAT_FORMATTING = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '<r>', '<\r>'),
      '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS body,
    length(replace(replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '<r>', '<\r>'),
      '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), chr(10), '<\n>')) AS head
  FROM c
), o AS (
  SELECT *, row_number() OVER p - 1 AS i, (length(text) + 3) // 4 + 1 AS n,
    coalesce(sum((length(text) + 3) // 4 + 1) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM e WINDOW p AS (PARTITION BY conv_id ORDER BY turn, role, text)
), y AS (
  SELECT *, coalesce(max(n) FILTER (i = 0 AND role = 'system') OVER (PARTITION BY conv_id), 0) AS n_system FROM o
), t AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY before // half, 2 * longs - long) AS w FROM (
    SELECT *, (n > half)::INT AS long, sum((n > half)::INT) OVER (PARTITION BY conv_id ORDER BY i) AS longs FROM (SELECT *, greatest(1, floor((512 - n_system) / 2)::BIGINT) AS half FROM y))
), f AS (
  SELECT conv_id, w, min(i) AS i0, min(before) AS b0, sum(n) AS n_new FROM t GROUP BY conv_id, w
), n AS (
  SELECT t.conv_id, sum(4 + head + body + 4) AS formatted_chars
  FROM t JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id
    AND (t.w = f.w OR t.w < f.w AND (t.i >= f.i0 - 2 AND n_system + b0 - t.before + n_new <= 512 OR t.i = 0 AND t.role = 'system'))
  GROUP BY t.conv_id
)
SELECT t.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  any_value(formatted_chars)::BIGINT AS formatted_chars
FROM t JOIN n ON n.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY t.conv_id
"""

JACCARD_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2)::BIGINT)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) USING (doc_id)
"""

TOP_K = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
), k AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""

MERKLE_MANIFEST = r"""
WITH RECURSIVE e AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    4294967295 - list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM documents
), f AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL
      THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS tampered
  FROM e
), g AS (
  SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS r,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM f
), t AS (
  SELECT lang, 0 AS l, i, n, leaf AS h FROM g
  UNION ALL
  SELECT lang, l + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, l, i // 2
), s AS (
  SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h AS subroot FROM t WHERE n = 1
), u AS (
  SELECT 0 AS l, i, n, subroot AS h FROM s
  UNION ALL
  SELECT l + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY l, i // 2
), c AS (
  SELECT r, lang, 0 AS l, i, n, '' AS proof, coalesce(tampered, leaf) AS folded FROM g
  UNION ALL
  SELECT c.r, c.lang, c.l + 1, c.i // 2, (c.n + 1) // 2, c.proof || coalesce(t.h, ''),
    sha256(CASE WHEN c.i % 2 = 1 THEN coalesce(t.h, '') || c.folded ELSE c.folded || coalesce(t.h, '') END)
  FROM c LEFT JOIN t ON t.lang IS NOT DISTINCT FROM c.lang AND t.l = c.l AND t.i = xor(c.i, 1) WHERE c.n > 1
), p AS (
  SELECT c.r, s.subroot, 0 AS l, s.i, s.n, c.proof, c.folded FROM c JOIN s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT p.r, p.subroot, p.l + 1, p.i // 2, (p.n + 1) // 2, p.proof || coalesce(u.h, ''),
    sha256(CASE WHEN p.i % 2 = 1 THEN coalesce(u.h, '') || p.folded ELSE p.folded || coalesce(u.h, '') END)
  FROM p LEFT JOIN u ON u.l = p.l AND u.i = xor(p.i, 1) WHERE p.n > 1
)
SELECT g.doc_id, g.leaf, p.subroot, u.h AS root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root, p.folded = u.h AS verified
FROM g JOIN p ON p.r = g.r AND p.n = 1 JOIN u ON u.n = 1
"""

CONVERSATION_REPAIR = r"""
WITH RECURSIVE b AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), k AS (
  SELECT *, (4294967295 - list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(name, '.'), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS kind
  FROM b
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE kind <> 0
), o AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS c, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS solid,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM d
), f AS (
  SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM o
), z AS (
  SELECT * FROM (VALUES ('', '', '', 'u'), ('', 'I', 'u', 'a'), ('', 'II', 'a', 'u'), ('s', '', 's', 'u'), ('s', 'I', 'u', 'a'), ('s', 'II', 'a', 'u'),
    ('u', '', 'u', 'a'), ('u', 'I', 'a', 'u'), ('a', '', 'a', 'u'), ('a', 'I', 'u', 'a')) AS x(s, inserts, place, next)
), e AS (
  SELECT s, inserts || 'D' AS edit, place AS t, 4 + 3 * length(inserts) AS cost, 'D' AS kind FROM z
  UNION ALL SELECT s, inserts || 'R', next, 3 + 3 * length(inserts), 'R' FROM z
  UNION ALL SELECT s, inserts || 'K', next, 3 * length(inserts), 'K' FROM z
  UNION ALL SELECT s, inserts || 'K', 's', 3 * length(inserts), 'K' FROM z WHERE place = ''
), v AS (
  SELECT conv_id, n + 1 AS i, s, {'cost': cost, 'audit': audit} AS best
  FROM (SELECT DISTINCT conv_id, n FROM o), (VALUES ('', 0, ''), ('s', 6, 'II'), ('u', 3, 'I'), ('a', 0, '')) AS x(s, cost, audit)
  UNION ALL
  SELECT v.conv_id, f.i, e.s,
    min({'cost': v.best.cost + e.cost + CASE WHEN f.fault = 'truncated' AND e.kind <> 'D' THEN 3 ELSE 0 END, 'audit': e.edit || v.best.audit})
  FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i - 1 JOIN e ON e.t = v.s
  WHERE e.kind = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (e.kind = 'R' OR f.c = e.t)
  GROUP BY v.conv_id, f.i, e.s
), a AS (
  SELECT conv_id, best.cost AS cost, best.audit AS audit FROM v WHERE i = 1 AND s = ''
), l AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS place FROM a WHERE audit <> ''
), m AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS j FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY place)
), r AS (
  SELECT m.conv_id, m.place, m.letter, m.j, f.role, f.text,
    max((m.letter = 'K' AND m.j = 1 AND f.c = 's')::INT) OVER (PARTITION BY m.conv_id) AS has_system
  FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i WHERE m.letter <> 'D'
), h AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS repaired_sha256
  FROM r GROUP BY conv_id
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""

SPOT_FINGERPRINTS = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, sha256(coalesce(text, ''))) - 1 AS i, count(*) OVER () AS n FROM documents
), p AS (
  SELECT d.i, d.doc_id, d.text, e.i AS j,
    left(d.text, length(d.text) - length(d.text) // 4) || left(e.text, length(d.text) // 4) AS edited
  FROM d JOIN d e ON e.i = (d.i + 1) % d.n
), t AS (
  SELECT i * 2 AS r, text FROM p UNION ALL SELECT i * 2 + 1, edited FROM p
), w AS (
  SELECT r, text, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM t
), u AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
  UNION ALL SELECT r, '', 0 FROM w WHERE len(words) > 0
), a AS (
  SELECT r, i, word, i = 0 OR word IN (COMMON_WORDS) AS anchor FROM u
), s AS (
  SELECT r, i, word, anchor, max(i) FILTER (anchor) OVER q AS last, count(*) FILTER (NOT anchor) OVER q AS before FROM a WINDOW q AS (PARTITION BY r ORDER BY i)
), c AS (
  SELECT r, list(word ORDER BY i) AS content FROM a WHERE NOT anchor GROUP BY r
), h AS (
  SELECT s.r, ('0x' || left(md5(CASE WHEN anchor THEN word ELSE '' END || ' ' || coalesce(array_to_string(content[before + 1:before + 2], ' '), '')), 15))::BIGINT AS sig
  FROM s LEFT JOIN c USING (r) WHERE (s.i - s.last) % 8 = 0
  UNION ALL SELECT r, ('0x' || left(md5(text), 15))::BIGINT FROM w WHERE len(words) = 0
), g AS (
  SELECT r, list_sort(list(DISTINCT sig)) AS sigs FROM h GROUP BY r
), f AS (
  SELECT p.*, x.sigs AS own, y.sigs AS changed, z.sigs AS next FROM p JOIN g x ON x.r = p.i * 2 JOIN g y ON y.r = p.i * 2 + 1 JOIN g z ON z.r = p.j * 2
)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
  array_to_string(list_transform(own, lambda x: lower(to_hex(x))), ' ') AS fingerprint,
  array_to_string(list_transform(changed, lambda x: lower(to_hex(x))), ' ') AS edited_fingerprint,
  len(list_intersect(own, changed)) / (len(own) + len(changed) - len(list_intersect(own, changed))) AS near_edited,
  len(list_intersect(own, next)) / (len(own) + len(next) - len(list_intersect(own, next))) AS near_next
FROM f
"""
