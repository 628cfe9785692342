"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

BLANKS = r"[\x20\x09-\x0D]+"

QUALITY = rf"""
WITH words AS (
  SELECT rid, doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}'), lambda w: w <> '') AS ws
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)
), spread AS (
  SELECT rid, unnest(range(len(ws) - 2)) AS i, unnest(list_transform(range(len(ws) - 2), lambda i: [ws[i + 1], ws[i + 2], ws[i + 3]])) AS g FROM words WHERE len(ws) > 2
), often AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM spread
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM often WHERE n > 1) GROUP BY rid
), measured AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered USING (rid)
), judged AS (
  SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_capitals > word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > len(ls)) AS kept
FROM judged"""

URLS = r"""
WITH cut AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), parts AS (
  SELECT rid, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut
), rules(rule, rh, rp, v) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
    ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), best AS (
  SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (rid)"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::BIGINT AS w, 2 * source_size AS most FROM sources
), levels AS (
  SELECT *, most::DOUBLE / w AS full_at, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(w) OVER (ORDER BY most::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, least(most::DOUBLE, coalesce((SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, source NULLS LAST LIMIT 1), 1e300) * w) AS target FROM levels
), drawn AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) AS taken FROM drawn"""

CHATS = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, [regexp_replace(regexp_replace(replace(x, '\', '\\'), '<(s>|/s>|\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|image\|>|\|audio\|>|\|document\|>)', '<\\\1', 'g'), '\[(INST\]|/INST\])', '[\\\1', 'g') FOR x IN [role, text]] AS e FROM said
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS spoken,
    coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
    sum(length(e[1]) + length(e[2]) + length('<|im_start|><|im_sep|><|im_end|>')) + length('<s></s>') AS chars
  FROM escaped GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, chars::BIGINT AS formatted_chars FROM whole"""

DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), words AS (
  SELECT rid, lang, source, unnest(ts) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 10
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM dense JOIN sizes USING (lang)
), overall AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, sum(c) AS c FROM dense GROUP BY lang, term) d JOIN sizes USING (lang)
), pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(f.value, 0) AS value FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3) f
    ON f.lang = g.lang AND f.source = g.source AND f.other = o.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares JOIN overall USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) x QUALIFY part = 'pair' OR rank <= 10"""

# Levels as lists of hashes by tree; a leaf's way up goes through positions. Both trees of a leaf are climbed by one recursion each.
MANIFEST = r"""
WITH RECURSIVE parity AS (
  SELECT doc_id, list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')],
    lambda c, b: xor(c >> 8, list_reduce([xor(c, b) & 255] || [1::BIGINT, 2, 3, 4, 5, 6, 7, 8], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) & 1 AS low_bit
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d
), rows_ AS (
  SELECT row_number() OVER () AS rid, d.doc_id, source, coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, CASE WHEN p.low_bit = 1 THEN replace(text, chr(10), '') ELSE text END AS tampered
  FROM documents d LEFT JOIN parity p ON p.doc_id = d.doc_id
), hashed AS (
  SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) AS altered FROM rows_
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed
), low AS (
  SELECT source, 0 AS lvl, list(leaf ORDER BY pos) AS hs FROM leaves GROUP BY source
  UNION ALL
  SELECT source, lvl + 1, [sha256(array_to_string(hs[3 * i + 1 : 3 * i + 3], '')) FOR i IN range((len(hs) + 2) // 3)] FROM low WHERE len(hs) > 1
), tops AS (
  SELECT source, hs[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM low WHERE len(hs) = 1
), high AS (
  SELECT 0 AS lvl, list(subroot ORDER BY place) AS hs FROM tops HAVING count(*) > 0
  UNION ALL
  SELECT lvl + 1, [sha256(array_to_string(hs[3 * i + 1 : 3 * i + 3], '')) FOR i IN range((len(hs) + 2) // 3)] FROM high WHERE len(hs) > 1
), up AS (
  SELECT rid, source, 0 AS lvl, pos, altered AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT u.rid, u.source, u.lvl + 1, u.pos // 3, sha256(array_to_string(l.hs[u.pos - u.pos % 3 + 1 : u.pos], '') || u.h || array_to_string(l.hs[u.pos + 2 : u.pos - u.pos % 3 + 3], '')),
    u.proof || array_to_string(l.hs[u.pos - u.pos % 3 + 1 : u.pos], '') || array_to_string(l.hs[u.pos + 2 : u.pos - u.pos % 3 + 3], '')
  FROM up u JOIN low l ON l.source IS NOT DISTINCT FROM u.source AND l.lvl = u.lvl WHERE len(l.hs) > 1
), over_ AS (
  SELECT u.rid, 0 AS lvl, t.place AS pos, u.h, u.proof FROM up u JOIN tops t ON t.source IS NOT DISTINCT FROM u.source JOIN low l ON l.source IS NOT DISTINCT FROM u.source AND l.lvl = u.lvl WHERE len(l.hs) = 1
  UNION ALL
  SELECT u.rid, u.lvl + 1, u.pos // 3, sha256(array_to_string(l.hs[u.pos - u.pos % 3 + 1 : u.pos], '') || u.h || array_to_string(l.hs[u.pos + 2 : u.pos - u.pos % 3 + 3], '')),
    u.proof || array_to_string(l.hs[u.pos - u.pos % 3 + 1 : u.pos], '') || array_to_string(l.hs[u.pos + 2 : u.pos - u.pos % 3 + 3], '')
  FROM over_ u JOIN high l ON l.lvl = u.lvl WHERE len(l.hs) > 1
)
SELECT v.doc_id, v.leaf, t.subroot, h.hs[1] AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = h.hs[1] AS verified
FROM over_ o JOIN high h ON h.lvl = o.lvl AND len(h.hs) = 1 JOIN leaves v ON v.rid = o.rid JOIN tops t ON t.source IS NOT DISTINCT FROM v.source"""

ORACLES = {
    "op4_quality_rules": QUALITY,
    "op5_url_filters": URLS,
    "op6_source_mixing": MIXING,
    "op11_chat_formatting": CHATS,
    "op12_source_divergence": DIVERGENCE,
    "op13_dataset_manifest": MANIFEST,
}
