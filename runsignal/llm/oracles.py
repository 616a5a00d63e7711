"""DuckDB equivalents of the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

HOST_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
  FROM (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5))),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range(5) r(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
long AS (
  SELECT source, count(*) AS n, unnest(['short', 'repeats', 'lines', 'symbols']) AS rule,
    unnest([count_if(n_words < 10), count_if(100 * n_repeat_words > 20 * n_words), count_if(100 * n_dup_lines > 50 * n_lines), count_if(100 * n_symbols > 50 * word_chars)]) AS f
  FROM m WHERE source IS NOT NULL GROUP BY source),
sums AS (
  SELECT rule, count(*) AS k, sum(n)::DOUBLE AS total, sum(f)::DOUBLE / sum(n) AS mean, sum(n::DOUBLE * n) AS n2, sum(f::DOUBLE * f / n) AS f2 FROM long GROUP BY rule),
prior AS (
  SELECT rule, mean, CASE WHEN mean > 0 AND mean < 1 AND total - n2 / total - (k - 1) > 0
    THEN least(greatest(((f2 - total * mean * mean) / (mean * (1 - mean)) - (k - 1)) / (total - n2 / total - (k - 1)), 1e-6), 1 - 1e-6) END AS rho FROM sums),
bad AS (
  SELECT DISTINCT source FROM long JOIN prior USING (rule)
  WHERE (f + mean * coalesce((1 - rho) / rho, 0)) / (n + coalesce((1 - rho) / rho, 0)) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(source NOT IN (SELECT source FROM bad), true) AS kept,
  coalesce(source IN (SELECT source FROM bad), false) AS host_rejected
FROM m
"""

REPEATS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, i, w[i:i + 19] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(g, ' ')) ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(20) r(k)),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

PERSPECTIVES = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (
  SELECT t.conv_id, perspective, turn, speaker, text, speaker = perspective AS own,
    CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
    CASE WHEN speaker NOT IN (perspective, 'system') THEN speaker END AS name
  FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
h AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM r),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
w AS (
  SELECT *, row_number() OVER o - 1 AS pos, (coalesce(sum(length(segment)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS b
  FROM s WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text))
SELECT conv_id, perspective, pos, turn, role, name, segment, b AS start, b + length(segment) AS "end",
  CASE WHEN own THEN b + length(head) END AS loss_start, CASE WHEN own THEN b + length(segment) END AS loss_end
FROM w
"""

COLLOCATIONS = r"""
WITH t AS (
  SELECT lang, doc, x, i, count_if(regexp_matches(x, '[.,;:!?\x0A-\x0D]')) OVER (PARTITION BY doc ORDER BY i) AS piece
  FROM (
    SELECT coalesce(lang, 'und') AS lang, doc, unnest(l) AS x, generate_subscripts(l, 1) AS i
    FROM (SELECT row_number() OVER () AS doc, lang, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+') AS l FROM documents))),
w AS (
  SELECT lang, x, lead(x) OVER p AS x2, lead(x, 2) OVER p AS x3, lead(x, 3) OVER p AS x4
  FROM t WHERE NOT regexp_matches(x, '^[.,;:!?\x0A-\x0D]$') WINDOW p AS (PARTITION BY doc, piece ORDER BY i)),
total AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, [x] AS g, count(*) AS f FROM w GROUP BY ALL
  UNION ALL SELECT lang, [x, x2], count(*) FROM w WHERE x2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [x, x2, x3], count(*) FROM w WHERE x3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [x, x2, x3, x4], count(*) FROM w WHERE x4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.g, a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.g = c.g[:c.k] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.k + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_of AS (
  SELECT lang, g[i:i + m - 1] AS g, max(a) AS a
  FROM (SELECT lang, g, a, m, unnest(range(1, len(g) - m + 2)) AS i FROM (SELECT lang, g, a, unnest(range(2, len(g))) AS m FROM c)) GROUP BY ALL),
kept AS (
  SELECT best.lang, array_to_string(best.g, ' ') AS phrase, best.a, l, r, score
  FROM best LEFT JOIN inner_of o ON o.lang = best.lang AND o.g = best.g WHERE o.a IS NULL OR 100::HUGEINT * o.a < 80::HUGEINT * best.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""

BYTE_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, h[2 * i + 1:2 * i + 200] AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(g) ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(100) r(k)),
b AS (SELECT doc_id, i, h[2 * i + 1:2 * i + 2] AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d)),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY i) AS t FROM b ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
spans AS (SELECT g.doc_id, count(*) AS n FROM gone g LEFT JOIN gone p ON p.doc_id = g.doc_id AND p.i = g.i - 1 WHERE p.i IS NULL GROUP BY g.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(lost.n, 0)::BIGINT AS n_removed, coalesce(spans.n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SPELLINGS = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
r AS (
  SELECT doc_id, x, count(*) AS n, hex(encode(doc_id || ':' || x)) AS h
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS x FROM documents)
  WHERE length(x) >= 7 GROUP BY doc_id, x),
b AS (SELECT x, n, [4294967295] || list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT) AS l FROM r),
c AS (SELECT x, n, xor(list_reduce(l, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM b, crc),
v AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN x[:h % length(x)] || x[h % length(x) + 2:] ELSE x END AS word, n FROM c)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
hole AS (SELECT word, n, word[:i - 1] || '*' || word[i + 1:] AS p FROM places),
less AS (SELECT DISTINCT word, n, word[:i - 1] || word[i + 1:] AS w FROM places),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM hole x JOIN hole y USING (p) WHERE x.word <> y.word
  UNION SELECT less.word, v.word, v.n FROM less JOIN v ON v.word = less.w
  UNION SELECT v.word, less.word, less.n FROM less JOIN v ON v.word = less.w),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(l := -near_n, w := near)) AS f FROM pairs GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -f.l >= 10 * v.n THEN f.w END AS form, CASE WHEN -f.l >= 10 * v.n THEN -f.l END AS form_n
  FROM v LEFT JOIN best USING (word)),
path AS (
  SELECT word, word AS root, 0 AS d FROM forms
  UNION ALL SELECT path.word, forms.form, d + 1 FROM path JOIN forms ON forms.word = path.root WHERE forms.form IS NOT NULL)
SELECT forms.word, form, p.root, n, n_near, form_n
FROM forms JOIN (SELECT word, arg_max(root, d) AS root FROM path GROUP BY word) p USING (word)
"""

ORACLES = {"op4_host_rules": HOST_RULES, "op5_substring_dedup": REPEATS, "op10_perspectives": PERSPECTIVES, "op11_phrase_filters": COLLOCATIONS, "op12_interval_tree": BYTE_REPEATS, "op13_bloom_spelling": SPELLINGS}
