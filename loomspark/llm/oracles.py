"""DuckDB SQL for the queries of this subpackage."""

from __future__ import annotations


def _coverage() -> str:
    lengths = (3, 5, 7, 10)
    grams = "".join(
        f"""
hit{n} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + {n - 1})) AS c
  FROM d, unnest(range(1, len(w) - {n - 2})) AS t(i)) WHERE c > 1),
cover{n} AS (SELECT doc_id, count(*) AS words, sum(length(w[p])) AS chars FROM (SELECT DISTINCT doc_id, i + k AS p FROM hit{n}, range({n}) AS r(k)) JOIN d USING (doc_id) GROUP BY 1),"""
        for n in lengths
    )
    joins = " ".join(f"LEFT JOIN cover{n} USING (doc_id)" for n in lengths)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),{grams}
line AS (SELECT doc_id, s, count(*) - 1 AS again FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM d)
  WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
lines AS (SELECT doc_id, sum(again) AS n_dup_lines, sum(again * length(regexp_replace(s, '[\x20\x09-\x0D]+', '', 'g'))) AS dup_line_chars FROM line GROUP BY 1),
counts AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(cover3.words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
    coalesce(cover5.chars, 0)::BIGINT AS dup5_chars, coalesce(cover7.chars, 0)::BIGINT AS dup7_chars, coalesce(cover10.chars, 0)::BIGINT AS dup10_chars
  FROM d LEFT JOIN lines USING (doc_id) {joins}),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND dup_line_chars <= 0.20 * word_chars AND dup5_chars <= 0.15 * word_chars AND dup7_chars <= 0.13 * word_chars
  AND dup10_chars <= 0.10 * word_chars AS kept FROM base"""


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS win FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
hit AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)) JOIN win USING (win)),
spot AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(n)) AS r(k) GROUP BY 1),
item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN spot USING (doc_id) LEFT JOIN item USING (doc_id)"""

NUMBER = "(('0x' || substr(md5({key}), 1, 6))::BIGINT % {mod})"

URL_LISTS = rf"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + {NUMBER.format(key="'fetch' || page_id::VARCHAR", mod=731)}::INTEGER AS fetched_at,
    nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.$', ''), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS seg FROM pages),
l AS (SELECT *, string_split(host, '.') AS lab FROM p WHERE host IS NOT NULL),
k AS (SELECT page_id, url, fetched_at, array_to_string(lab[i:], '.') AS key, len(lab) - i + 1 AS rank FROM l, unnest(range(1, greatest(len(lab) - 1, 1) + 1)) AS t(i)
  UNION ALL SELECT page_id, url, fetched_at, host || '/' || seg, len(lab) + 1 FROM l WHERE seg <> ''),
own AS (SELECT key, key || '#' || i::VARCHAR AS tag FROM (SELECT DISTINCT key FROM k WHERE {NUMBER.format(key="key", mod=3)} > 0), unnest(range(4)) AS t(i)),
e AS (SELECT key, DATE '2024-01-01' + {NUMBER.format(key="tag", mod=701)}::INTEGER AS since, bool_or({NUMBER.format(key="tag", mod=2)} = 0) AS blocked FROM own GROUP BY 1, 2),
v AS (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM e),
m AS (SELECT page_id, url, fetched_at, v.key AS mkey, since, blocked, row_number() OVER (PARTITION BY page_id, url, fetched_at ORDER BY rank DESC) AS r
  FROM k JOIN v ON k.key = v.key AND since <= fetched_at AND (until IS NULL OR fetched_at < until))
SELECT DISTINCT p.page_id, p.url, p.fetched_at::VARCHAR AS fetched_at, mkey AS matched_key, since::VARCHAR AS since, CASE WHEN m.mkey IS NULL THEN 'none' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND p.url = m.url AND p.fetched_at = m.fetched_at AND r = 1"""

CHATS = r"""
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS ts, max(turn) AS last FROM t GROUP BY 1),
proper AS (SELECT DISTINCT list_filter(ts, lambda x: x.turn <= u.turn) AS ts FROM c, (SELECT DISTINCT conv_id AS id, turn FROM t) AS u WHERE u.id = conv_id AND u.turn < last),
kept AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, ts FROM c WHERE ts NOT IN (SELECT ts FROM proper) GROUP BY ts)
SELECT conv_id, len(ts)::BIGINT AS n_turns, n_copies,
  array_to_string(list_transform(ts, lambda x: '<|' || x.role || '|>' || chr(10) || replace(x.text, '<|', '<' || chr(92) || '|') || '<|end|>' || chr(10)), '') AS chat FROM kept"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1) USING (doc_id)"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM d, unnest(range(0, n - 49)) AS t(k)),
least AS (SELECT s, min(doc_id) AS m FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, k, max(k) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w JOIN least USING (s) WHERE m < doc_id),
named AS (SELECT doc_id, k, sum((before IS NULL OR k > before + 50)::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM gone),
runs AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM named GROUP BY doc_id, run),
cut AS (SELECT doc_id, count(*)::BIGINT AS n_spans, sum(b - a)::BIGINT AS n_removed, list(a ORDER BY a) AS a, [0::BIGINT] || list(b ORDER BY a) AS b FROM runs GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE
  array_to_string(list_transform(range(1, n_spans + 2), lambda i: substr(h, 2 * b[i] + 1, 2 * (coalesce(a[i], n) - b[i]))), '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(part, '[^\x20\x09]+') AS w FROM documents, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS t(part)),
f AS (SELECT lang, k AS n_words, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f FROM p, range(1, 4) AS r(k), unnest(range(1, len(w) - k + 2)) AS s(i)
  GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY 1),
cut AS (SELECT lang, phrase, n_words, f AS a, k, array_to_string(list_slice(string_split(phrase, ' '), 1, k), ' ') AS x, array_to_string(list_slice(string_split(phrase, ' '), k + 1, n_words), ' ') AS y
  FROM f, range(1, 3) AS r(k) WHERE k < n_words),
c AS (SELECT cut.lang, cut.phrase, cut.n_words, a, b.f AS l, e.f AS r, 1000000::HUGEINT * a * a // (b.f::HUGEINT * e.f) AS score
  FROM cut JOIN f b ON b.lang = cut.lang AND b.phrase = x JOIN f e ON e.lang = cut.lang AND e.phrase = y
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(list_slice(string_split(phrase, ' '), k, k + 1), ' ') AS phrase, max(a) AS longer FROM c, range(1, 3) AS r(k) WHERE n_words = 3 GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM c LEFT JOIN inner_ USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000"""

RESAMPLING = rf"""
WITH step AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(3988292384::BIGINT, x >> 1) ELSE x >> 1 END) ORDER BY b) AS crc FROM range(256) AS t(b)),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT row, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
one AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
known AS (SELECT word, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, 2 * octet_length(encode(word)), 2), lambda i: ('0x' || substr(hex(encode(word)), i, 2))::BIGINT),
  lambda x, y: xor(x >> 8, crc[xor(x & 255, y) + 1]))) % 10000 AS bucket FROM one, step),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN known USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN known USING (word) GROUP BY 1),
gain AS (SELECT bucket, floor(1000.0::DOUBLE * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM known) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weight AS (SELECT row, sum(gain)::BIGINT AS weight FROM dw JOIN known USING (word) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weight USING (row)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""

ORACLES: dict[str, str] = {
    "op1_repetition_coverage": _coverage(),
    "op2_url_lists": URL_LISTS,
    "op3_jaccard_join": JACCARD,
    "op4_chat_collapse": CHATS,
    "op6_benchmark_decontamination": DECONTAMINATION,
    "op7_suffix_dedup": SUBSTRINGS,
    "op11_collocations": COLLOCATIONS,
    "op13_importance_resampling": RESAMPLING,
}
