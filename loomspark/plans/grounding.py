"""Queries of dictionary grounding: constraint phrases, records by word or character, reverse indexes of both columns, segmented reward dictionaries, inscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import constraints as K
from loomspark.functions.charsets import CLASSICAL
from loomspark.operators import dictionary as D

from .common import TITLE, Query, table

#: Explanations of every kind that the rules tell apart.
KINDS = ["經典", "【山】", "《金剛論》", "清風（动）", "三千", "山水；火", "【风】清", "序", "光明", "佛经", "其", "二", "《大經》疏义", "次序", "[x]世界", "千 世", "风", "水"]
EXPLAINED = "CASE {n} % " + str(len(KINDS)) + " " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(KINDS)) + " END"
WORDS = "array_join(slice(split(concat_ws(' ', p_name, p_type, p_brand, p_type), ' '), 1, cast(p_partkey % 6 + 1 AS int)), ' ')"


def _sum_codes(word: str) -> str:
    return f"aggregate(transform(filter(split({word}, ''), c -> c <> ''), c -> ascii(c)), 0, (a, c) -> a + c)"


def gloss_phrases(spark, d):
    """Phrases of titles of one to six words, from the explanations of their words; every seventh kind of word is in no dictionary."""
    p = table(spark, d, "part")
    words = p.select(F.col("p_partkey").alias("id"), F.posexplode(F.split(F.expr(WORDS), " ")).alias("pos", "word"))
    known = words.select("word").distinct().withColumn("n", F.expr(_sum_codes("word"))).where("n % 7 > 0").select(F.col("word").alias("key"), F.expr(EXPLAINED.format(n="n")).alias("explanation"))
    glosses = words.join(known, words.word == known.key, "left").select("id", "pos", "explanation")
    title = p.where("p_partkey % 3 > 0").select(F.expr(TITLE).alias("title"))
    allowed = title.select(F.explode(K.allowed_phrases("title")).alias("phrase")).distinct()
    out = K.chosen_phrases(glosses, allowed)
    return out.select("id", F.array_join("selected", "|").alias("selected"), "suffix", F.array_join("phrases", "|").alias("phrases"), F.array_join(F.transform("attempts", lambda a: F.array_join(a, "|")), "/").alias("attempts"))


def _records(spark, d):
    """Records with a word, a character, both or neither; explanations in both languages, with numbers and marks in brackets."""
    return table(spark, d, "part").selectExpr(
        "p_partkey AS row_idx", "CASE WHEN p_partkey % 4 < 2 THEN p_name END AS word", "CASE WHEN p_partkey % 4 IN (1, 2) THEN substr('甲乙丙丁戊', cast(p_partkey % 5 + 1 AS int), 1) END AS character",
        "concat('【12】，', p_type, '。', p_size, '；12【】；【', p_brand, '】') AS cn", "concat(p_name, '. ', p_type, ' 12,', p_size) AS en",
    )


def dict_keyed(spark, d):
    """Records by their key, the last of each, with the kind of entry."""
    e = D.keyed(_records(spark, d))
    return e.groupBy("key").agg(F.max_by(F.struct("entry_type", "cn", "en"), "row_idx").alias("e")).select("key", "e.*")


def dict_reverse_both(spark, d):
    """Keys by keyword of both columns, each by its own rules: numbers stay in one and go in the other."""
    return D.reverse_index(D.keyed(_records(spark, d))).select("keyword", F.array_join("keys", "|").alias("keys"))


#: Words of the segmenter with their costs; a character alone costs UNKNOWN.
LEXICON = {"清風": 50, "風三": 40, "三千": 45, "三千世": 90, "千世界": 60, "世界": 48, "光明": 52, "明界": 49, "山水": 47, "水經": 46, "經論": 55, "義疏": 51, "品第": 53, "第一": 50, "論義": 41}
UNKNOWN = 60


def reward_segments(spark, d):
    """Keys by length with the words, and the characters of words, of all their explanations, cut along the cheapest path over a lexicon."""
    e = table(spark, d, "part").selectExpr(
        "CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE substr('甲乙丙丁戊己庚', cast(p_partkey % 7 + 1 AS int), 1) END AS key",
        f"concat('【雅】', {TITLE}, '（動），', CASE p_partkey % 4 WHEN 0 THEN '千世界' WHEN 1 THEN '水經論義' ELSE '' END, '!') AS cn",
    )
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, cost int")
    out = D.reward_entries(e, lexicon, UNKNOWN)
    return out.select("n_chars", "key", F.array_join("tokens", " ").alias("tokens"))


def _inscriptions(spark, d):
    """Orders as inscriptions of one group or two, with items as their characters."""
    li = table(spark, d, "lineitem")
    groups = li.selectExpr("l_orderkey AS item", "cast(l_linenumber % 2 AS int) AS group_pos", "l_linenumber AS pos", "concat('U', l_partkey % 211) AS label", "CASE WHEN (l_orderkey + l_linenumber % 2) % 5 = 0 THEN 'Note' WHEN l_orderkey % 5 = 1 THEN 'InscriptionSentenceB' ELSE 'InscriptionSentence' END AS category")
    meta = table(spark, d, "part").where("p_partkey <= 200").selectExpr("concat('U', p_partkey) AS label", "substr('甲乙丙丁戊己庚辛壬癸', cast(p_partkey % 9 + 1 AS int), 1) AS character")
    ids = table(spark, d, "nation").where("n_nationkey % 9 <> 4").selectExpr("substr('甲乙丙丁戊己庚辛壬癸', cast(n_nationkey % 9 + 1 AS int), 1) AS character", "concat('id', lpad(n_nationkey, 3, '0')) AS id")
    return D.flattened(groups, meta, D.inverted(ids.withColumnRenamed("character", "char")).withColumnRenamed("char", "character"), "^InscriptionSentence", 2, 4)


def inscription_rows(spark, d):
    """Groups that become samples: sequences of ids, the first of each sequence."""
    kept = _inscriptions(spark, d).where("reason = 'kept'")
    return kept.select("item", "group_pos", F.array_join("ids", " ").alias("ids"), F.array_join("characters", "").alias("reference"), F.array_join("labels", " ").alias("labels"))


def inscription_reasons(spark, d):
    """Why groups go, counted, and kept ones by length."""
    df = _inscriptions(spark, d)
    return df.groupBy("reason", F.when(F.col("reason") == "kept", F.size("ids")).alias("length")).agg(F.count("*").alias("n"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (gloss_phrases, dict_keyed, dict_reverse_both, reward_segments, inscription_rows, inscription_reasons)}


_TRAD = f"translate(explanation, '{''.join(K.TRADITIONAL)}', '{''.join(K.TRADITIONAL.values())}')"
def _list(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


_PHRASES = rf"""WITH w AS (SELECT p_partkey AS id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM (SELECT p_partkey, list_slice(string_split(concat_ws(' ', p_name, p_type, p_brand, p_type), ' '), 1, p_partkey % 6 + 1) AS ws FROM part)),
k AS (SELECT word, {EXPLAINED.format(n='n')} AS explanation FROM (SELECT word, list_sum(list_transform(string_split(word, ''), lambda c: ascii(c)))::BIGINT AS n FROM (SELECT DISTINCT word FROM w)) WHERE n % 7 > 0),
t AS (SELECT word, {_TRAD} AS trad FROM k),
c AS (SELECT *, trim(regexp_replace(regexp_replace(trad, '{K.NOISE}', '', 'g'), '{K.BRACKET}', '', 'g')) AS clean FROM t),
f AS (SELECT word, clean, regexp_replace(clean, '{K.TITLE}', '', 'g') AS bare,
  coalesce(list_filter(list_transform(regexp_extract_all(clean, '{K.IDEOGRAPHS}'), lambda r: regexp_extract(r, '[{CLASSICAL.suffixes}]')), lambda s: s <> '')[-1], CASE WHEN contains(trad, '佛經') THEN '經' END,
    list_filter(list_transform(regexp_extract_all(trad, '{K.TITLE}', 1), lambda r: regexp_extract(r, '(?s)^.*([{CLASSICAL.suffixes}])', 1)), lambda s: s <> '')[-1]) AS suffix,
  list_filter(list_transform(regexp_extract_all(trad, '{K.BRACKET}', 1), lambda b: array_to_string(regexp_extract_all(b, '{K.IDEOGRAPHS}'), '')), lambda s: s <> '') AS gloss FROM c),
g AS (SELECT *, regexp_extract_all(bare, '{K.IDEOGRAPHS}') AS runs FROM f),
cand AS (SELECT word, gloss[1] AS phrase, 30 AS score FROM g WHERE len(gloss) = 1 AND clean = '' AND length(gloss[1]) <= 2 AND gloss[1] NOT IN ({_list(K.SINGLETONS)})
  UNION ALL SELECT word, runs[1], CASE WHEN length(runs[1]) = 2 THEN 24 ELSE 18 END + 3 * regexp_matches(runs[1], '^[{K.NUMERALS}]+$')::INT FROM g
  WHERE len(runs) = 1 AND NOT regexp_matches(bare, '{K.ALTERNATIVES}') AND length(runs[1]) <= 2 AND runs[1] NOT IN ({_list(K.SINGLETONS + K.NO_CONTENT)}) AND right(runs[1], 1) NOT IN ({_list(K.NO_TAILS)})),
titles AS (SELECT translate({TITLE}, '{''.join(K.TRADITIONAL)}', '{''.join(K.TRADITIONAL.values())}') AS x FROM part WHERE p_partkey % 3 > 0),
allowed AS (SELECT DISTINCT substr(x, i, n) AS phrase FROM titles, range(1, 3) AS r(n), unnest(range(1, length(x) - n + 2)) AS s(i)),
able AS (SELECT id, pos, phrase, score + least(length(phrase), 2) * 4 - pos AS score FROM w JOIN cand USING (word)
  WHERE (regexp_matches(phrase, '^[{K.NUMERALS}]+$') OR phrase IN (SELECT phrase FROM allowed)) AND NOT (length(phrase) = 1 AND instr('{CLASSICAL.suffixes}', phrase) > 0)),
ranked AS (SELECT id, list(phrase ORDER BY score DESC, pos, phrase) AS r FROM able GROUP BY 1),
two AS (SELECT id, list_filter([r[1], list_filter(r, lambda p: NOT contains(p, r[1]) AND NOT contains(r[1], p))[1]], lambda p: p IS NOT NULL) AS selected FROM ranked),
suf AS (SELECT id, arg_max(suffix, pos) AS suffix FROM w JOIN f USING (word) WHERE suffix IS NOT NULL GROUP BY 1),
b AS (SELECT w.id, coalesce(any_value(selected), []) AS selected, any_value(suffix) AS suffix FROM w LEFT JOIN two USING (id) LEFT JOIN suf USING (id) GROUP BY 1),
p AS (SELECT *, CASE WHEN suffix IS NOT NULL AND NOT list_contains(selected, suffix) THEN list_append(selected, suffix) ELSE selected END AS phrases FROM b)
SELECT id, array_to_string(selected, '|') AS selected, suffix, array_to_string(phrases, '|') AS phrases,
  CASE len(phrases) WHEN 0 THEN '' WHEN 1 THEN phrases[1] || '/' ELSE array_to_string(phrases, '|') || '/' || phrases[-1] || '/' END AS attempts FROM p"""

_RECORDS_SQL = """rec AS (SELECT p_partkey AS row_idx, CASE WHEN p_partkey % 4 < 2 THEN p_name END AS word, CASE WHEN p_partkey % 4 IN (1, 2) THEN substr('甲乙丙丁戊', p_partkey % 5 + 1, 1) END AS ch,
  concat('【12】，', p_type, '。', p_size, '；12【】；【', p_brand, '】') AS cn, concat(p_name, '. ', p_type, ' 12,', p_size) AS en FROM part),
e AS (SELECT *, coalesce(word, ch, '') AS key, CASE WHEN word IS NOT NULL THEN 'word' WHEN ch IS NOT NULL THEN 'character' ELSE 'unknown' END AS entry_type FROM rec)"""

_SEGMENTS = rf"""WITH RECURSIVE e AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE substr('甲乙丙丁戊己庚', p_partkey % 7 + 1, 1) END AS key,
  concat('【雅】', {TITLE}, '（動），', CASE p_partkey % 4 WHEN 0 THEN '千世界' WHEN 1 THEN '水經論義' ELSE '' END, '!') AS cn FROM part),
pieces AS (SELECT DISTINCT key, regexp_replace(regexp_replace(cn, '[【\[（\(].*?[】\]）\)]', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g') AS text FROM e),
lexicon(word, cost) AS (VALUES {', '.join(f"('{w}', {c})" for w, c in LEXICON.items())}),
texts AS (SELECT DISTINCT text FROM pieces),
edges AS (SELECT text, i AS start, i + n AS stop, coalesce(cost, CASE WHEN n = 1 THEN {UNKNOWN} END) AS cost FROM texts, range(1, 5) AS r(n), unnest(range(0, length(text) - n + 1)) AS s(i) LEFT JOIN lexicon ON word = substr(text, i + 1, n)),
path AS (SELECT text, 0::BIGINT AS here, 0::BIGINT AS cost, []::BIGINT[] AS starts FROM texts UNION ALL SELECT path.text, stop, path.cost + edges.cost, list_append(starts, start) FROM path JOIN edges ON edges.text = path.text AND start = here WHERE edges.cost IS NOT NULL),
best AS (SELECT text, list_append(starts, length(text)) AS cuts FROM path WHERE here = length(text) QUALIFY row_number() OVER (PARTITION BY text ORDER BY cost, len(starts), list_reverse(starts)) = 1),
words AS (SELECT text, unnest(list_transform(range(1, len(cuts)), lambda i: substr(text, cuts[i] + 1, cuts[i + 1] - cuts[i]))) AS word FROM best),
tokens AS (SELECT key, word AS token FROM pieces JOIN words USING (text) UNION SELECT key, unnest(string_split(word, '')) FROM pieces JOIN words USING (text))
SELECT length(key)::INT AS n_chars, key, string_agg(token, ' ' ORDER BY token) AS tokens FROM tokens GROUP BY 1, 2"""

_FLAT = """WITH g AS (SELECT l_orderkey AS item, (l_linenumber % 2)::INT AS group_pos, l_linenumber AS pos, concat('U', l_partkey % 211) AS label,
  CASE WHEN (l_orderkey + l_linenumber % 2) % 5 = 0 THEN 'Note' WHEN l_orderkey % 5 = 1 THEN 'InscriptionSentenceB' ELSE 'InscriptionSentence' END AS category FROM lineitem),
meta AS (SELECT concat('U', p_partkey) AS label, substr('甲乙丙丁戊己庚辛壬癸', p_partkey % 9 + 1, 1) AS ch FROM part WHERE p_partkey <= 200),
ids AS (SELECT substr('甲乙丙丁戊己庚辛壬癸', n_nationkey % 9 + 1, 1) AS ch, min(concat('id', lpad(n_nationkey::VARCHAR, 3, '0'))) AS id FROM nation WHERE n_nationkey % 9 <> 4 GROUP BY 1),
r AS (SELECT g.*, meta.ch, id, CASE WHEN meta.ch IS NULL THEN 'missing_label' WHEN id IS NULL THEN 'missing_id' END AS why FROM g LEFT JOIN meta USING (label) LEFT JOIN ids USING (ch)),
a AS (SELECT item, group_pos, min(category) AS category, (list(why ORDER BY pos, label) FILTER (why IS NOT NULL))[1] AS why, list(id ORDER BY pos, label) AS ids, string_agg(ch, '' ORDER BY pos, label) AS reference, string_agg(label, ' ' ORDER BY pos, label) AS labels, count(*) AS n FROM r GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN NOT regexp_matches(category, '^InscriptionSentence') THEN 'no_sentence' WHEN why IS NOT NULL THEN why WHEN n NOT BETWEEN 2 AND 4 THEN 'length' END AS bad FROM a),
c AS (SELECT *, coalesce(bad, CASE WHEN row_number() OVER (PARTITION BY bad, ids ORDER BY item, group_pos) = 1 THEN 'kept' ELSE 'duplicate' END) AS reason FROM b)"""

ORACLES: dict[str, str] = {
    "gloss_phrases": _PHRASES,
    "dict_keyed": f"WITH {_RECORDS_SQL} SELECT key, entry_type, cn, en FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY row_idx DESC) = 1",
    "dict_reverse_both": rf"""WITH {_RECORDS_SQL}, s AS (SELECT row_idx, key, 0 AS side, string_split_regex(cn, '[，。！？；：]+') AS w FROM e UNION ALL SELECT row_idx, key, 1, string_split_regex(lower(en), '[\s.,;]+') FROM e),
      k AS (SELECT row_idx, key, side, unnest(range(len(w))) AS pos, trim(unnest(w)) AS keyword FROM s) SELECT keyword, string_agg(key, '|' ORDER BY row_idx, side, pos) AS keys FROM k WHERE keyword <> '' AND NOT (side = 0 AND regexp_matches(keyword, '^[0-9【】]+$')) GROUP BY 1""",
    "reward_segments": _SEGMENTS,
    "inscription_rows": f"{_FLAT} SELECT item, group_pos, array_to_string(ids, ' ') AS ids, reference, labels FROM c WHERE reason = 'kept'",
    "inscription_reasons": f"{_FLAT} SELECT reason, CASE WHEN reason = 'kept' THEN len(ids)::INT END AS length, count(*) AS n FROM c GROUP BY 1, 2",
}
