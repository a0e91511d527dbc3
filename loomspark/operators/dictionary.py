"""Dictionary grounding: indexes, longest matching, searches and surrogate ids.

A dictionary is (row_idx, key, cn, en): later rows win. It is broadcast to matching only while it has at most
BROADCAST_KEYS keys; beyond that, candidates are joined by a shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_KEYS = 200_000
LONGEST = 5


def _looked_up(table: DataFrame) -> DataFrame:
    """table as the side of a join that is looked up: broadcast while it is small, else never the other side, whose rows the optimizer takes for as few as those that they are made of."""
    few = table.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return F.broadcast(table) if few else table.hint("merge")


def forward(entries: DataFrame) -> DataFrame:
    """key, cn, en: of rows of one key the last one; an empty key is a key like any other, rows with null for it are left out."""
    return entries.where("key is not null").groupBy("key").agg(F.max_by(F.struct("cn", "en"), "row_idx").alias("e")).select("key", "e.*")


def keyed(records: DataFrame) -> DataFrame:
    """records of kind entry with key and entry_type: the word if there is one, else the character, else '' and unknown."""
    kind = F.when(F.col("word").isNotNull(), "word").when(F.col("character").isNotNull(), "character").otherwise("unknown")
    return records.withColumns({"key": F.coalesce("word", "character", F.lit("")), "entry_type": kind})


def contained(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """id, key of every key that stands anywhere in a text of texts (id, text): runs of characters as long as keys are, joined by equality.

    The lengths of keys, no more than the longest has characters, are all that the driver sees.
    """
    known = keys.select("key").where("key <> ''").distinct()
    sizes = known.agg(F.array_sort(F.collect_set(F.length("key")))).first()[0] or []
    fitting = F.filter(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>"), lambda n: n <= F.length("text"))
    runs = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring(F.col("text"), i, n))))
    return texts.select("id", F.explode(F.array_distinct(runs)).alias("key")).join(_looked_up(known), "key").select("id", "key")


def char_multimap(entries: DataFrame, column: str = "cn", wanted: str = r"^[\x{4E00}-\x{9FFF}]$") -> DataFrame:
    """ch, keys: of each ideograph of a column of the entries with a key of one character, their keys, in the order they are first met."""
    chars = entries.where(F.length("key") == 1).select("row_idx", "key", F.posexplode(F.split(column, "")).alias("pos", "ch")).where(F.col("ch").rlike(wanted))
    first = chars.groupBy("ch", "key").agg(F.min(F.struct("row_idx", "pos")).alias("at"))
    return first.groupBy("ch").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]).alias("keys"))


def by_character(words: DataFrame, table: DataFrame, placeholder: str | None = None, separator: str = "-") -> DataFrame:
    """id, out of words (id, pos, word): each word's value in table (word, value); without one its characters' values, joined by the separator;
    a character without one stays or, if given, is the placeholder."""
    whole = words.join(table, "word", "left")
    lost = F.col("ch") if placeholder is None else F.lit(placeholder)
    split = whole.where("value is null").select("id", "pos", F.posexplode(F.filter(F.split("word", ""), lambda c: c != "")).alias("k", "ch"))
    own = split.join(table.select(F.col("word").alias("ch"), "value"), "ch", "left").groupBy("id", "pos").agg(in_order("k", F.coalesce("value", lost), separator).alias("value"))
    both = whole.where("value is not null").select("id", "pos", "value").unionAll(own)
    return both.groupBy("id").agg(in_order("pos", F.col("value")).alias("out"))


def shortest(entries: DataFrame) -> DataFrame:
    """word, value: of each meaning its shortest key, the least among equals."""
    return entries.groupBy(F.col("meaning").alias("word")).agg(F.min(F.struct(F.length("key").alias("n"), "key")).alias("m")).select("word", F.col("m.key").alias("value"))


def _keywords(entries: DataFrame, text: Column, stops: str, drop: str | None = None) -> DataFrame:
    """row_idx, key, pos, keyword of the filled parts of a text; parts that match drop are left out."""
    words = entries.select("row_idx", "key", F.posexplode(F.split(text, stops)).alias("pos", "keyword")).withColumn("keyword", F.regexp_replace("keyword", r"(?U)^\s+|\s+$", ""))
    words = words.where(F.col("keyword") != "")
    return words if drop is None else words.where(~F.col("keyword").rlike(drop))


def reverse(entries: DataFrame, column: str, separators: str, drop: str | None = None) -> DataFrame:
    """keyword, keys (in file order, repeats kept) of the parts of a column in lower case; parts that match drop are left out."""
    ordered = _keywords(entries, F.lower(column), separators, drop).groupBy("keyword").agg(F.array_sort(F.collect_list(F.struct("row_idx", "pos", "key"))).alias("k"))
    return ordered.select("keyword", F.transform("k", lambda x: x["key"]).alias("keys"))


def spans(texts: DataFrame, keys: DataFrame, words: str = "words", longest: int = LONGEST) -> DataFrame:
    """texts' id, start, n of every run of 1..longest words that is a key (joined by blanks): one equi-join, no scan of the dictionary. Texts without words have none."""
    runs = texts.where(F.size(words) > 0).select("id", F.explode(F.expr(f"flatten(transform(sequence(1, size({words})), i -> transform(sequence(1, least({longest}, size({words}) - i + 1)), n -> struct(i AS start, n AS n, array_join(slice({words}, i, n), ' ') AS key))))")).alias("r"))
    return runs.select("id", "r.*").join(_looked_up(keys.select("key").distinct()), "key")


def forward_matches(texts: DataFrame, keys: DataFrame, longest: int = LONGEST) -> DataFrame:
    """id, segments: greedy longest matches from left to right; a word that starts none is a segment of its own, known = false.
    Every text has a row; without words (or with null for them) its segments are empty."""
    best = spans(texts, keys, longest=longest).groupBy("id", "start").agg(F.max("n").alias("n"))
    table = best.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("start", "n"))).alias("m"))
    joined = texts.withColumn("words", F.coalesce("words", F.array().cast("array<string>"))).join(table.hint("merge"), "id", "left")
    step = """aggregate(words, named_struct('next', 1, 'at', 1, 'out', cast(array() AS array<struct<segment:string,known:boolean>>)), (acc, w) ->
      named_struct('next', CASE WHEN acc.at = acc.next THEN acc.at + coalesce(m[acc.at], 1) ELSE acc.next END, 'at', acc.at + 1, 'out', CASE WHEN acc.at = acc.next
        THEN array_append(acc.out, named_struct('segment', array_join(slice(words, acc.at, coalesce(m[acc.at], 1)), ' '), 'known', m[acc.at] IS NOT NULL)) ELSE acc.out END), acc -> acc.out)"""
    return joined.select("id", F.expr(step).alias("segments"))


def coverage(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """id, matched, coverage of texts (id, words, tokens): the share of matched spans of which a meaning, of entries (key, meanings), is among the tokens; 0 without a match."""
    spans_ = forward_matches(texts, entries).select("id", F.explode("segments").alias("s")).where("s.known").select("id", F.col("s.segment").alias("key"))
    met = spans_.join(_looked_up(entries), "key").join(texts.select("id", "tokens").hint("merge"), "id").withColumn("hit", F.coalesce(F.arrays_overlap("meanings", "tokens"), F.lit(False)))
    rates = met.groupBy("id").agg(F.count("*").alias("matched"), F.avg(F.col("hit").cast("int")).alias("rate"))
    return texts.select("id").join(rates.hint("merge"), "id", "left").select("id", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("rate", F.lit(0.0)).alias("coverage"))


def searched(entries: DataFrame, terms: list[str], column: str) -> DataFrame:
    """key, score: occurrences of all terms in a column, the rows with any."""
    text = F.lower(column)
    score = sum(((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t) for t in terms), F.lit(0))
    return entries.select("key", score.cast("int").alias("score")).where("score > 0")


def contains(entries: DataFrame, needle: str, column: str) -> DataFrame:
    return entries.where(F.lower(column).contains(needle.lower()))


# Surrogate ids


def canonical(x: Column | str, width: int = 5) -> Column:
    """Digits after an optional ID prefix, zeros in front dropped, padded to width but never cut; null if it is no id."""
    digits = F.nullif(F.regexp_extract(F.col(x) if isinstance(x, str) else x, r"^(?:[Ii][Dd])?\s*0*(\d+)$", 1), F.lit(""))
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def inverted(ids: DataFrame) -> DataFrame:
    """char, ids (sorted) of (id, char)."""
    return ids.groupBy("char").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def surrogates(ids: DataFrame, start: int = 0xF0000, last: int = 0xFFFFD, strict: bool = False) -> DataFrame:
    """id, rank, codepoint in the order of ids; beyond the private range a null codepoint or, if strict, an error. Ranks come in two steps, so that no
    task sorts all ids: counts by the id's head, then ranks within it."""
    heads = ids.select("id", F.substring("id", 1, 3).alias("head")).distinct()
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    counts = heads.groupBy("head").agg(F.count("*").alias("n")).select("head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = heads.withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("id"))).join(counts, "head")
    rank = F.col("base") + F.col("r") - 1
    beyond = F.raise_error(F.lit("more ids than private code points")).cast("long") if strict else F.lit(None).cast("long")
    return ranked.select("id", rank.alias("rank"), F.when(rank + start <= last, rank + start).otherwise(beyond).alias("codepoint"))


def character(codepoint: Column | str) -> Column:
    """The character of a code point of any plane."""
    return F.decode(F.unhex(F.lpad(F.hex(codepoint), 8, "0")), "UTF-32")


def encoded(sequences: DataFrame, table: DataFrame, unknown: str = "[UNK]", strict: bool = False, whole: bool = False) -> DataFrame:
    """id, encoded of sequences (id, parts: ids): the characters of table (id, codepoint), without anything between them; an id that it
    lacks is unknown or, if strict, an error. So is one that it has without a code point, unless whole: then the text is null. An empty sequence is an empty text."""
    known = table.where(F.lit(whole) | F.col("codepoint").isNotNull()).select(F.col("id").alias("part"), character("codepoint").alias("c"), F.col("codepoint").isNull().alias("beyond"))
    rows = sequences.select("id", F.posexplode_outer("parts").alias("pos", "part")).join(known, "part", "left")
    missing = F.raise_error(F.concat(F.lit("unknown id: "), "part")) if strict else F.lit(unknown)
    c = F.when(F.col("part").isNull(), "").when(F.col("c").isNull(), missing).otherwise(F.col("c"))
    return rows.groupBy("id").agg(F.when(~F.coalesce(F.bool_or("beyond"), F.lit(False)), in_order("pos", c, "")).alias("encoded"))


def decoded(texts: DataFrame, table: DataFrame, unknown: str = "[UNK]") -> DataFrame:
    """id, parts of texts (id, encoded): the id of each character; the unknown mark and characters outside table are unknown."""
    known = table.where("codepoint is not null").select(character("codepoint").alias("c"), F.col("id").alias("part"))
    symbols = F.regexp_extract_all("encoded", F.lit(rf"(?s)(\Q{unknown}\E|.)"), F.lit(1))
    rows = texts.select("id", F.posexplode_outer(symbols).alias("pos", "c")).join(known, "c", "left")
    part = F.when(F.col("c").isNotNull(), F.coalesce("part", F.lit(unknown)))
    return rows.groupBy("id").agg(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("x")))), lambda s: s["x"]), lambda x: x.isNotNull()).alias("parts"))


def in_order(pos: str, value: Column, separator: str = " ") -> Column:
    """Aggregate: values joined in the order of pos."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos), value.alias("x")))), lambda s: s["x"]), separator)


def from_maps(meanings: DataFrame, readings: DataFrame) -> DataFrame:
    """Entries (row_idx, key, cn, en) of surrogate ids: characters' meanings (key, cn) with their readings (key, en) beside; the key's own
    order, empty where a map lacks the key."""
    both = meanings.join(readings, "key", "full")
    return both.select(F.xxhash64("key").alias("row_idx"), "key", F.coalesce("cn", F.lit("")).alias("cn"), F.coalesce("en", F.lit("")).alias("en"))


def rewritten(records: DataFrame, column: str, table: DataFrame, key: str) -> DataFrame:
    """records with column's id sequence encoded and what it was kept in <column>_ids; null where an id of table is beyond the private range."""
    own = encoded(records.select(F.col(key).alias("id"), parsed(column).alias("parts")), table, whole=True).select(F.col("id").alias(key), F.struct("encoded").alias("__e"))
    text = F.when(F.col("__e").isNull(), "").otherwise(F.col("__e.encoded"))
    return records.join(own, key, "left").withColumn(f"{column}_ids", F.col(column)).withColumn(column, text).drop("__e")


def glosses(texts: DataFrame, entries: DataFrame, longest: int = LONGEST, unknown: str = "?") -> DataFrame:
    """id, gloss: the first meaning of each longest match, in order, of entries (key, cn); words in none are unknown."""
    first = entries.groupBy("key").agg(F.min_by("cn", "row_idx").alias("cn"))
    segments = forward_matches(texts, first, longest).select("id", F.posexplode_outer("segments").alias("pos", "s"))
    rows = segments.select("id", "pos", F.col("s.segment").alias("key")).join(first, "key", "left")
    return rows.groupBy("id").agg(in_order("pos", F.when(F.col("key").isNull(), "").otherwise(F.coalesce(F.nullif(F.col("cn"), F.lit("")), F.lit(unknown)))).alias("gloss"))


def parsed(x: Column | str) -> Column:
    """The parts of an id sequence."""
    return F.filter(F.split(F.col(x) if isinstance(x, str) else x, r"[\s,;|]+"), lambda p: p != "")


# Rules by column


def reverse_index(entries: DataFrame) -> DataFrame:
    """keyword, keys (in file order, repeats kept) of entries (row_idx, key, cn, en): cn is cut at its stops, and parts of digits and bracket marks only are
    dropped; en is cut at blanks and stops and lower-cased, and numbers stay. An entry's cn comes before its en."""
    cn = _keywords(entries, F.col("cn"), "[，。！？；：]+", "^[0-9【】]+$").withColumn("side", F.lit(0))
    en = _keywords(entries, F.lower("en"), r"[\s.,;]+").withColumn("side", F.lit(1))
    out = cn.unionByName(en)
    ordered = out.groupBy("keyword").agg(F.array_sort(F.collect_list(F.struct("row_idx", "side", "pos", "key"))).alias("k"))
    return ordered.select("keyword", F.transform("k", lambda x: x["key"]).alias("keys"))


def segmented(texts: DataFrame, lexicon: DataFrame, unknown: int, longest: int = 4) -> DataFrame:
    """text, words of distinct texts (text): the path of least cost over the graph of lexicon's words (word, cost) in the text; a character alone costs unknown.

    Of paths of equal cost the one with fewer words, then the one with the longer last word. Words up to longest characters are found by an equi-join of
    runs; the path is a fold over the places of a text, whose state is the best way to each.
    """
    own = texts.select("text").where("text is not null").distinct()
    runs = own.select("text", F.explode(F.expr(f"flatten(transform(sequence(1, greatest(length(text), 1)), i -> transform(sequence(1, least({longest}, length(text) - i + 1)), n -> struct(i - 1 AS start, i - 1 + n AS end, substring(text, i, n) AS word))))")).alias("r")).where("text <> ''").select("text", "r.*")
    costs = lexicon.groupBy("word").agg(F.min("cost").cast("long").alias("cost"))
    edges = runs.join(costs, "word", "left").withColumn("cost", F.coalesce("cost", F.when(F.col("end") == F.col("start") + 1, F.lit(unknown).cast("long")))).where("cost is not null")
    graph = edges.groupBy("text").agg(F.collect_list(F.struct("end", "start", "cost")).alias("edges"))
    step = """aggregate(sequence(1, length(text)), array(named_struct('cost', 0L, 'n', 0, 'start', 0)), (best, p) -> array_append(best,
      array_min(transform(filter(edges, e -> e.end = p), e -> named_struct('cost', best[e.start].cost + e.cost, 'n', best[e.start].n + 1, 'start', e.start)))))"""
    back = """reverse(aggregate(sequence(1, length(text)), named_struct('at', length(text), 'out', cast(array() AS array<string>)), (acc, p) -> CASE WHEN acc.at = 0 THEN acc ELSE
      named_struct('at', best[acc.at].start, 'out', array_append(acc.out, substring(text, best[acc.at].start + 1, acc.at - best[acc.at].start))) END, acc -> acc.out))"""
    found = graph.withColumn("best", F.expr(step)).select("text", F.expr(back).alias("words"))
    return found.unionByName(own.where("text = ''").select("text", F.array().cast("array<string>").alias("words")))


def reward_entries(entries: DataFrame, lexicon: DataFrame, unknown: int) -> DataFrame:
    """n_chars, key, tokens (sorted) of entries (key, cn): the words of all explanations of a key and the characters of words; keys by their length.

    What stands in brackets and marks are left out, blanks too; keys without any token, and null or empty ones, have no row.
    """
    bare = F.regexp_replace(F.regexp_replace("cn", r"[【\[（\(].*?[】\]）\)]", ""), r"(?U)[^\w\s]", "")
    pieces = entries.where("key <> ''").select("key", F.explode(F.split(bare, r"(?U)\s+")).alias("text")).where("text <> ''").distinct()
    words = segmented(pieces, lexicon, unknown)
    tokens = pieces.join(words, "text").select("key", F.explode("words").alias("word"))
    every = tokens.select("key", F.explode(F.array_append(F.filter(F.split("word", ""), lambda c: c != ""), F.col("word"))).alias("token"))
    return every.groupBy(F.length("key").alias("n_chars"), "key").agg(F.array_sort(F.collect_set("token")).alias("tokens"))


def flattened(groups: DataFrame, meta: DataFrame, ids: DataFrame, pattern: str, least: int, most: int) -> DataFrame:
    """item, group_pos, reason, ids, characters, labels of every group of groups (item, group_pos, category, pos, label).

    A character's label leads by meta (label, character) to its modern character, and by ids (character, ids: sorted) to the first of its ids. The reasons,
    of which the first that holds counts: no_sentence (the category does not match the pattern), missing_label or missing_id (whichever comes first in the
    group's order), length (not between least and most), duplicate (an earlier group, by item and place, has the same ids); else kept.
    """
    first = ids.select("character", F.get("ids", F.lit(0)).alias("id")).where("id is not null")
    labels = meta.groupBy("label").agg(F.min("character").alias("character"))
    rows = groups.join(_looked_up(labels), "label", "left").join(_looked_up(first), "character", "left")
    why = F.when(F.col("character").isNull(), "missing_label").when(F.col("id").isNull(), "missing_id")
    chars = F.array_sort(F.collect_list(F.struct("pos", "label", "character", "id", why.alias("why"))))
    found = rows.groupBy("item", "group_pos").agg(F.min("category").alias("category"), chars.alias("chars"))
    of = lambda name: F.transform("chars", lambda c: c[name])
    failed = F.get(F.filter(of("why"), lambda w: w.isNotNull()), F.lit(0))
    found = found.select("item", "group_pos", F.filter(of("id"), lambda x: x.isNotNull()).alias("ids"), of("character").alias("characters"), of("label").alias("labels"),
        F.when(~F.coalesce(F.col("category").rlike(pattern), F.lit(False)), "no_sentence").otherwise(F.coalesce(failed, F.when(~F.size("chars").between(least, most), "length"))).alias("reason"))
    whole = found.where("reason is null").groupBy("ids").agg(F.min(F.struct("item", "group_pos")).alias("first"))
    kept = found.where("reason is null").join(whole, "ids").withColumn("reason", F.when(F.struct("item", "group_pos") == F.col("first"), "kept").otherwise("duplicate"))
    return kept.select(*found.columns).unionByName(found.where("reason is not null"))
