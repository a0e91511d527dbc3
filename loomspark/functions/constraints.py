"""Phrases that a decoder must produce, chosen from dictionary explanations, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text
from .charsets import CLASSICAL

IDEOGRAPHS = r"[\x{4E00}-\x{9FFF}]+"
#: Simplified characters that explanations hold, and the traditional ones of titles.
TRADITIONAL = {
    "说": "説", "圣": "聖", "萨": "薩", "经": "經", "论": "論", "记": "記", "颂": "頌", "仪": "儀", "义": "義", "传": "傳", "录": "錄",
    "赞": "贊", "观": "觀", "门": "門", "罗": "羅", "启": "啟", "显": "顯", "华": "華", "怀": "懷", "贞": "貞", "数": "數", "围": "圍",
}
#: The numerals of phrases; characters that mean nothing alone; phrases and last characters that are no content; signs of alternatives.
NUMERALS = "零〇一二三四五六七八九十百千萬兩"
SINGLETONS = ("其", "于", "與", "为", "為", "做", "使", "全", "都", "共", "同", "此", "彼", "所", "之", "者")
NO_CONTENT = ("次序", "印信", "印信烙", "發語詞", "发语词", "範圍", "范围", "全都", "共同", "頌偈", "女性", "巧女")
NO_TAILS = ("序", "詞", "词", "類", "类", "性", "烙")
ALTERNATIVES = "[、；;/]|[0-9]|具有|表示|之义|之義|结合|結合|如果|以及|或者|并|並"
NOISE, BRACKET, TITLE = r"\[[^\]]*\]|\([^)]*\)|（[^）]*）", "【([^】]+)】", "《([^》]+)》"


def traditional(x: Column | str) -> Column:
    """The gloss normaliser: simplified characters become traditional ones; null is empty."""
    return text.mapped(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), TRADITIONAL)


def plain(x: Column | str) -> Column:
    """A normalised gloss without what stands in brackets."""
    return text.strip(F.regexp_replace(F.regexp_replace(traditional(x), NOISE, ""), BRACKET, ""))


def _all(x: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def title_suffix(x: Column | str, suffixes: str = CLASSICAL.suffixes) -> Column:
    """The suffix character that an explanation names: of the last run of ideographs with one, the first; else that of a scripture; else of the last title, the last. Null if none."""
    trad, filled = traditional(x), lambda xs: F.filter(xs, lambda c: c != "")
    runs = filled(F.transform(_all(plain(x), IDEOGRAPHS, 0), lambda r: F.regexp_extract(r, f"[{suffixes}]", 0)))
    titles = filled(F.transform(_all(trad, TITLE, 1), lambda t: F.regexp_extract(t, f"(?s)^.*([{suffixes}])", 1)))
    last = lambda xs: F.try_element_at(xs, F.lit(-1))
    return F.coalesce(last(runs), F.when(trad.contains("佛經"), "經"), last(titles))


def content(x: Column | str) -> Column:
    """array<struct<phrase, score>>: a short gloss in brackets that stands alone, and a short gloss without alternatives."""
    clean = plain(x)
    gloss = F.filter(F.transform(_all(traditional(x), BRACKET, 1), lambda b: F.array_join(_all(b, IDEOGRAPHS, 0), "")), lambda b: b != "")
    alone = F.try_element_at(gloss, F.lit(1))
    first = F.when((F.size(gloss) == 1) & (clean == "") & F.length(alone).between(1, 2) & ~alone.isin(*SINGLETONS), F.struct(alone.alias("phrase"), F.lit(30).alias("score")))
    bare = F.regexp_replace(clean, TITLE, "")
    runs = _all(bare, IDEOGRAPHS, 0)
    one = F.try_element_at(runs, F.lit(1))
    good = (F.size(runs) == 1) & ~bare.rlike(ALTERNATIVES) & F.length(one).between(1, 2) & ~one.isin(*SINGLETONS, *NO_CONTENT) & ~F.right(one, F.lit(1)).isin(*NO_TAILS)
    score = F.when(F.length(one) == 2, 24).otherwise(18) + F.when(one.rlike(f"^[{NUMERALS}]+$"), 3).otherwise(0)
    return F.array_compact(F.array(first, F.when(good, F.struct(one.alias("phrase"), score.alias("score")))))


def allowed_phrases(outputs: Column | str) -> Column:
    """Distinct runs of one and two ideographs of a corpus target."""
    chars = text.characters(traditional(outputs))
    return F.array_distinct(F.filter(F.concat(text.runs(chars, 1, ""), text.runs(chars, 2, "")), lambda p: p.rlike(r"^[\x{4E00}-\x{9FFF}]+$")))


def chosen_phrases(glosses: DataFrame, allowed: DataFrame, most: int = 2, suffixes: str = CLASSICAL.suffixes) -> DataFrame:
    """id, selected, suffix, phrases, attempts of glosses (id, pos, explanation), the dictionary matches of a text in order from 0.

    Candidates that are no numerals must be among allowed (phrase); suffix characters alone are none. A candidate's score falls with its place.
    The best most of them are selected, none within another; the last suffix is added. attempts are the back-offs: all, the last one, none.
    A text whose matches have no explanation has no phrases, and one attempt without any.
    """
    rows = glosses.select("id", "pos", title_suffix("explanation", suffixes).alias("suffix"), F.explode_outer(content("explanation")).alias("c")).select("id", "pos", "suffix", "c.*")
    known = allowed.select("phrase", F.lit(True).alias("ok")).distinct()
    rows = rows.join(known, "phrase", "left")
    able = F.col("phrase").isNotNull() & (F.col("phrase").rlike(f"^[{NUMERALS}]+$") | F.col("ok").isNotNull()) & ~((F.length("phrase") == 1) & (F.instr(F.lit(suffixes), F.col("phrase")) > 0))
    place = F.struct((-(F.col("score") + F.least(F.length("phrase"), F.lit(2)) * 4 - F.col("pos"))).alias("minus"), "pos", "phrase")
    found = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.when(able, place))).alias("ranked"), F.max_by("suffix", F.when(F.col("suffix").isNotNull(), F.col("pos"))).alias("suffix"))
    clash = lambda acc, p: F.exists(acc, lambda c: c.contains(p) | p.contains(c))
    fold = F.aggregate("ranked", F.array().cast("array<string>"), lambda acc, x: F.when((F.size(acc) < most) & ~clash(acc, x["phrase"]), F.array_append(acc, x["phrase"])).otherwise(acc))
    found = found.select("id", fold.alias("selected"), "suffix")
    more = F.col("suffix").isNotNull() & ~F.array_contains("selected", F.col("suffix"))
    found = found.withColumn("phrases", F.when(more, F.array_append("selected", F.col("suffix"))).otherwise(F.col("selected")))
    return found.withColumn("attempts", attempts("phrases"))


def attempts(phrases: Column | str) -> Column:
    """Back-offs of a list of phrases, without repeats: all of them, the last one, none."""
    p, none = F.col(phrases) if isinstance(phrases, str) else phrases, F.array().cast("array<string>")
    last = F.when(F.size(p) > 1, F.array(F.element_at(p, F.lit(-1))))
    return F.array_distinct(F.array_compact(F.array(p, last, none)))
