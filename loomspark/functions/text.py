"""Scalar text operators as Column expressions. Strings are code points; null in, null out unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def first_filled(*xs: Column | str) -> Column:
    """The first that is neither null nor empty; else the empty string."""
    return F.coalesce(*(F.nullif(_c(x), F.lit("")) for x in xs), F.lit(""))


def within(x: Column | str, least: int = 4, most: int = 64) -> Column:
    """Whether the length is in range; false for null."""
    return F.coalesce(F.length(_c(x)).between(least, most), F.lit(False))


def strip_tags(x: Column | str, tags: Sequence[str] = ("dict_match", "literal")) -> Column:
    """Without <tag>...</tag> on one line, shortest first; trimmed."""
    out = _c(x)
    for tag in tags:
        out = F.regexp_replace(out, f"<{tag}>.*?</{tag}>", "")
    return strip(out)


def tagged(x: Column | str, tag: str = "literal") -> Column:
    """The first <tag>'s content over lines, trimmed; without one, the text without tags."""
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(_c(x).rlike(pattern), strip(F.regexp_extract(_c(x), pattern, 1))).otherwise(strip_tags(x))


def short_title(x: Column | str, markers: Sequence[str] = ()) -> Column:
    """A title from a wordy answer: no tags, Latin letters or blanks; up to the first sentence end; a long one up to its first
    comma; up to the first marker that has at least two characters before it; trimmed of commas and colons."""
    out = F.regexp_replace(F.regexp_replace(strip_tags(x), "[A-Za-z]+", ""), r"(?U)\s+", "")
    out = F.regexp_extract(out, "(?s)^([^。！？!?\n]*)", 1)
    out = F.when((F.length(out) > 12) & out.contains("，"), F.substring_index(out, "，", 1)).otherwise(out)
    cut = F.lit(None).cast("string")
    for marker in reversed(markers):
        at = F.instr(out, marker)
        cut = F.when(at >= 3, F.substring_index(out, marker, 1)).otherwise(cut)
    return F.regexp_replace(F.coalesce(cut, out), "^[ ，,;；:：]+|[ ，,;；:：]+$", "")


def unfenced(x: Column | str) -> Column:
    """Without a code fence around it."""
    return strip(F.regexp_replace(strip(x), r"(?s)^```[A-Za-z]*\s*|\s*```$", ""))


def json_body(x: Column | str) -> Column:
    """From the first { to the last }, fence or not; null without."""
    return F.nullif(F.regexp_extract(unfenced(x), r"(?s)(\{.*\})", 1), F.lit(""))


def answer(x: Column | str, keys: Sequence[str] = ("final_title", "title", "answer"), labels: str = "(?:Answer|Title|Translation)") -> Column:
    """One line from a model's reply: a JSON field, else the first filled line without label, quotes and title marks."""
    body = json_body(x)
    field = F.coalesce(*(F.nullif(F.get_json_object(body, f"$.{k}"), F.lit("")) for k in keys))
    lines = F.filter(F.transform(F.split(unfenced(x), "\n"), strip), lambda s: s != "")
    line = F.coalesce(field, F.get(lines, F.lit(0)), F.lit(""))
    line = strip(F.regexp_replace(line, f"^{labels}\\s*[:：]\\s*", ""))
    line = F.regexp_replace(line, "^[\"'“”]+|[\"'“”]+$", "")
    return F.regexp_replace(line, "^《([^》]*)》$", "$1")


def clamped(x: Column | str, low: int = 1, high: int = 5, default: int = 3) -> Column:
    """An integer in range; what is none counts as default."""
    value = _c(x).try_cast("int")
    return F.when(value.isNull(), default).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), value)))


def field_score(x: Column | str, key: str, default: int = 3) -> Column:
    """A score from JSON, else from "key: n" anywhere; clamped."""
    loose = F.nullif(F.regexp_extract(_c(x), f'"?{key}"?\\s*[:=]\\s*([1-5])', 1), F.lit(""))
    return clamped(F.coalesce(F.get_json_object(json_body(x), f"$.{key}"), loose), default=default)


def choice(x: Column | str, valid: Column) -> Column:
    """A choice letter: the first capital that is a word of its own, anywhere; else JSON's basis; else "basis: L" in any
    case and with or without quotes. Each counts only if it is among valid; null if none is."""
    alone = F.nullif(F.regexp_extract(_c(x), r"(?U)\b([A-Z])\b", 1), F.lit(""))
    basis = F.upper(strip(F.get_json_object(json_body(x), "$.basis")))
    loose = F.upper(F.nullif(F.regexp_extract(_c(x), r'(?i)"?basis"?\s*[:=]\s*"?([A-Z])"?', 1), F.lit("")))
    ok = lambda c: F.when(F.array_contains(valid, c), c)
    return F.coalesce(ok(alone), ok(basis), ok(loose))


def without_brackets(x: Column | str) -> Column:
    """Without bracketed spans and marks."""
    out = F.regexp_replace(_c(x), r"\([^)]*\)|\[[^\]]*\]|（[^）]*）|【[^】]*】|<[^>]*>", "")
    return F.regexp_replace(out, r"(?U)[^\w\s]", "")


def plain_explanation(x: Column | str) -> Column:
    """Brackets' content out, marks to blanks, blanks squeezed."""
    out = F.regexp_replace(_c(x), r"\([^)]*\)|\[[^\]]*\]|【[^】]*】", " ")
    return strip(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def signature(x: Column | str, keep: str) -> Column:
    """Only the characters of keep."""
    return F.regexp_replace(_c(x), f"[^{keep}]", "")


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """The longest common start."""
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, 1) != F.substring(b, i, 1))
    return F.when(n == 0, F.lit("")).otherwise(F.substring(a, F.lit(1), F.coalesce(F.get(differs, F.lit(0)) - 1, n)))


def common_suffix(a: Column | str, b: Column | str) -> Column:
    return F.reverse(common_prefix(F.reverse(_c(a)), F.reverse(_c(b))))


def is_subsequence(short: Column | str, long: Column | str) -> Column:
    """Whether long has short's characters in order."""
    short, long = _c(short), _c(long)
    chars = F.filter(F.split(long, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda at, c: F.when((at < F.length(short)) & (F.substring(short, at + 1, F.lit(1)) == c), at + 1).otherwise(at)) == F.length(short)


def characters(x: Column | str) -> Column:
    """The code points of a text, one string each."""
    return F.filter(F.split(_c(x), ""), lambda c: c != "")


def runs(parts: Column, n: int, separator: str) -> Column:
    """Every n parts in a row, joined; none if there are fewer. Shifted copies of the array are zipped, so a text takes time in proportion to its length."""
    out = parts
    for k in range(1, n):
        out = F.zip_with(out, F.slice(parts, k + 1, F.greatest(F.size(parts), F.lit(1))), lambda a, b: F.concat(a, F.lit(separator), b))
    return F.array_compact(out)


def char_ngrams(x: Column | str, n: int) -> Column:
    """Distinct n-grams of characters; none if shorter."""
    return F.array_distinct(runs(characters(x), n, ""))


def after(x: Column | str, mark: str = "</literal> ") -> Column:
    """What follows the first mark; without one, all."""
    at = F.instr(_c(x), mark)
    return F.when(at > 0, F.substring(_c(x), at + len(mark), F.length(_c(x)))).otherwise(_c(x))


def after_line(x: Column | str) -> Column:
    """What follows the first line break; without one, all."""
    return F.substring(_c(x), F.instr(_c(x), "\n") + 1, F.length(_c(x)))


def chat_sample(instruction: Column | str, user: Column | str, reply: Column | str) -> Column:
    """One training text of a turn pair."""
    return F.concat(F.lit("<|user|>\n"), _c(instruction), F.lit("\n"), _c(user), F.lit("\n<|assistant|>\n"), _c(reply))


def mapped(x: Column | str, table: dict[str, str]) -> Column:
    """Each character by a table."""
    return F.translate(_c(x), "".join(table), "".join(table.values()))


def normalised(x: Column | str, low: float, high: float, log: bool = False) -> Column:
    """Clipped to 0..1 over a range, of the logarithm on request; null and NaN are 0."""
    value = F.log10(_c(x)) if log else _c(x)
    scaled = (value - low) / (high - low)
    return F.when(scaled.isNull() | F.isnan(scaled), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Null where there is no quotient."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def chat_prompt(system: Column | str, user: Column | str) -> Column:
    """A prompt of turns between marks, open for the assistant's."""
    turn = lambda role, x: F.concat(F.lit(f"<|im_start|>{role}\n"), _c(x), F.lit("<|im_end|>\n"))
    return F.concat(turn("system", system), turn("user", user), F.lit("<|im_start|>assistant\n"))


def chat_turns(system: Column | str, user: Column | str, reply: Column | str) -> Column:
    """The same with the assistant's turn closed, as a training text."""
    return F.concat(chat_prompt(system, user), _c(reply), F.lit("<|im_end|>"))


def gloss_line(key: Column | str, known: Column, cn: Column | str, en: Column | str, reading: Column | str, unknown: str = "[未知]", missing: str = "[未收录]", label: str = "拟音") -> Column:
    """One line of a gloss block: the meaning, with (english) and [label: reading] where there are any; unknown without a meaning, missing without an entry."""
    filled = lambda x: F.coalesce(_c(x), F.lit("")) != ""
    meaning = F.when(filled(cn), _c(cn)).otherwise(unknown)
    more = F.concat(F.when(filled(en), F.concat(F.lit(" ("), _c(en), F.lit(")"))).otherwise(""), F.when(filled(reading), F.concat(F.lit(f" [{label}: "), _c(reading), F.lit("]"))).otherwise(""))
    return F.concat(F.lit("  "), _c(key), F.lit(" = "), F.when(known, F.concat(meaning, more)).otherwise(missing))
