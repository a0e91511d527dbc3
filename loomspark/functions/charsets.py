"""Character sets and word lists as parameters: two profiles, one for classical titles and one for Latin text."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Charset:
    """What selectors and diagnostics look for. Patterns must mean the same in Java, RE2 and Python."""

    suffixes: str
    numerals: str
    contamination: str
    markers: tuple[str, ...] = ()
    punctuation: str = ""
    subjects: tuple[str, ...] = ()
    narrative: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    artifacts: str = ""
    extra: dict[str, str] = field(default_factory=dict)


#: For Latin text.
LATIN = Charset(
    suffixes="ensdt",
    numerals="0123456789",
    contamination=r"[<>]|\[UNK\]",
    markers=("ly ", "which", "PROMO"),
    punctuation=".!?",
    subjects=("he ", "she "),
    narrative=("then", "green"),
    terms=("blue", "steel", "BRASS", "ECONOMY"),
    artifacts=r"(?:translation|analysis)",
)

#: For classical titles. The suffixes, numerals, markers and terms that selectors and diagnostics of such titles look for.
CLASSICAL = Charset(
    suffixes="經論記疏頌儀義傳錄贊序字品文觀根次門",
    numerals="零〇一二三四五六七八九十百千萬两兩",
    contamination=r"(?i)[A-Za-z<>]|\[UNK\]|assistant|manuals|networks|shows|grat|dresses",
    markers=("。", "，", "：", "；", "、", "即", "是", "这是", "指", "名"),
    punctuation="。，；：、",
    subjects=("范宁", "范玄平", "张玄", "王忱", "两人", "人在"),
    narrative=("在路", "路上", "说", "曰", "见", "问", "对", "乃"),
    terms=("佛", "菩薩", "般若", "陀羅尼", "華嚴", "金剛", "地藏", "彌勒", "孔雀", "禪定"),
    artifacts=r"(?i)assistant|manuals|networks|shows|grat|dresses",
)
