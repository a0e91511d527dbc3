"""A small corpus with every odd case: nulls, empty and long texts, copies, near copies, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, row int, node string, part int, spans string"
ITEM = "the quick item asks which of these seven answers is the right one for all"


def words(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice("abcdeéüo") for _ in range(rnd.randint(2, 6))) for _ in range(n))


def corpus() -> list[tuple]:
    rnd = random.Random(11)
    texts: list[tuple[int | None, str | None]] = [(i, words(rnd, rnd.randint(1, 120))) for i in range(40)]
    base = words(rnd, 90)
    texts += [(40, base), (41, base), (42, base + " tail")]
    for i in range(43, 60):  # near copies at and around the threshold
        ws = base.split()
        for k in rnd.sample(range(90), i % 6):
            ws[k] = "edit%d" % rnd.randint(0, 9)
        texts.append((i, " ".join(ws)))
    passage = words(rnd, 40)
    texts += [(60, f"{words(rnd, 9)} {passage} {words(rnd, 9)}"), (61, f"{passage}\n{words(rnd, 5)}"), (62, passage)]
    texts += [(63, None), (64, ""), (65, "   \n\t "), (66, "one"), (67, "ONE"), (68, "a b c d"), (69, "A b  C\nd")]
    texts += [(70, f"{words(rnd, 20)} {ITEM.upper()} {words(rnd, 3)}"), (71, ITEM), (72, " ".join(ITEM.split()[:9])), (73, "x" * 60 + "y" * 70 + "x" * 60), (74, "line one is here\n" * 30)]
    texts += [(5, texts[5][1]), (5, "another text of the same id"), (None, base), (None, "no id " + words(rnd, 60)), (75, "é" * 80), (76, "日本語のテキスト" * 12), (77, words(rnd, 4000)), (78, "<|endoftext|> İΣς  ﬁ\x1c 12'LL"), (-3, passage)]
    return [(i, t, "xx" if i is None else "en" if i % 3 else "fr", "s", 1, 7, "n", 1, "z") for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows(docs):
    return docs.collect()
