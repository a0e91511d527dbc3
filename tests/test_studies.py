"""Operators of audits, studies and grounding against plain Python, on small and odd rows."""

from __future__ import annotations

import itertools
import json
import random
import subprocess
import sys
from collections import Counter
from difflib import SequenceMatcher
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.functions import constraints, matching, text
from loomspark.operators import corpora, dictionary, reports, resample, setjoin
from loomspark.sources import io


def _sets(rnd: random.Random, n: int, common: str) -> list[tuple]:
    words = [str(k) for k in range(rnd.choice([8, 40, 300]))]
    return [(k, sorted({*rnd.choices(words, k=rnd.randint(0, 12)), *([common] if rnd.random() < 0.6 else [])})) for k in range(n)]


@pytest.mark.parametrize(("few", "levels", "hot"), [(4, (0.5, 0.15, 0.0), 10), (0, (0.5, 0.15, 0.0), 10), (0, (0.9, 0.4, 0.1, 0.0), 1), (0, (0.0,), 3)])
def test_best_matches(spark, monkeypatch, few, levels, hot):
    """All branches, with an element that more than half of all sets hold, blocks of three sets, repeated ids, nulls and empty sets."""
    for name, value in (("FEW", few), ("LEVELS", levels), ("HOT", hot), ("BLOCK", 3), ("HEAVY", 5)):
        monkeypatch.setattr(setjoin, name, value)
    rnd = random.Random(few + hot)
    left = [*_sets(rnd, 80, "often"), (0, ["often"]), (None, None), (500, []), (501, [None])]
    right = [*_sets(rnd, 120, "often"), (5, None), (6, ["often", "q"]), (7, ["often", "q"])]
    schema = "id int, grams array<string>"
    one = lambda g: max((len(set(g) & set(h)) / len(set(g) | set(h)) for _, h in right if h), default=0.0) if g and g != [None] else 0.0
    got = setjoin.best_jaccard(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()
    assert Counter((r[0], round(r[1], 9)) for r in got) == Counter((i, round(one(g), 9)) for i, g in left)


@pytest.mark.parametrize(("few", "levels", "hot"), [(4, (0.5, 0.15, 0.0), 10), (0, (0.5, 0.15, 0.0), 10), (0, (0.9, 0.4, 0.1, 0.0), 1), (0, (0.0,), 3)])
def test_best_matches_of_many_sets_that_ask(spark, monkeypatch, few, levels, hot):
    """The same where tasks don't hold the sets that ask."""
    monkeypatch.setattr(setjoin, "ASKING", 0)
    test_best_matches(spark, monkeypatch, few, levels, hot)


@pytest.mark.parametrize("cells", [1, 300])
def test_best_matches_in_pieces(spark, monkeypatch, cells):
    monkeypatch.setattr(setjoin, "CELLS", cells)
    test_best_matches(spark, monkeypatch, 4, (0.5, 0.15, 0.0), 10)


def test_a_pool_is_compared_where_it_is_read(spark, monkeypatch):
    """Its sets are neither written nor shuffled if few sets ask; groups, copies, nulls and sets without a match included."""
    written = []
    monkeypatch.setattr(setjoin, "materialised", lambda df, name: written.append(df.count()) or df)
    left = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["x", "y"]), (3, "b", ["x", "y"]), (4, "b", ["none"]), (5, "b", None)], "id int, group string, grams array<string>")
    own = spark.range(3000).select("id", F.lit("a").alias("group"), F.array(F.lit("x"), F.lit("x"), F.lit(None), F.col("id").cast("string")).alias("grams"))
    right = own.unionAll(spark.createDataFrame([(0, "b", ["x", "y", "z"]), (0, "b", None), (0, "b", []), (0, "c", ["none"])], "id long, group string, grams array<string>"))
    got = setjoin.best_jaccard(left, right, grouped=True)
    assert {(i, g, round(b, 9)) for i, g, b in got.collect()} == {(1, "a", 0.333333333), (2, "b", 0.666666667), (3, "b", 0.666666667), (4, "b", 0.0), (5, "b", 0.0)}
    assert written == [3]


def test_best_matches_by_group(spark):
    left = spark.createDataFrame([(1, "a", ["x", "y"]), (1, "b", ["x", "y"]), (2, "c", ["x"])], "id int, group string, grams array<string>")
    right = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["x", "y"])], "id int, group string, grams array<string>")
    assert {tuple(r) for r in setjoin.best_jaccard(left, right, grouped=True).collect()} == {(1, "a", 0.5), (1, "b", 1.0), (2, "c", 0.0)}
    assert {r[2] for r in setjoin.best_jaccard(left, right.limit(0), grouped=True).collect()} == {0.0}


def test_pairs_stay_linear_with_a_frequent_element(spark):
    n = 400
    sets = spark.range(n).select(F.col("id"), F.array(F.lit("often"), F.concat(F.lit("own"), F.col("id").cast("string"))).alias("grams"))
    ids, mine = setjoin._distinct(sets.withColumn("group", F.lit("")))
    counts = mine.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    hot = [r["gram"] for r in counts.where("df > 1").collect()]
    often = counts.where(F.col("gram").isin(hot)).select("gram", "df", F.lit(0).alias("bit"))
    rest = counts.where(~F.col("gram").isin(hot)).select(F.concat(F.lit("="), "gram").alias("key"), F.col("df").alias("rest_df"))
    ordered = setjoin._ordered(mine, often, rest)
    assert setjoin.candidates(ordered.withColumn("best", F.lit(0.0)), ordered, 0.0, hot).count() == n


def _drawn(n: int, resamples: int, stream: int, block: int, seed: int = 42) -> list[Counter]:
    """The draws of each resample, one by one."""
    mix = lambda x: int(resample.mixed(np.int64(x)))
    out = []
    for s in range(resamples):
        key = stream * resamples + s
        start, seen, rows = mix((seed + key) & resample.MASK), Counter(), Counter()
        for j in range(n):
            b = ((mix((start + j) & resample.MASK) * n) >> 32) // block
            size = min(block, n - b * block)
            own = mix((start + b + resample.PLACE) & resample.MASK)
            rows[b * block + ((mix((own + seen[b]) & resample.MASK) * size) >> 32)] += 1
            seen[b] += 1
        out.append(rows)
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_bootstrap(spark, monkeypatch, block):
    for name, value in (("BLOCK", block), ("RANGE", 7 if block == 16 else 1 << 18), ("CHUNK", 3)):
        monkeypatch.setattr(resample, name, value)
    n, k = 45, 10
    rows = [(s, t, i, float(i * i % 17), float(i % 5)) for s, t in (("a", 0), ("b", 0), ("c", 1)) for i in range(n) if (s, i) != ("b", 3)]
    df = spark.createDataFrame(rows, "system string, stream int, idx long, x double, y double")
    got = {(r["sample"], r["system"]): (r["x"], r["y"]) for r in resample.bootstrap(df, ["x", "y"], n, k, streams=2).collect()}
    want = {}
    for stream in (0, 1):
        for s, drawn in enumerate(_drawn(n, k, stream, block)):
            assert drawn.total() == n
            for system in {r[0] for r in rows if r[1] == stream}:
                own = {r[2]: r[3:] for r in rows if r[0] == system}
                want[s, system] = tuple(sum(w * own.get(i, (0, 0))[c] for i, w in drawn.items()) for c in (0, 1))
    assert got == want


def test_draws_look_uniform():
    rows = sum(_drawn(200, 50, 0, 64), Counter())
    expected = 50
    assert sum((rows[i] - expected) ** 2 / expected for i in range(200)) < 270  # 199 degrees of freedom, about 3.5 deviations


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abc山é", max_size=14), st.text("abc山é", max_size=14)), max_size=12))
def test_ratios(pairs):
    assert matching.ratios([a for a, _ in pairs], [b for _, b in pairs]) == pytest.approx([SequenceMatcher(None, a, b).ratio() for a, b in pairs])


def test_ratios_of_long_strings():
    rnd, pairs = random.Random(6), []
    for size in (199, 200, 201, 350, 700):
        for letters in ("ab", " etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz0123456789"):
            a = "".join(rnd.choices(letters, k=size))
            b = list(a)
            for _ in range(40):
                b[rnd.randrange(len(b))] = rnd.choice(letters + "Z")
            pairs += [(a, "".join(b)), ("".join(b)[50:], a), (a, a)]
    assert matching.ratios([a for a, _ in pairs], [b for _, b in pairs]) == pytest.approx([SequenceMatcher(None, a, b).ratio() for a, b in pairs])


GLOSSES = {
    "【山】": (None, [("山", 30)]), "【其】": (None, []), "【山】x": (None, []), "《金剛論》": ("論", []), "佛经": ("經", [("佛經", 24)]), "三千": (None, [("三千", 27)]), "二": (None, [("二", 21)]),
    "水；火": (None, []), "清風（动）": (None, [("清風", 24)]), "次序": ("次", []), "义疏": ("義", [("義疏", 24)]), "": (None, []), None: (None, []), "风[x]": (None, [("风", 18)]), "《大經》水": (None, [("水", 18)]),
}


def test_glosses(spark):
    df = spark.createDataFrame([(x,) for x in GLOSSES], "x string").select("x", constraints.title_suffix("x").alias("s"), constraints.content("x").alias("c"))
    got = {r["x"]: (r["s"], [tuple(c) for c in r["c"]]) for r in df.collect()}
    want = dict(GLOSSES) | {"《大經》水": ("經", [("水", 18)])}
    assert got == want


def test_chosen_phrases(spark):
    glosses = [(1, 0, "清風"), (1, 1, "【清】"), (1, 2, "三千"), (1, 3, "山"), (1, 4, "經典"), (2, 0, None), (3, 0, "論"), (3, 1, "光明"), (4, 0, "經"), (4, 1, "水")]
    allowed = [("清風",), ("清",), ("山",), ("光明",), ("水",), ("經典",), (None,)]
    out = constraints.chosen_phrases(spark.createDataFrame(glosses, "id int, pos int, explanation string"), spark.createDataFrame(allowed, "phrase string"))
    got = {r["id"]: (r["selected"], r["suffix"], r["phrases"], r["attempts"]) for r in out.collect()}
    assert got[1] == (["清", "三千"], "經", ["清", "三千", "經"], [["清", "三千", "經"], ["經"], []])
    assert got[2] == ([], None, [], [[]])
    assert got[3] == (["光明"], "論", ["光明", "論"], [["光明", "論"], ["論"], []])
    assert got[4] == (["水"], "經", ["水", "經"], [["水", "經"], ["經"], []])


def test_segmented(spark):
    """The cheapest of all ways to cut a text, by trying them all."""
    lexicon = {"ab": 3, "bc": 3, "abc": 7, "cd": 2, "bcd": 4, "d": 1, "dd": 2}
    texts = ["".join(t) for n in range(5) for t in itertools.product("abcd", repeat=n)]

    def best(text: str) -> list[str]:
        ways = []
        for cuts in itertools.product([0, 1], repeat=max(0, len(text) - 1)):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
            words = [text[a:b] for a, b in itertools.pairwise(at)]
            if all(w in lexicon or len(w) == 1 for w in words):
                ways.append((sum(lexicon.get(w, 5) for w in words), len(words), at[-2::-1], words))
        return min(ways)[3] if text else []

    df = dictionary.segmented(spark.createDataFrame([(t,) for t in [*texts, "ab", None]], "text string"), spark.createDataFrame([*lexicon.items(), ("ab", 9)], "word string, cost int"), 5)
    assert {r["text"]: r["words"] for r in df.collect()} == {t: best(t) for t in texts}


def test_flattened(spark):
    groups = [(1, 0, "S", 2, "b"), (1, 0, "S", 1, "a"), (1, 1, "S", 1, "zz"), (1, 1, "S", 2, "q"), (2, 0, "S", 1, "q"), (2, 0, "S", 2, "zz"), (2, 1, "N", 1, "a"), (2, 2, None, 1, "a"), (3, 0, "S1", 1, "a"), (3, 0, "S1", 2, "b"), (4, 0, "S", 1, "a"), (5, 0, "S", 1, None)]
    meta, ids = [("a", "A"), ("b", "B"), ("q", "Q")], [("A", ["1", "2"]), ("B", ["3"]), ("Q", [])]
    out = dictionary.flattened(spark.createDataFrame(groups, "item int, group_pos int, category string, pos int, label string"), spark.createDataFrame(meta, "label string, character string"), spark.createDataFrame(ids, "character string, ids array<string>"), "^S", 2, 4)
    got = {(r["item"], r["group_pos"]): r["reason"] for r in out.collect()}
    assert got == {(1, 0): "kept", (1, 1): "missing_label", (2, 0): "missing_id", (2, 1): "no_sentence", (2, 2): "no_sentence", (3, 0): "duplicate", (4, 0): "length", (5, 0): "missing_label"}
    assert [r["ids"] for r in out.where("reason = 'kept'").collect()] == [["1", "3"]]


def test_looked_up_and_designs(spark):
    rows = spark.createDataFrame([("p",), ("q",), (None,)], "prompt string")
    files = [spark.createDataFrame(x, "order int, prompt string, output string") for x in ([(2, "p", "a2"), (1, "p", "a1")], [(0, "p", "b"), (5, None, "n")])]
    assert {tuple(r) for r in corpora.looked_up(rows, files, "gold").collect()} == {("p", "a1"), ("q", None), (None, None)}
    assert {tuple(r) for r in corpora.looked_up(rows, files, "gold", first=False).collect()} == {("p", "b"), ("q", None), (None, None)}
    literal, final = corpora.targets("x")
    texts = [("<literal> a b </literal>  c\nd ",), (" plain ",), (None,), ("<literal>x",)]
    assert [tuple(r) for r in spark.createDataFrame(texts, "x string").select(literal, final).collect()] == [("a b", "c\nd"), ("plain", "plain"), ("", ""), ("<literal>x", "<literal>x")]


CHILD = """
import json, os, sys
from pyspark.sql import SparkSession
from loomspark.streaming import resume
root, die = sys.argv[1], sys.argv[2] == "die"
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

def write(df, path):
    if die and path.endswith("batch=2"):  # some of the batch's rows are out, then the process is gone
        df.limit(1).write.mode("overwrite").json(path)
        os._exit(9)
    df.write.mode("overwrite").json(path)

resume.follow_batches(spark, f"file://{root}/in", "prediction", lambda x: x.select("input"), f"file://{root}/out", f"file://{root}/state", every=2, write=write).awaitTermination()
"""


def test_a_killed_run_goes_on(tmp_path):
    """A process dies in its third batch; the next one does that batch again and the rest: every record once."""
    (tmp_path / "in").mkdir()
    for k in range(9):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"input": f"{k}-{i}"}) + "\n" for i in range(3)))
    run = lambda how: subprocess.run([sys.executable, "-c", CHILD, str(tmp_path), how], cwd=Path(__file__).parents[1], capture_output=True, timeout=300).returncode
    out = lambda: [json.loads(line)["input"] for p in sorted((tmp_path / "out").rglob("*.json")) for line in p.read_text().splitlines()]
    assert run("die") == 9 and len(out()) == 13
    assert run("go") == 0 and sorted(out()) == sorted(f"{k}-{i}" for k in range(9) for i in range(3))
    assert run("go") == 0 and len(out()) == 27


def test_arrays_that_are_none(spark, tmp_path):
    (tmp_path / "good.json").write_text(' [{"prompt": "p", "chosen_reward": 1.5},\n {"prompt": "q"}]\n')
    (tmp_path / "bad.json").write_text('{"prompt": "p"}')
    assert [r["prompt"] for r in io.json_array(spark, str(tmp_path / "good.json"), "preference", strict=True).collect()] == ["p", "q"]
    with pytest.raises(Exception, match="no array"):
        io.json_array(spark, str(tmp_path / "bad.json"), "preference", strict=True).collect()


def test_reports(spark):
    rows = spark.createDataFrame([(k, "ab" if k % 3 else None, "s" if k % 2 else None) for k in range(40)], "id int, text string, split string")
    got = {r["split"]: (r["n"], [tuple(x) for x in r["lengths"]], [x["at"] for x in r["examples"]]) for r in reports.split_report(rows, "split", "text", "id").where("split is not null").collect()}
    assert got == {"s": (20, [(None, 7), (2, 13)], [1, 3, 5, 7, 9])}
    values = spark.createDataFrame([("a", 1.0), ("a", float("inf")), ("a", None), ("b", float("nan"))], "k string, x double")
    assert {tuple(r) for r in reports.finite_summary(values, "x", "k").collect()} == {("a", 3, 1.0, 1.0, 1.0, 2), ("b", 1, None, None, None, 1)}
    systems = spark.createDataFrame([("h", 2.0, 4.0), ("m", 1.0, 8.0), ("z", None, 0.0)], "system string, lex double, ppl double")
    table = {r["system"]: (r["relative_lex"], r["relative_ppl"]) for r in reports.anchored(systems, "system", "h", ["lex"], ["ppl"]).collect()}
    assert table == {"h": (1.0, 1.0), "m": (0.5, 0.5), "z": (None, None)}
    assert {r["relative_lex"] for r in reports.anchored(systems, "system", "none", ["lex"]).collect()} == {None}
    words = spark.createDataFrame([("abc", "xaxb"), ("ac", "xb"), (None, "a"), ("a", "c"), ("a", None)], "p string, r string").select(reports.suffix_kept("p", "r", "ab").alias("x"))
    assert [r["x"] for r in words.collect()] == [True, False, False, None, None]


def test_gloss_lines(spark):
    rows = [("k", True, "c", "e", "g"), ("k", True, "", None, ""), ("k", False, None, None, None)]
    df = spark.createDataFrame(rows, "k string, known boolean, cn string, en string, gx string").select(text.gloss_line("k", F.col("known"), "cn", "en", "gx").alias("x"))
    assert [r["x"] for r in df.collect()] == ["  k = c (e) [拟音: g]", "  k = [未知]", "  k = [未收录]"]


def test_numbers_of_rows(spark):
    rnd = random.Random(2)
    values = [rnd.choice([None, *range(200)]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, x int").repartition(5)
    got = sorted(((r["row_idx"], r["x"], r["id"]) for r in io.numbered(df, ["x", "id"]).collect()), key=lambda r: r[0])
    assert [(x, i) for _, x, i in sorted(got, key=lambda r: r[0])] == sorted(((x, i) for i, x in enumerate(values)), key=lambda p: (p[0] is not None, p[0] or 0, p[1])) and [r[0] for r in got] == list(range(500))
    assert io.numbered(df.limit(0), ["x"]).count() == 0
