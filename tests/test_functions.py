"""Text functions, chrF++, selectors and sinks on small cases."""

from __future__ import annotations

import csv
import os
import random
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomspark.functions import chrf, matching, text
from loomspark.functions.charsets import Charset
from loomspark.operators import corpora, dictionary, search, selectors, statistics
from loomspark.sources import io
from loomspark.streaming import resume

#: A CSV of published items with their picks and scores, where one is at hand.
GOLDEN = Path(os.environ.get("GOLDEN_ITEMS", "/nowhere"))


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_code_points_and_blanks(spark):
    assert one(spark, text.strip("a"), a="　 x　") == "x"
    assert one(spark, text.common_prefix("a", "b"), a="\U00017000\U00017001z", b="\U00017000\U00017001y") == "\U00017000\U00017001"
    assert one(spark, text.common_suffix("a", "b"), a="", b="abc") == ""
    assert one(spark, F.size(text.char_ngrams("a", 4)), a="abc") == 0
    assert one(spark, text.first_filled("a", "b"), a="", b="y") == "y"


def test_tags_and_titles(spark):
    assert one(spark, text.strip_tags("a"), a="<literal>a\nb</literal> c") == "<literal>a\nb</literal> c"  # not over lines
    assert one(spark, text.tagged("a"), a="<literal>a\nb</literal> c") == "a\nb"
    assert one(spark, text.short_title("a", ["丁", "乙"]), a="丁甲乙丙") == "丁甲"  # a marker too early is passed over
    assert one(spark, text.field_score("a", "k"), a='{"k": 9}') == 5
    assert one(spark, text.field_score("a", "k"), a="none") == 3
    assert one(spark, text.is_subsequence("a", "b"), a="ac", b="abc") is True
    assert one(spark, text.is_subsequence("a", "b"), a="ca", b="abc") is False


def test_similarity(spark):
    rows = [("abcd", "bcde"), ("", ""), ("x", None), ("ab" * 150, "ba" * 150)]
    got = [r["x"] for r in spark.createDataFrame(rows, "a string, b string").select(matching.similarity("a", "b").alias("x")).collect()]
    assert got == [None if b is None else pytest.approx(SequenceMatcher(None, a, b).ratio()) for a, b in rows]


def test_chrf_of_equal_and_disjoint(spark):
    df = spark.createDataFrame([("abc de.", "abc de."), ("abc", "xyz"), ("", "xyz"), (None, "x")], "h string, r string").withColumn("stats", chrf.stats("h", "r"))
    assert [round(r["s"], 6) for r in df.select(chrf.of_array().alias("s")).collect()] == [100.0, 0.0, 0.0, 0.0]
    assert chrf.words("a, (b) c") == ["a", ",", "(b", ")", "c"]


def test_goldens_of_chrf(spark):
    # Scores by the definition of chrF++.
    goldens = [("abcd", "abcd", 100.0), ("abcd", "abce", 38.3333), ("ab", "abcdef", 20.8333), ("", "abc", 0.0), ("abc", "", 0.0), ("the cat.", "the cat", 91.9915), ("a b", "ab", 66.6667)]
    df = spark.createDataFrame([(h, r, x, [h, r]) for h, r, x in goldens], "h string, r string, x double, pool array<string>")
    for row in df.select("x", chrf.stats("h", "r").alias("stats"), chrf.pool_means("pool").alias("m")).withColumn("s", chrf.of_array()).collect():
        assert round(row["s"], 4) == row["x"] and round(row["m"][0], 4) == row["x"]


def test_choice_letters_and_surrogates(spark):
    valid = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    assert [one(spark, text.choice("a", valid), a=x) for x in ("Answer: C", "the Best B", '{"basis": " b "}', "Basis='x' basis = \"c\"", "Z", "中A文")] == ["C", "B", "B", "C", None, None]
    table = spark.createDataFrame([("00001", 0xF0000), ("00002", 0xF0001), ("00003", None)], "id string, codepoint long")
    rows = spark.createDataFrame([(1, ["00002", "9", "00001"]), (2, []), (3, ["00003"])], "id int, parts array<string>")
    texts = dictionary.encoded(rows, table)
    assert {r["id"]: r["encoded"] for r in texts.collect()} == {1: "\U000f0001[UNK]\U000f0000", 2: "", 3: "[UNK]"}
    assert {r["id"]: r["parts"] for r in dictionary.decoded(texts, table).collect()} == {1: ["00002", "[UNK]", "00001"], 2: [], 3: ["[UNK]"]}
    with pytest.raises(Exception, match="unknown id: 9"):
        dictionary.encoded(rows, table, strict=True).collect()


def test_replacement_keeps_what_is_no_ideograph(spark):
    texts = spark.createDataFrame([(1, ["甲", "乙", "x", "!"]), (2, []), (3, None)], "id int, words array<string>")
    table = spark.createDataFrame([("甲", ["T"])], "word string, candidates array<string>")
    got = {r["id"]: (r["synthetic"], r["n_replaced"]) for r in corpora.replaced(texts, table).collect()}
    assert got == {1: ("T [UNK] x !", 2), 2: ("", 0), 3: ("", 0)}


def test_vector_table_specs_and_fixed_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", [1.0, 0.0]), (1, "a", [3.0, 4.0])], "id long, key string, embedding array<double>")
    io.write_vectors(df, str(tmp_path / "v"))
    assert {(r["id"], r["key"], tuple(r["embedding"])) for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {(1, "a", (3.0, 4.0)), (2, "b", (1.0, 0.0))}
    assert [round(x, 6) for x in df.where("id = 1").select(statistics.unit("embedding").alias("u")).first()["u"]] == [0.6, 0.8]
    for name in ("x", "y"):
        (tmp_path / f"{name}.jsonl").write_text('{"input": "%s", "reference": "r", "prediction": "p"}\n' % name)
    got = io.registered(spark, [f"one={tmp_path}/x.jsonl", f"two={tmp_path}/x.jsonl", f"two={tmp_path}/y.jsonl"], "prediction").collect()
    assert sorted((r["system"], r["input"]) for r in got) == [("one", "x"), ("two", "y")]
    with pytest.raises(ValueError, match="NAME=PATH"):
        io.registered(spark, ["x.jsonl"], "prediction")


def test_order_without_reference_counts_nothing():
    counts = chrf.counts("abcdef", "ab")
    assert counts[6:9] == [0, 0, 0]  # trigrams: the reference has none


@pytest.mark.skipif(not GOLDEN.exists(), reason="published results are not mounted")
def test_published_results(spark):
    """The published 50 items: scores, picks and switches of the guarded three-way selector."""
    items = list(csv.DictReader(GOLDEN.open(encoding="utf-8")))
    rows = [(int(r["id"]), r["source"], r["reference"], r["frontier"], r["unk_sft"], r["dpo_candidate"], r["selector_output"]) for r in items]
    df = spark.createDataFrame(rows, "row_idx long, source string, reference string, frontier string, unk string, dpo string, expected string")
    # Title suffixes of the classical profile.
    titles = Charset(suffixes="經論義記序文法品卷偈頌疏讚", numerals="", contamination=r"[A-Za-z<>]|\[UNK\]")
    for name in ("frontier",):
        s = df.withColumn("stats", chrf.stats(name, "reference")).agg(*chrf.summed()).select(chrf.of_sums().alias("x")).first()["x"]
        assert round(s, 4) == 28.5403
    sums = df.withColumn("stats", chrf.stats("expected", "reference")).agg(*chrf.summed()).select(chrf.of_sums().alias("x")).first()["x"]
    assert round(sums, 4) == 32.6175
    sentence = {r["row_idx"]: r["x"] for r in df.withColumn("stats", chrf.stats("expected", "reference")).select("row_idx", chrf.of_array().alias("x")).collect()}
    assert all(abs(sentence[int(r["id"])] - float(r["chrf"])) < 1e-3 for r in items)
    pool = selectors.pool(df, ["frontier", "unk", "dpo"])
    mbr = selectors.mbr(pool).join(df.select("row_idx", "reference"), "row_idx").select("row_idx", F.col("chosen.pred").alias("pred"), "reference", F.col("chosen.name").alias("name"))
    total = mbr.withColumn("stats", chrf.stats("pred", "reference")).agg(*chrf.summed()).select(chrf.of_sums().alias("x")).first()["x"]
    assert round(total, 4) == 34.7631
    assert mbr.where("pred = reference").count() == 11
    vote = selectors.vote(selectors.scored(pool, titles)).select("row_idx", "reference", F.col("chosen.pred").alias("pred"), F.col("chosen.name").alias("name"))
    assert vote.where("pred = reference").count() == 13 and vote.where("name <> 'frontier'").count() == 2


def test_upper_median(spark):
    assert one(spark, selectors.upper_median(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(10)))) == 3


def test_null_and_empty_pools(spark):
    df = spark.createDataFrame([(1, "s", None, "", None), (2, "s", "abc", "abc", None)], "row_idx int, source string, frontier string, unk string, dpo string")
    out = {r["row_idx"]: r for r in selectors.guarded(selectors.scored(selectors.pool(df, ["frontier", "unk", "dpo"]))).collect()}
    assert out[1]["chosen"] is None and out[2]["chosen"]["pred"] == "abc"


def test_longest_match_is_greedy(spark):
    texts = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, []), (3, None)], "id int, words array<string>")
    keys = spark.createDataFrame([("a b",), ("b c d",), ("c",)], "key string")
    rows = dictionary.forward_matches(texts, keys).collect()
    found = {r["id"]: [(s["segment"], s["known"]) for s in r["segments"]] for r in rows}
    assert found == {1: [("a b", True), ("c", True), ("d", False)], 2: [], 3: []}


def test_canonical_ids_keep_long_ones(spark):
    assert [one(spark, dictionary.canonical("a"), a=x) for x in ("ID 0012", "1234567", "x1")] == ["00012", "1234567", None]


@pytest.mark.parametrize(("vector_block", "query_block", "shares"), [(1 << 16, 1 << 14, 64), (7, 3, 2)])
def test_nearest_equals_brute_force(spark, monkeypatch, vector_block, query_block, shares):
    """With ties, and with more queries and vectors than a block holds."""
    for name, value in (("VECTOR_BLOCK", vector_block), ("QUERY_BLOCK", query_block), ("SHARES", shares)):
        monkeypatch.setattr(search, name, value)
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randint(0, 3)) for _ in range(4)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {(r["query"], r["rank"]): r["id"] for r in search.nearest(v, v.where("id < 7"), 3).collect()}
    for q in range(7):
        order = sorted((sum((a - b) ** 2 for a, b in zip(rows[q][1], x, strict=True)), i) for i, x in rows if i != q)
        assert [got[q, k] for k in (1, 2, 3)] == [i for _, i in order[:3]]
    assert search.nearest(v, v.limit(0)).count() == 0 and search.nearest(v.limit(0), v.limit(2)).count() == 0


def test_sinks_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "input string, reference string")
    assert io.write_csv(df.limit(0), str(tmp_path / "none")) is False and not (tmp_path / "none").exists()
    io.write_jsonl(df, str(tmp_path / "in"))
    assert io.jsonl(spark, str(tmp_path / "in"), "prediction").count() == 2
    assert [r["input"] for r in io.unfinished(df, df.where("input = 'a'")).collect()] == ["b"]
    for _ in range(2):  # the second run finds nothing new
        resume.follow(spark, str(tmp_path / "in"), "prediction", lambda x: x.select("input"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["input"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b"]
    (tmp_path / "blank").write_text('{"input": "a"}\n\n{"input": "b"}\n')
    assert io.jsonl(spark, str(tmp_path / "blank"), "prediction").where("input is not null").count() == 2
    with pytest.raises(Exception, match="blank line"):
        io.jsonl(spark, str(tmp_path / "blank"), "prediction", strict=True).collect()


def test_model_hook_and_paths(spark, tmp_path):
    from loomspark.operators import models

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, text string")
    rows = models.apply_model(df, models.mock_judge(("overall",)), ["text"], "overall int").collect()
    assert len(rows) == 3 and all(1 <= r["overall"] <= 5 for r in rows)
    (tmp_path / "map.json").write_text('{"1": "x",\n "2": "y"}')
    (tmp_path / "list.json").write_text('[{"prompt": "p", "chosen_reward": 1.5}]')
    assert sorted((r["key"], r["value"]) for r in io.json_map(spark, str(tmp_path / "map.json")).collect()) == [("1", "x"), ("2", "y")]
    assert io.json_array(spark, str(tmp_path / "list.json"), "preference").first()["chosen_reward"] == 1.5
    assert io.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "map.json")).endswith("map.json")
    for name in ("e1", "e2"):
        (tmp_path / "r" / name).mkdir(parents=True)
        (tmp_path / "r" / name / "metrics.json").write_text('{"chrf": {"corpus": 1.0}, "num_examples": 2}')
    assert sorted(r["experiment"] for r in io.discovered(spark, str(tmp_path / "r/*/metrics.json")).collect()) == ["e1", "e2"]
