"""Queries whose cost once grew faster than their input, and rows that differed from their SQL only on larger tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomspark.operators import dictionary as D
from loomspark.operators import selectors as S
from loomspark.operators import setjoin
from loomspark.plans import catalog, common

from . import oracle
from .conftest import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rewritten_is_null_beyond_the_private_range(spark):
    table = D.surrogates(spark.createDataFrame([(f"{k:05d}",) for k in range(3)], "id string"), start=0xFFFFC)
    records = spark.createDataFrame([(0, "00000,77777"), (1, "00002,77777"), (2, None)], "k int, input string")
    got = {r["k"]: r["input"] for r in D.rewritten(records, "input", table, "k").collect()}
    assert got == {0: chr(0xFFFFC) + "[UNK]", 1: None, 2: ""}


def test_a_customer_of_the_unknown_number_is_rewritten(spark, tmp_path):
    """id_rewrite equals its SQL with more than 99,999 customers, and with orders of customers that the table lacks or of none."""
    spark.createDataFrame([(3,), (99999,), (100000,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(0, 3, "low"), (1, 99999, "high"), (2, 100000, None), (3, 7, "low"), (4, None, "low")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = oracle.of_spark(catalog.QUERIES["id_rewrite"](spark, str(tmp_path)))
    assert got == oracle.of_sql(catalog.ORACLES["id_rewrite"], str(tmp_path)) and len(got[1]) == 3


def test_lookups_never_broadcast_the_rows_that_look_up(spark, monkeypatch):
    texts = spark.range(5).select("id", F.lit("green blue").alias("text"))
    keys = spark.createDataFrame([("gre",), ("blue",)], "key string")
    assert "rightHint=(strategy=broadcast)" in _plan(D.contained(texts, keys))
    monkeypatch.setattr(D, "BROADCAST_KEYS", 1)
    assert "rightHint=(strategy=merge)" in _plan(D.contained(texts, keys))


def test_inscriptions_meet_small_tables_without_a_shuffle(spark):
    assert _plan(catalog.QUERIES["inscription_rows"](spark, str(SF))).count("strategy=broadcast") >= 2


def test_ends_of_pools_equal_brute_force():
    def start(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    draw = random.Random(3)
    for _ in range(2000):
        pool = ["".join(draw.choice("ab") for _ in range(draw.randint(1, 7))) + draw.choice(["", "名é"]) for _ in range(draw.randint(1, 4))]
        want = []
        for a in pool:
            n = [0, 0]
            for b in pool:
                if a != b:
                    p, s = a[: start(a, b)], a[len(a) - start(a[::-1], b[::-1]) :]
                    n[0] += len(p) if len(p) >= 2 else 0
                    n[1] += len(s) if len(s) >= 2 and s != p else 0
            want += n
        assert S.ends_of(pool) == want


def test_pools_are_dealt_to_all_cores_and_scored_once(spark):
    assert common.pools(spark, str(SF)).rdd.getNumPartitions() >= 32
    for name in ("pool_scored", "pool_ablation", "selector_sensitivity"):
        plan = _plan(catalog.QUERIES[name](spark, str(SF)))
        assert plan.count("shared_ends(") == 1 and len(plan) < 50_000, name


def test_copies_of_sets_go_without_a_sort(spark):
    sets = spark.range(20).select("id", F.lit("g").alias("group"), F.array(F.lit("a"), F.lit("b")).alias("grams"))
    pool = setjoin._distinct(sets)[1]
    assert "SortAggregate" not in pool._jdf.queryExecution().executedPlan().toString()
    assert [list(r["grams"]) for r in pool.collect()] == [["g\ta", "g\tb"]]


def test_reward_designs_broadcasts_no_rows_of_its_pairs(spark):
    plan = catalog.QUERIES["reward_designs"](spark, str(SF))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2  # the dictionary's keys and entries, of a few rows
    assert plan.count("SortMergeJoin") >= 6


def test_summary_writes_its_selector_out_once(spark):
    plan = _plan(catalog.QUERIES["selector_summary"](spark, str(SF)))
    assert plan.count("shared_ends(") == 1 and plan.count("array_max(") == 1 and len(plan) < 50_000


def test_consensus_guards_compare_dirty_pools_only_without_a_join(spark):
    for name in ("pool_contamination_guard", "pool_audit_preserving"):
        plan = _plan(catalog.QUERIES[name](spark, str(SF)))
        assert "Join" not in plan and plan.count("pool_means(") == 1, name
    rows = [(0, "ab", "abc", "<x>"), (1, "<x>", "abc", "abd"), (2, "<x>", "<y>", None), (3, None, "abc", "<y>"), (4, "<x>", "zz", None)]
    df = S.pool(spark.createDataFrame(rows, "row_idx int, frontier string, unk string, dpo string"), common.NAMES)
    got = {r["row_idx"]: r["pick"] for r in S.contamination_guard(df).collect()}
    assert got == {0: "ab", 1: "abc", 2: "<x>", 3: "abc", 4: "zz"}


def test_value_ablation_compares_clean_members_of_dirty_pools_only(spark):
    assert _plan(catalog.QUERIES["selector_value_ablation"](spark, str(SF))).count("slice(") == 1
    rows = [(0, "ab", "abc", "<x>"), (1, "<x>", "abc", "<y>"), (2, None, "abc", "<y>")]
    df = S.pool(spark.createDataFrame(rows, "row_idx int, frontier string, unk string, dpo string"), common.NAMES)
    got = df.select("row_idx", F.transform(S._substitutes(S.LATIN), lambda m: m["name"]).alias("names")).collect()
    assert {r["row_idx"]: r["names"] for r in got} == {0: [], 1: ["unk"], 2: ["unk"]}
