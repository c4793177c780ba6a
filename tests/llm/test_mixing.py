"""Problem 9."""

from __future__ import annotations

import math

from lexspan.llm.mixing import bisect_exponent, budgets, entropy, mixture, source_totals, tempered, tempered_budgets, unreachable

TARGET = "source string, weight_permille int, max_repeats int"


def test_temperature():
    shares = {"a": 0.9, "b": 0.09, "c": 0.01}
    e = bisect_exponent(shares, target_entropy=0.8)
    assert math.isclose(entropy(tempered(shares, e)), 0.8, abs_tol=1e-6)
    assert bisect_exponent(shares, target_entropy=0.0) == 1.0 and bisect_exponent(shares, target_entropy=9.0) == 0.0
    e = bisect_exponent(shares, limits={"a": 1, "b": 0.3, "c": 0.1})
    w = tempered(shares, e)
    assert w["c"] <= 0.1 + 1e-6 and w["b"] <= 0.3 + 1e-6 and (math.isclose(w["c"], 0.1, abs_tol=1e-4) or math.isclose(w["b"], 0.3, abs_tol=1e-4))
    assert tempered({"a": 0.0}, 0.5) == {"a": 0.0}


def test_budgets_fill_the_whole_within_the_limits():
    tokens, weights, repeats = {"big": 900, "small": 80, "tiny": 20}, {"big": 300, "small": 500, "tiny": 200}, {"big": 1, "small": 3, "tiny": 2}
    out = budgets(tokens, 1000, weights, repeats)
    assert out["tiny"] == 40 and out["small"] == 240 and out["big"] == 720
    assert sum(budgets({"a": 10}, 1000, {"a": 1000}, {"a": 3}).values()) == 30
    assert budgets({"a": 0}, 0, {"a": 1000}, {"a": 3}) == {"a": 0}


def counted(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long").selectExpr("*", "1 AS repeats", "2 AS _blocks")


def test_mixture_reaches_the_shares(spark):
    rows = [(i, "a", 10 + i % 7) for i in range(2000)] + [(5000 + i, "b", 20) for i in range(300)] + [(9000, None, 500), (9001, "other", 500), (9002, "b", 0)]
    targets = spark.createDataFrame([("a", 600, 1), ("b", 400, 4), (None, 5, 5), ("b", 300, 2), ("gone", 0, 3)], TARGET)
    df = counted(spark, rows)
    sums, total = source_totals(df, targets)
    assert total == sum(r[2] for r in rows) and unreachable(sums, total) == []
    drawn = mixture(df, targets).collect()
    size = {s: sum(r["tokens"] * r["repeats"] for r in drawn if r["source"] == s) for s in ("a", "b")}
    assert abs(size["a"] / total - 0.6) < 0.005 and abs(size["b"] / total - 0.4) < 0.005
    assert max(r["repeats"] for r in drawn if r["source"] == "a") == 1 and max(r["repeats"] for r in drawn) <= 4
    assert len({r["doc_id"] for r in drawn}) == len(drawn)
    assert {r["repeats"] for r in drawn if r["source"] == "b"} <= {1, 2, 3}


def test_unreachable_and_empty(spark):
    df = counted(spark, [(1, "a", 100), (2, "b", 1)])
    targets = spark.createDataFrame([("a", 500, 1), ("b", 500, 2)], TARGET)
    assert unreachable(*source_totals(df, targets)) == ["b"]
    assert mixture(df.where("false"), targets).count() == 0
    assert {r["doc_id"]: r["repeats"] for r in mixture(df, targets).collect()}[2] == 2


def test_tempered_budgets_meet_the_entropy(spark):
    rows = [{"source": "a", "tokens": 90_000, "weight_permille": 0, "max_repeats": 1}, {"source": "b", "tokens": 9_000, "weight_permille": 0, "max_repeats": 9}, {"source": "c", "tokens": 1_000, "weight_permille": 0, "max_repeats": 90}, {"source": "d", "tokens": 0, "weight_permille": 5, "max_repeats": 9}]
    exponent, drawn = tempered_budgets(rows, 100_000, 0.7)
    assert 0 < exponent < 1 and sum(drawn.values()) <= 100_000
    assert math.isclose(entropy({k: v / sum(drawn.values()) for k, v in drawn.items()}), 0.7 * math.log(3), abs_tol=1e-3)
    assert tempered_budgets([], 0, 0.7) == (1.0, {})
    df = counted(spark, [(i, "ab"[i % 10 == 0], 10) for i in range(1000)])
    targets = spark.createDataFrame([("a", 0, 1), ("b", 0, 3)], TARGET)
    sizes = {r["source"]: r["n"] for r in mixture(df, targets, evenness=0.9).groupBy("source").agg({"tokens": "count"}).withColumnRenamed("count(tokens)", "n").collect()}
    assert sizes["b"] == 100 and sizes["a"] < 900
