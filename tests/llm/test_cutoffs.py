"""Problem 2."""

from __future__ import annotations

import random

from lexspan.llm.cutoffs import refine_cutoffs
from tests.conftest import rows


def brute(scores, targets):
    out = []
    for g, p in sorted({g: max(q for h, q in targets if h == g and q is not None) for g, q in targets if g is not None and q is not None}.items()):
        s = sorted((x for h, x in scores if h == g and x is not None and 0 <= x <= 1), reverse=True)
        if s:
            cut = next((c for c in s if sum(x >= c for x in s) * 1000 >= p * len(s)), s[-1])
            out.append((g, cut, len(s), sum(x >= cut for x in s)))
    return out


def test_equals_brute_force_with_ties(spark):
    rng = random.Random(1)
    scores = [(rng.choice([1, 2, 3, None]), rng.choice([rng.random(), round(rng.random(), 1), 0.0, 1.0, None, float("nan"), -1.0, 1.5])) for _ in range(600)]
    targets = [(1, 300), (2, 1), (3, 1000), (1, 250), (9, 500), (None, 100), (2, None)]
    a = spark.createDataFrame(scores, "case_id long, s double").selectExpr("*", "1 AS cutoff", "2 AS _lo")
    b = spark.createDataFrame(targets, "case_id long, p int")
    for bins in (2, 3, 1024):
        assert rows(refine_cutoffs(a, b, "case_id", "s", "p", bins=bins)) == brute(scores, targets)


def test_close_scores_and_extreme_shares(spark):
    tiny = [("a", i * 5e-324) for i in range(20)] + [("a", 1.0)]
    a = spark.createDataFrame(tiny, "g string, s double")
    for p in (-5, 0, 500, 1000, 5000):
        b = spark.createDataFrame([("a", p)], "g string, p int")
        s = sorted((x for _, x in tiny), reverse=True)
        k = min(len(s), max(1, -(-p * len(s) // 1000)))
        assert rows(refine_cutoffs(a, b, "g", "s", "p", bins=4)) == [("a", s[k - 1], len(s), k)]


def test_empty(spark):
    a, b = spark.createDataFrame([], "g string, s double"), spark.createDataFrame([("a", 5)], "g string, p int")
    assert rows(refine_cutoffs(a, b, "g", "s", "p")) == []
    assert rows(refine_cutoffs(a, b.where("false"), "g", "s", "p")) == []
