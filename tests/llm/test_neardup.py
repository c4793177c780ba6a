"""Problem 6: against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np

from lexspan.llm import neardup
from lexspan.llm.neardup import BANDS, LEAST, ROWS, SKETCH_WORDS, bands_and_sketch, expand_pairs, plain, run_hashes, signature, similar_texts
from tests.conftest import rows

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "zu", "te") for b in ("ra", "ni", "so", "pe") for c in ("", "x", "den", "mor")]


def likeness(a: str, b: str) -> float:
    x, y = plain(a), plain(b)
    s, t = {x[i : i + 8] for i in range(len(x) - 7)}, {y[i : i + 8] for i in range(len(y) - 7)}
    return len(s & t) / len(s | t)


def corpus(seed: int) -> list[tuple[int, str]]:
    rng, out = random.Random(seed), []
    for base in range(30):
        words = [rng.choice(WORDS) for _ in range(rng.choice([60, 120, 300]))]
        for copy in range(rng.randint(1, 4)):
            mine = list(words)
            for _ in range(int(len(mine) * rng.choice([0, 0, 0.01, 0.02, 0.03, 0.05]))):
                mine[rng.randrange(len(mine))] = rng.choice(WORDS)
            if rng.random() < 0.2:
                mine = mine[len(mine) // 2 :] + mine[: len(mine) // 2]
            out.append((100 * base + copy, " ".join(mine).upper() if copy == 2 else ", ".join(mine) + "."))
    return out


def test_equals_brute_force(spark):
    docs = corpus(5)
    want = sorted((a, b) for a, x in docs for b, y in docs if a < b and len(plain(x)) >= LEAST and len(plain(y)) >= LEAST and likeness(x, y) >= 0.7)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS rep", "'q' AS keys")
    assert rows(expand_pairs(*similar_texts(df))) == want
    assert len(want) > 20


def test_copies_short_texts_and_nulls(spark):
    long = "The quick brown fox jumps over the lazy dog. " * 8
    docs = [(1, long), (2, long.upper()), (3, "  " + long), (4, None), (5, ""), (6, "short"), (None, long), (7, "अआ" * 300), (8, "१२" * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    members, pairs = similar_texts(df)
    assert rows(members) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (7, 7, 1), (8, 8, 1)]
    assert rows(pairs) == [] and rows(expand_pairs(members, pairs)) == [(1, 2), (1, 3), (2, 3)]
    empty = similar_texts(df.where("false"))
    assert rows(empty[0]) == rows(empty[1]) == []


def test_signature_estimates_likeness():
    rng, errors = random.Random(9), []
    for _ in range(20):
        words = [rng.choice(WORDS) for _ in range(200)]
        other = [w if rng.random() > 0.03 else rng.choice(WORDS) for w in words]
        a, b = " ".join(words), " ".join(other)
        x, y = signature(run_hashes(plain(a))), signature(run_hashes(plain(b)))
        errors.append(float(np.mean(x == y)) - likeness(a, b))
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.12
    keys, sketch = bands_and_sketch(x)
    assert len(set(keys.tolist())) == BANDS and len(sketch) == SKETCH_WORDS


def test_very_long_text():
    text = plain("".join(chr(97 + i * i % 26) for i in range(2_000_000)))
    assert signature(run_hashes(text)).shape[0] == BANDS * ROWS


def test_buckets_in_blocks(spark, monkeypatch):
    """Buckets, groups and copies larger than a block give the same pairs as brute force."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(150)]
    docs = [(i, " ".join(base[:i] + ["other"] + base[i + 1 :])) for i in range(14)] + [(100 + i, " ".join(base)) for i in range(8)]
    docs += [(200, " ".join(rng.choice(WORDS) for _ in range(150))), (5, docs[5][1])]
    want = sorted({(a, b) for a, x in docs for b, y in docs if a < b and likeness(x, y) >= 0.7})
    assert rows(expand_pairs(*similar_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))) == want
    assert len(want) == 22 * 21 / 2


def test_plan_broadcasts_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = expand_pairs(*similar_texts(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_recall_against_all_pairs(spark, small):
    """Every pair of the smallest test tables that is alike enough, found by an inverted index of all runs."""
    docs = [(r["doc_id"], plain(r["text"])) for r in spark.read.parquet(f"{small}/documents.parquet").where("text IS NOT NULL").collect()]
    sets = {i: {t[k : k + 8] for k in range(len(t) - 7)} for i, t in docs if len(t) >= LEAST}
    where: dict[str, list[int]] = {}
    for i, s in sets.items():
        for run in s:
            where.setdefault(run, []).append(i)
    shared: dict[tuple[int, int], int] = {}
    for ids in where.values():
        for x in ids:
            for y in ids:
                if x < y:
                    shared[x, y] = shared.get((x, y), 0) + 1
    want = {p for p, n in shared.items() if n >= 0.7 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    got = set(rows(neardup.p6_found(spark, small)))
    assert got <= want and len(got) >= 0.99 * len(want)
