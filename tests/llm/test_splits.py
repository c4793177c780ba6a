"""Problem 4."""

from __future__ import annotations

from lexspan.llm.splits import EMPTY, QUARANTINE, extend_components, span_documents, torn_groups
from tests.conftest import rows

EDGE, WEIGHT = "a string, b string", "node string, weight long"


def step(spark, edges, weights, prior, targets=(("train", 800), ("validation", 100), ("test", 100))):
    return extend_components(spark.createDataFrame(edges, EDGE), spark.createDataFrame(weights, WEIGHT), prior, spark.createDataFrame(list(targets), "split string, share_permille int"))


def test_components_keep_their_split_and_conflicts_are_quarantined(spark):
    n = 200
    edges = [(f"s{i}", f"d{i}") for i in range(n)] + [("s0", "d0"), (None, "lone"), (None, None)]
    weights = [(f"d{i}", 1 + i % 3) for i in range(n)] + [("lone", 1)]
    one = step(spark, edges, weights, spark.createDataFrame([], EMPTY)).persist()
    first = {r["node"]: (r["component"], r["split"]) for r in one.collect()}
    assert len(first) == 2 * n + 1
    assert all(first[f"s{i}"] == first[f"d{i}"] for i in range(n))
    by = {}
    for node, w in weights:
        by[first[node][1]] = by.get(first[node][1], 0) + w
    total = sum(by.values())
    assert abs(by["train"] / total - 0.8) < 0.03 and abs(by["test"] / total - 0.1) < 0.03
    same = [i for i in range(n) if first[f"s{i}"][1] == "train"]
    other = next(i for i in range(n) if first[f"s{i}"][1] == "test")
    again = [(f"s{same[0]}", f"s{same[1]}"), (f"s{same[2]}", f"s{other}"), ("s900", f"d{same[3]}"), ("s901", "d901"), ("s902", "s901")]
    two = {r["node"]: (r["component"], r["split"]) for r in step(spark, again, [*weights, ("d901", 2)], one).collect()}
    assert two[f"d{same[0]}"] == two[f"d{same[1]}"] and two[f"d{same[0]}"][1] == "train"
    assert {two[x][1] for x in (f"s{same[2]}", f"d{same[2]}", f"s{other}", f"d{other}")} == {QUARANTINE}
    assert two["s900"] == two[f"d{same[3]}"]
    assert two["s901"] == two["s902"] == two["d901"]
    untouched = [f"d{i}" for i in range(n) if i not in (same[0], same[1], same[2], other)]
    assert all(two[x][1] == first[x][1] for x in untouched)
    one.unpersist()


def test_quarantine_stays_and_empty_inputs(spark):
    prior = spark.createDataFrame([("a", "a", QUARANTINE), ("b", "b", "train")], EMPTY)
    got = {r["node"]: r["split"] for r in step(spark, [("a", "c")], [], prior).collect()}
    assert got == {"a": QUARANTINE, "b": "train", "c": QUARANTINE}
    assert rows(step(spark, [], [], spark.createDataFrame([], EMPTY))) == []
    assert [r[2] for r in rows(step(spark, [("x", "y")], [("x", 1)], spark.createDataFrame([], EMPTY), targets=[("train", 0), (None, 5)]))] == [QUARANTINE] * 2


def test_one_component_with_most_rows(spark):
    edges = [("hub", f"d{i}") for i in range(300)] + [(f"s{i}", f"e{i}") for i in range(100)]
    weights = [(b, 1) for _, b in edges]
    got = step(spark, edges, weights, spark.createDataFrame([], EMPTY)).collect()
    assert {r["split"] for r in got if r["component"] == next(x["component"] for x in got if x["node"] == "hub")} == {"train"}


def test_torn_groups(spark):
    spans = spark.createDataFrame([(1, 5, 100, 0), (1, 5, 101, 1), (1, 6, 102, 0), (1, 6, 102, None), (2, 5, 100, 0), (2, 5, 100, 0), (None, 5, 100, 0), (None, 5, 100, 3), (1, None, None, 4)], "case_id long, point_id long, document_id long, fold int")
    points = spark.createDataFrame([(7, 1, 1, 100)], "id long, updated_at int, ingested_at int, document_id long")
    of = spark.createDataFrame([(100, 9), (101, 9), (102, 8)], "_doc long, component long")
    assert rows(torn_groups(span_documents(spans, points), of)) == [(1, 9), (None, 9)]
    lent = spark.createDataFrame([(3, 7, None, 0), (3, 8, None, 1), (3, 7, 102, 2)], spans.schema)
    assert [r["_doc"] for r in span_documents(lent, points).orderBy("fold").collect()] == [100, None, 102]
    assert torn_groups(span_documents(spans.where("false"), points), of).count() == 0
