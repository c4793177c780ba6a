"""Core operators on small tables: nulls, ties, repeats, empty tables, and brute force."""

from __future__ import annotations

import random
from pathlib import Path
from datetime import datetime, timezone

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspan.functions.text import blank_tags, is_blank, occurrences, part
from lexspan.operators.components import components
from lexspan.operators.metrics import average_precision, best_threshold, frontier, pr_curve, roc_auc
from lexspan.operators.references import current_rows, orphan_report, orphans
from lexspan.operators.running import running_sums
from lexspan.operators.sampling import fold_of, hash_rank
from lexspan.operators.search import prefilter, span_search
from lexspan.operators.spans import boundary_arrays, overlapping, relocate_quotes, sentences, stretch
from lexspan.streaming.incremental import LOG, run_new_versions
from tests.conftest import rows


def day(n: int) -> datetime:
    return datetime(2020, 1 + n // 28, 1 + n % 28, tzinfo=timezone.utc)


RECORD = "id bigint, fk bigint, created_at timestamp, status string"
PARENT = "id bigint, status string, created_at timestamp, fk string"


def found(spark, records, parents, **more):
    options = {"table_name": "r", "field": "fk", "record_id": "id", "created_at": "created_at", "parent_key": "id"} | more
    return orphans(spark.createDataFrame(records, RECORD), spark.createDataFrame(parents, PARENT), **options)


def test_orphans_kinds_nulls_and_repeats(spark):
    gone = F.lower(F.trim(F.col("status"))) == "deleted"
    timed = {"parent_deleted": gone, "parent_created_at": "created_at"}
    parents = [(1, None, day(5), "x"), (2, " Deleted ", day(1), None), (3, "ok", day(9), None), (3, "ok", day(9), None), (None, "ok", day(1), None), (4, None, None, None)]
    records = [(10, 1, day(6), "a"), (11, 2, day(6), "a"), (12, 3, day(6), "a"), (13, 7, day(6), None), (14, None, day(6), "a"), (15, -999, None, "a"), (16, 4, day(6), "a"), (17, 3, None, "a"), (13, 7, day(6), None)]
    got = rows(found(spark, records, parents, **timed).select("record_id", "kind", "period"))
    assert got == [(11, "deleted", "2020-01"), (12, "late", "2020-01"), (13, "missing", "2020-01"), (13, "missing", "2020-01"), (15, "missing", None)]
    assert rows(orphan_report(found(spark, records, parents, **timed)).where("kind = 'missing'").select("period", "orphans")) == [("2020-01", 2), (None, 1)]


def test_periods_are_months_of_utc(spark):
    records = [(1, 9, datetime(2020, 1, 31, 23, 30, tzinfo=timezone.utc)), (2, 9, datetime(2020, 2, 1, 0, 30, tzinfo=timezone.utc)), (3, 9, datetime(1969, 12, 31, 23, 59, tzinfo=timezone.utc))]
    try:
        for zone in ("America/Los_Angeles", "Asia/Tokyo", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.createDataFrame(records, "id long, k long, at timestamp")
            got = orphans(df, df.where("false"), table_name="t", field="k", record_id="id", created_at="at", parent_key="k")
            assert rows(got.select("record_id", "period")) == [(1, "2020-01"), (2, "2020-02"), (3, "1969-12")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_third_of_all_rows_on_one_key(spark, monkeypatch):
    """The same rows whether the suspects are sent out or looked up in parts."""
    records = [(i, 7 if i % 3 == 0 else i, day(i % 300)) for i in range(900)] + [(None, 7, None)]
    parents = [(i, i % 5 == 0, day(100)) for i in range(8, 900)]

    def found_rows():
        df = spark.createDataFrame(records, "id long, k long, at timestamp")
        of = spark.createDataFrame(parents, "k long, gone boolean, born timestamp")
        return rows(orphans(df, of, table_name="t", field="k", record_id="id", created_at="at", parent_key="k", parent_deleted=F.col("gone"), parent_created_at="born").select("record_id", "kind", "period"))

    want = found_rows()
    monkeypatch.setattr("lexspan.operators.joins.SMALL", 0)
    assert found_rows() == want and sum(r[1] == "missing" for r in want) >= 301


def test_orphans_of_empty_tables(spark):
    assert rows(found(spark, [], [(1, None, day(1), None)])) == []
    assert [r[2] for r in rows(found(spark, [(5, 1, day(1), None)], []))] == [5]


def test_current_rows_ties_and_null_versions(spark):
    df = spark.createDataFrame([(1, 1, 5, "a"), (1, 2, 1, "b"), (1, 2, 3, "c"), (2, None, 1, "d"), (None, 1, 1, "e"), (None, 2, 1, "f")], "id int, v int, t int, x string")
    assert rows(current_rows(df, "id", "v", ["id", "x"], tie="t")) == [(1, "c"), (2, "d"), (None, "f")]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_components_equal_union_find(edges):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = rows(components(spark.createDataFrame(edges, "a int, b int")))
    assert got == sorted((x, root(x)) for x in parent)


def test_components_of_a_long_chain_and_nulls(spark):
    edges = [(i, i + 1) for i in range(200)] + [(None, 3), (500, None), (900, 900)]
    got = dict(rows(components(spark.createDataFrame(edges, "a int, b int"))))
    assert got == {i: 0 for i in range(201)} | {900: 900}


def test_hash_rank_is_a_permutation_within_groups(spark):
    df = spark.createDataFrame([(g, i) for g in ("a", "b", None) for i in range(50)], "g string, i int")
    got = hash_rank(df, ["g"], "s", ["i"]).collect()
    for g in ("a", "b", None):
        assert sorted(r["rank0"] for r in got if r["g"] == g) == list(range(50))
        assert {r["group_size"] for r in got} == {50}
    assert hash_rank(df.where("false"), ["g"], "s", ["i"]).count() == 0


def test_folds_of_few_rows(spark):
    df = spark.range(3).select(F.col("id").alias("r"), fold_of(F.col("id"), F.lit(3), 5).alias("f"))
    cuts = [round(i * (3 / 5)) for i in range(6)]
    assert rows(df) == [(r, next(i for i in range(5) if cuts[i] <= r < cuts[i + 1])) for r in range(3)]


def test_running_sums_equal_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), round(rng.random() * 3, 3), rng.randint(0, 5)) for _ in range(120)]
    data = list({(g, x): (g, x, n) for g, x, n in data}.values())
    df = spark.createDataFrame(data, "g string, x double, n long")
    got = {(r["g"], r["x"]): (r["upto"], r["all"]) for r in running_sums(df, ["g"], [F.desc("x")], F.floor(F.col("x") * 4), True, {"n": "upto"}, {"n": "all"}).collect()}
    for g, x, _ in data:
        mine = [(y, n) for h, y, n in data if h == g]
        assert got[g, x] == (sum(n for y, n in mine if y >= x), sum(n for _, n in mine))


def test_curves_by_hand(spark):
    df = spark.createDataFrame([("c", 0.9, 1), ("c", 0.8, 0), ("c", 0.8, 1), ("c", 0.1, 0), ("one", 0.5, 1), ("none", 0.5, 0), ("c", None, 1), ("c", 0.3, None)], "g string, score double, label int")
    curve = pr_curve(df, ["g"])
    assert rows(curve.where("g = 'c'").select("threshold", "tp", "fp", "recall")) == [(0.1, 2, 2, 1.0), (0.8, 2, 1, 1.0), (0.9, 1, 0, 0.5)]
    assert dict(rows(roc_auc(df, ["g"]))) == {"c": 0.875, "one": None, "none": None}
    assert dict(rows(average_precision(curve, ["g"])))["none"] == 0.0
    best = {r["g"]: r for r in best_threshold(curve, ["g"]).collect()}
    assert best["c"]["threshold"] == 0.8 and best["none"]["f"] == 0.0
    assert rows(frontier(curve.where("g = 'c'"), ["g"], [1.0]).select("threshold")) == [(0.8,)]
    assert frontier(curve.where("false"), ["g"], [1.0]).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("<p>Hi</p><li>x</li>", "x"), ("", "x"), (None, None), ("😀aa", "a"), (" \n", "")], "t string, q string")
    got = df.select(blank_tags("t"), F.length(blank_tags("t")) == F.length("t"), is_blank("t"), occurrences("t", "q"), part("t", F.lit(1), F.lit(None).cast("int"))).collect()
    assert tuple(got[0]) == ("   Hi.       x.    ", True, False, 1, "p>Hi</p><li>x</li>")
    assert [r[2] for r in got] == [False, True, True, False, True]
    assert got[3][3] == 2 and got[3][4] == "aa" and got[4][3] == 0


def test_sentences_cover_the_text(spark):
    docs = spark.createDataFrame([(1, "One. Two!  Three"), (2, ""), (3, None), (None, "x."), (4, " \n "), (5, "..."), (6, "a" * 5000 + ". b")], "doc_id long, text string")
    got = rows(sentences(docs))
    assert [r[1:] for r in got if r[0] == 1] == [(0, 0, 5), (1, 5, 11), (2, 11, 16)]
    assert {r[0] for r in got} == {1, 5, 6}


def test_stretch_edges(spark):
    docs = spark.createDataFrame([(1, "  One. Two. Three.")], "doc_id long, text string")
    points = spark.createDataFrame([(1, 1, 0, 1), (2, 1, 2, 7), (3, 1, 8, 18), (4, 9, 0, 3), (5, 1, None, None)], "id int, document_id long, quote_start int, quote_end int")
    got = {r["id"]: (r["idx_start"], r["idx_end"], r["num_sents"]) for r in stretch(points, boundary_arrays(sentences(docs))).collect()}
    assert got == {1: (0, 1, 1), 2: (0, 1, 1), 3: (1, 3, 2), 4: (None, None, None), 5: (None, None, None)}


def test_relocation_of_quotes(spark):
    docs = spark.createDataFrame([(1, "abc def abc xyz", "z"), (2, None, "z")], "doc_id long, text string, extra string")
    points = spark.createDataFrame([(1, 1, "xyz", 0, 3), (2, 1, "abc", 1, 4), (3, 1, "abc", 8, 11), (4, 2, "q", 0, 1), (5, 1, "", 0, 1), (6, None, "abc", 0, 3)], "id int, document_id long, quote_text string, quote_start int, quote_end int")
    got = {r["id"]: (r["matches_before"], r["n_matches"], r["new_start"], r["matches_after"]) for r in relocate_quotes(points, docs).collect()}
    assert got == {1: (False, 1, 12, True), 2: (False, 2, 1, False), 3: (True, 2, 8, True), 4: (False, 0, 0, False), 5: (False, 0, 0, False), 6: (False, 0, 0, False)}


def test_overlaps_are_half_open(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 9, None), (2, 0, 5)], "d int, lo int, hi int")
    b = spark.createDataFrame([(1, 5, 6), (1, 20, None)], "d int, lo2 int, hi2 int")
    assert rows(overlapping(a, b, ["d"]).select("lo", "lo2")) == [(5, 5), (9, 20)]
    assert rows(overlapping(a, b, ["d"], "left_anti").select("d", "lo")) == [(1, 0), (2, 0)]


def _search(sents, score, reach=5):
    """The same by a loop over one document's sentences."""
    free = [i for i, s in enumerate(sents) if not s[2]]
    if not free:
        return None
    best = max(free, key=lambda i: (score(sents[i][0], sents[i][1]), -i))
    lo, hi, top, left, right = sents[best][0], sents[best][1], score(*sents[best][:2]), 0, 0
    options = []
    for k in range(1, reach + 1):
        if best - k < 0 or sents[best - k][2]:
            break
        options.append((score(sents[best - k][0], hi), -k))
    if options and max(options)[0] > top:
        top, left = max(options)[0], -max(options)[1]
        lo = sents[best - left][0]
    options = []
    for k in range(1, reach + 1):
        if best + k >= len(sents) or sents[best + k][2]:
            break
        options.append((score(lo, sents[best + k][1]), -k))
    if options and max(options)[0] > top:
        top, right = max(options)[0], -max(options)[1]
        hi = sents[best + right][1]
    return (top, lo, hi, 1 + left + right)


def test_span_search_equals_a_loop(spark):
    rng, data, want = random.Random(7), [], {}
    score = lambda lo, hi: (lo * 7 + hi * 13) % 5 / 4
    for d in range(60):
        n = rng.randint(1, 12)
        cuts = sorted(rng.sample(range(200), n + 1))
        sents = [(a, b, rng.random() < 0.3) for a, b in zip(cuts, cuts[1:])]
        data += [(d, i, a, b, m) for i, (a, b, m) in enumerate(sents)]
        if (r := _search(sents, score)) is not None:
            want[d] = r
    df = spark.createDataFrame(data, "doc_id long, sent_idx int, sent_start int, sent_end int, masked boolean")
    got = {r["doc_id"]: (r["score"], r["char_start"], r["char_end"], r["num_sents"]) for r in span_search(df, ["doc_id"], lambda lo, hi: F.pmod(lo * 7 + hi * 13, F.lit(5)) / 4.0).collect()}
    assert got == want


def test_prefilter_keeps_the_best(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.1), (2, 0, 0.9), (2, 1, 0.2)], "doc_id long, sent_idx int, p double")
    got = rows(prefilter(df, ["doc_id"], F.col("p"), 0.5).select("doc_id", "sent_idx", "masked", "filter_rate"))
    assert got == [(1, 0, False, 0.5), (1, 1, True, 0.5), (2, 0, False, 0.5), (2, 1, True, 0.5)]


def test_stream_takes_every_version_once(spark, tmp_path):
    schema = "doc_id bigint, text_version string, text string"
    put = lambda data: spark.createDataFrame(data, schema).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([], LOG).write.parquet(f"{tmp_path}/log")
    run = lambda: run_new_versions(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, f"{tmp_path}/log", f"{tmp_path}/cp", lambda d: d, f"{tmp_path}/out")
    put([(1, "1", "a"), (1, "1", "a"), (2, "1", None)])
    run()
    put([(1, "1", "a"), (1, "2", "b")])
    run()
    run()
    out = lambda: rows(spark.read.parquet(f"{tmp_path}/out").select("doc_id", "text_version"))
    assert out() == [(1, "1"), (1, "2"), (2, "1")]
    # A stop after the log was written, or before, but without the batch's commit: the batch comes again and leaves the same output.
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    for p in (tmp_path / "cp" / "commits").glob(f".{commits[-1].name}.*"):
        p.unlink()
    run()
    assert out() == [(1, "1"), (1, "2"), (2, "1")]
    put([(3, "1", "c")])
    run_new_versions(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, f"{tmp_path}/log", f"{tmp_path}/other", lambda d: d, f"{tmp_path}/out")
    assert out() == [(1, "1"), (1, "2"), (2, "1"), (3, "1")]


def test_archive_holds_the_package(tmp_path):
    import zipfile
    from pathlib import Path

    import lexspan
    from lexspan.sources.package import archive

    names = zipfile.ZipFile(archive(Path(lexspan.__file__).parents[1], tmp_path / "x.zip")).namelist()
    assert "lexspan/operators/references.py" in names and all(n.endswith(".py") for n in names)


def test_scratch_tables_are_cleared(spark):
    from lexspan.sources.tables import clear_scratch, stored

    df = stored(spark.range(3).toDF("x"), "some")
    path = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert df.count() == 3 and path.exists() and clear_scratch(spark) >= 1 and not path.exists() and clear_scratch(spark) == 0
