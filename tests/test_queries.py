"""Every core query against its SQL over the smallest tables, and the shape of the entry points."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
import verify
from lexspan.plans import search
from lexspan.plans.registry import collect
from tests.conftest import SMALL

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
QUERIES, SQL = collect("QUERIES"), collect("SQL")


@pytest.fixture(scope="module")
def duck():
    return verify.duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = verify.canonical(QUERIES[name](spark, SMALL).toArrow().to_pydict())
    out = duck.execute(SQL[name])
    data = out.fetchall()
    want = verify.canonical({d[0]: [r[i] for r in data] for i, d in enumerate(duck.description)})
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_every_case_has_its_training_rows(spark, duck):
    got = {(r[0], r[1]) for r in QUERIES["OP12_all_case_rows"](spark, SMALL).select("case_id", "label").distinct().collect()}
    cases = {r[0] for r in duck.execute("SELECT DISTINCT case_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST) rn FROM points) WHERE rn = 1 AND status = 'approved' AND case_id IS NOT NULL AND quote_text <> ''").fetchall()}
    assert len(cases) > 1 and got == {(c, label) for c in cases for label in (0, 1)}


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark, duck):
    assert entry.entry(spark).count() == duck.execute(f"SELECT count(*) FROM ({SQL['p3_found']})").fetchone()[0] > 0


def test_only_documents_to_run_on_are_searched(spark, monkeypatch):
    searched = []

    def found(t, docs=None):
        searched.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        return search_found(t, docs)

    search_found = search.found
    monkeypatch.setattr(search, "found", found)
    run = QUERIES["OP26_run_status"](spark, SMALL).collect()
    assert searched == [{r["document_id"] for r in run if r["status"].startswith("ran")}]
    assert {r["document_id"] for r in run} - searched[0]


def test_the_rest_works_without_the_subpackage(monkeypatch):
    """A module of the subpackage that cannot be imported takes nothing else away."""
    monkeypatch.setitem(sys.modules, "lexspan.llm.sentences", None)
    assert set(entry.queries()) == set(QUERIES)


def test_core_does_not_import_the_subpackage():
    for p in (Path(entry.__file__).parent / "lexspan").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lexspan.llm" not in p.read_text()
