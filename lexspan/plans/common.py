"""What the query modules share: registration, current points, cleaned tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators.references import current_rows
from lexspan.operators.spans import boundary_arrays, sentences
from lexspan.sources.tables import stored, table

POINT_COLUMNS = ["id", "user_id", "service_id", "document_id", "case_id", "title", "status", "quote_text", "quote_start", "quote_end", "ml_score", "created_at", "updated_at"]
CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST) rn FROM points) WHERE rn = 1)"
SVC = "svc AS (SELECT DISTINCT * FROM services)"


class Registry:
    """Queries of a module with the SQL that states their results."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def put(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.queries[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
            if sql:
                self.sql[name] = sql
            return fn

        return put


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)

    def starts(self) -> DataFrame:
        """(doc_id, starts) of every text's sentences, cut once for all uses in a query and written to the shared folder."""
        if "starts" not in self.made:
            self.made["starts"] = stored(boundary_arrays(sentences(self.documents)), "starts")
        return self.made["starts"]

    def current_points(self, columns: list[str] | None = None) -> DataFrame:
        return current_rows(self.points, "id", "updated_at", columns or POINT_COLUMNS, tie="ingested_at")


def deleted(c: str = "status") -> F.Column:
    """Status `deleted` in any case and padding; null is not deleted."""
    return F.coalesce(F.lower(F.trim(F.col(c))) == "deleted", F.lit(False))


DELETED = "coalesce(lower(trim(status)) = 'deleted', false)"
