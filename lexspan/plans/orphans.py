"""Problem 3: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators.references import current_rows, orphan_report, orphans, union_all
from lexspan.sources.tables import stored, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references of the current points and of the documents."""
    points = stored(current_rows(table(spark, sf_dir, "points"), "id", "updated_at", ["id", "document_id", "case_id", "created_at"], tie="ingested_at"), "points")
    documents = table(spark, sf_dir, "documents")
    services = table(spark, sf_dir, "services")
    cases = table(spark, sf_dir, "cases")
    gone = F.lower(F.btrim(F.col("status"), F.lit(" \t\n\r"))) == "deleted"
    timed = {"parent_deleted": gone, "parent_created_at": "created_at"}
    own = {"record_id": "id", "created_at": "created_at"}
    return union_all(
        [
            orphans(points, documents, table_name="points", field="document_id", parent_key="doc_id", **own, **timed),
            orphans(points, cases, table_name="points", field="case_id", parent_key="id", **own),
            orphans(documents, services, table_name="documents", field="service_id", record_id="doc_id", created_at="created_at", parent_key="id", **timed),
        ]
    )


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, counted per table, field, kind and month."""
    return orphan_report(p3_found(spark, sf_dir))


FOUND_SQL = """
WITH cur AS (SELECT id, document_id, case_id, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST) rn FROM points) WHERE rn = 1),
svc AS (SELECT id, bool_or(coalesce(lower(trim(status, chr(32) || chr(9) || chr(10) || chr(13))) = 'deleted', false)) del, min(created_at) born FROM services WHERE id IS NOT NULL GROUP BY id),
doc AS (SELECT doc_id id, bool_or(coalesce(lower(trim(status, chr(32) || chr(9) || chr(10) || chr(13))) = 'deleted', false)) del, min(created_at) born FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
refs AS (
  SELECT 'points' table_name, 'document_id' field, p.id record_id, p.created_at seen, d.id target, d.del, d.born
    FROM cur p LEFT JOIN doc d ON p.document_id = d.id WHERE p.document_id IS NOT NULL
  UNION ALL
  SELECT 'points', 'case_id', p.id, p.created_at, c.id, false, NULL
    FROM cur p LEFT JOIN (SELECT DISTINCT id FROM cases) c ON p.case_id = c.id WHERE p.case_id IS NOT NULL
  UNION ALL
  SELECT 'documents', 'service_id', d.doc_id, d.created_at, s.id, s.del, s.born
    FROM documents d LEFT JOIN svc s ON d.service_id = s.id WHERE d.service_id IS NOT NULL),
kinds AS (SELECT table_name, field, record_id,
  CASE WHEN target IS NULL THEN 'missing' WHEN del THEN 'deleted' WHEN born > seen THEN 'late' END kind,
  strftime(seen AT TIME ZONE 'UTC', '%Y-%m') period FROM refs)
"""
QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}
SQL = {
    "p3_found": FOUND_SQL + "SELECT * FROM kinds WHERE kind IS NOT NULL",
    "p3_counts": FOUND_SQL + "SELECT table_name, field, kind, period, count(*) orphans FROM kinds WHERE kind IS NOT NULL GROUP BY ALL",
}
