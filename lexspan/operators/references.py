"""References between tables: keys that lead to no usable record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.operators.joins import match
from lexspan.sources.tables import stored


def current_rows(df: DataFrame, key: str, version: str, columns: list[str], tie: str | None = None) -> DataFrame:
    """One row per `key`: the one with the greatest `version`.

    Rows equal in `version` are ordered by `tie` (if any) and then by the other columns, so the choice is stable;
    null versions rank lowest, null keys are kept as one key. The maximum is taken before the shuffle, so a key
    with a third of all rows costs one row per task.
    """
    order = [c for c in dict.fromkeys([version, tie, *columns]) if c and c != key]
    best = df.groupBy(key).agg(F.max(F.struct(*order)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in columns if c != key])


def utc_month(at: str) -> Column:
    """The month of a time as YYYY-MM, in UTC whatever the session's zone is."""
    return F.substring(F.date_from_unix_date(F.floor(F.unix_seconds(at) / 86400).cast("int")).cast("string"), 1, 7)


def orphans(
    records: DataFrame,
    parents: DataFrame,
    *,
    table_name: str,
    field: str,
    record_id: str,
    created_at: str,
    parent_key: str,
    parent_deleted: Column | None = None,
    parent_created_at: str | None = None,
) -> DataFrame:
    """Records whose `field` leads to no usable parent.

    Returns (table_name, field, record_id, kind, period). kind is `missing` (no such key), else `deleted`
    (`parent_deleted` holds for a row of that key), else `late` (the parent came after the record). A null key is no
    reference; a null time on either side is never late; its record's period is null. Repeated parent rows count once
    (deleted if any is, created at the earliest). Repeated records give repeated rows.

    The records' keys are reduced to one row per distinct key before any shuffle; a left anti-join finds missing keys, and only
    suspect keys (missing, deleted or younger than some record) are joined back: sent to the records while they are few,
    else with the records of every key spread over several tasks, so a hot key meets in none. Periods are months of UTC in any session zone.
    """
    deleted = F.lit(False) if parent_deleted is None else F.coalesce(parent_deleted, F.lit(False))
    born = F.lit(None).cast("timestamp") if parent_created_at is None else F.col(parent_created_at)
    targets = (
        parents.select(F.col(parent_key).alias("_k"), deleted.alias("_del"), born.alias("_born"))
        .where(F.col("_k").isNotNull())
        .groupBy("_k")
        .agg(F.max("_del").alias("_del"), F.min("_born").alias("_born"))
    )
    rows = records.select(F.col(field).alias("_k"), F.col(record_id).alias("record_id"), F.col(created_at).alias("_at")).where(F.col("_k").isNotNull())
    keys = rows.groupBy("_k").agg(F.min("_at").alias("_first"))
    missing = keys.join(targets, "_k", "left_anti").select("_k", F.lit(True).alias("_missing"), F.lit(False).alias("_del"), F.lit(None).cast("timestamp").alias("_born"))
    suspect = keys
    if parent_deleted is None and parent_created_at is None:
        suspect = missing
    else:
        present = keys.join(targets, "_k").where(F.col("_del") | (F.col("_born") > F.col("_first")))
        suspect = missing.unionByName(present.select("_k", F.lit(False).alias("_missing"), "_del", "_born"))
    kind = F.when(F.col("_missing"), "missing").when(F.col("_del"), "deleted").when(F.col("_born") > F.col("_at"), "late")
    return (
        match(rows, stored(suspect, "suspects"), "_k", "record_id")
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            F.lit(table_name).alias("table_name"),
            F.lit(field).alias("field"),
            "record_id",
            "kind",
            utc_month("_at").alias("period"),
        )
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts of orphans per table, field, kind and period."""
    return found.groupBy("table_name", "field", "kind", "period").agg(F.count(F.lit(1)).alias("orphans"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)
