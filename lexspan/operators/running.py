"""Running sums over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sums(df: DataFrame, group: list[str], order: list[Column], slot: Column, slot_descending: bool, sums: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """`df` with the running sum of each column of `sums` (column to new name) in `order`, and whole sums of `totals`.

    `slot` is a coarse value that never runs against `order`. Sums per slot are taken before the shuffle and run over
    slots; rows are ordered only within a slot, so a group may hold any share of all rows. Null groups are one group.
    """
    rows = df.withColumn("_slot", slot)
    columns = list(dict.fromkeys([*sums, *(totals or {})]))
    per = rows.groupBy(*group, "_slot").agg(*[F.sum(c).alias(f"_in_{c}") for c in columns])
    whole = W.partitionBy(*group)
    down = whole.orderBy(F.desc_nulls_last("_slot") if slot_descending else F.asc_nulls_first("_slot"))
    for c in columns:
        per = per.withColumn(f"_before_{c}", F.sum(f"_in_{c}").over(down) - F.col(f"_in_{c}")).withColumn(f"_all_{c}", F.sum(f"_in_{c}").over(whole))
    per = per.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slot").alias("_other"), *[f"_before_{c}" for c in columns], *[f"_all_{c}" for c in columns])
    cond = rows["_slot"].eqNullSafe(per["_other"])
    for i, g in enumerate(group):
        cond = cond & rows[g].eqNullSafe(per[f"_g{i}"])
    out = rows.join(per, cond).drop("_other", *[f"_g{i}" for i in range(len(group))])
    within = W.partitionBy(*group, "_slot").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    for c, name in sums.items():
        out = out.withColumn(name, F.col(f"_before_{c}") + F.sum(c).over(within))
    for c, name in (totals or {}).items():
        out = out.withColumn(name, F.col(f"_all_{c}"))
    return out.drop("_slot", *[f"_before_{c}" for c in columns], *[f"_all_{c}" for c in columns])
