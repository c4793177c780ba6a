"""Samples and folds that depend on keys alone, ranked without holding a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.functions.draws import key_hash, uniform


def hash_rank(df: DataFrame, group: list[str], seed: str, keys: list[str], rank: str = "rank0", size: str = "group_size") -> DataFrame:
    """`df` with the rank (from 0) of each row within its group in the order of the keys' hash, and the group's size.

    Rows are counted in 4,096 slots of the hash; only a slot is ever sorted, so a group may hold any share of all rows.
    Rows with equal keys follow one another in no set order. Null groups are one group.
    """
    hashed = df.withColumn("_h", key_hash(seed, *keys)).withColumn("_s", F.substring("_h", 1, 3))
    counts = hashed.groupBy(*group, "_s").agg(F.count(F.lit(1)).alias("_n"))
    over = W.partitionBy(*group)
    counts = counts.withColumn("_before", F.sum("_n").over(over.orderBy("_s")) - F.col("_n")).withColumn(size, F.sum("_n").over(over))
    other = counts.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_s").alias("_s2"), "_before", size)
    cond = hashed["_s"] == other["_s2"]
    for c in group:
        cond = cond & hashed[c].eqNullSafe(other[f"_{c}"])
    placed = hashed.join(other, cond).drop("_s2", *[f"_{c}" for c in group])
    within = F.row_number().over(W.partitionBy(*group, "_s").orderBy("_h", *keys))
    return placed.withColumn(rank, (F.col("_before") + within - 1).cast("bigint")).drop("_h", "_s", "_before")


def window_sizes(spans: DataFrame, group: str = "case_id", size: str = "num_sents") -> DataFrame:
    """(group, size, lo, hi): each group's distribution of sizes as slices of 0..1; sizes under 1 are left out."""
    n = spans.where(F.col(size) >= 1).groupBy(group, F.col(size).alias("w")).agg(F.count(F.lit(1)).alias("_n"))
    upto, total = F.sum("_n").over(W.partitionBy(group).orderBy("w")), F.sum("_n").over(W.partitionBy(group))
    return n.select(group, "w", ((upto - F.col("_n")) / total).alias("lo"), (upto / total).alias("hi"))


def draw_sizes(rows: DataFrame, sizes: DataFrame, seed: str, keys: list[str], group: str = "case_id") -> DataFrame:
    """`rows` with a size `w` drawn from their group's distribution; groups without one are left out."""
    drawn = rows.withColumn("_u", uniform(seed, *keys))
    return drawn.join(sizes, group).where("_u >= lo AND _u < hi").drop("_u", "lo", "hi")


def fold_of(rank: F.Column, size: F.Column, folds: int) -> F.Column:
    """The fold of a rank when `size` rows are cut into `folds` nearly equal slices at half-even rounded places."""
    cuts = [F.bround(F.lit(float(i)) * (size / F.lit(float(folds))), 0) for i in range(1, folds)]
    out = F.lit(0)
    for c in cuts:
        out = out + (rank >= c).cast("int")
    return out
