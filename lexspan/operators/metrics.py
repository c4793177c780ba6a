"""Curves and thresholds of scored rows, as windows over counts per distinct score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.operators.running import running_sums

#: Slots of a unit of score by which running counts are taken.
SLOTS = 4096


def pr_curve(rows: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(group, threshold, new_tp, new_fp, tp, fp, positives, negatives, precision, recall) at every distinct score.

    A row counts as found if its score is at or above the threshold. Null scores and labels are left out; recall is 0
    without positives. Rows are counted per score before anything is ordered, so ties and hot scores cost one row.
    """
    per = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*group, F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("long")).alias("new_tp"), F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("new_fp", F.col("_n") - F.col("new_tp")).drop("_n")
    slot = F.floor(F.col("threshold") * SLOTS)
    out = running_sums(per, group, [F.desc("threshold")], slot, True, {"new_tp": "tp", "new_fp": "fp"}, {"new_tp": "positives", "new_fp": "negatives"})
    precision = F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 9)
    recall = F.when(F.col("positives") > 0, F.round(F.col("tp") / F.col("positives"), 9)).otherwise(F.lit(0.0))
    return out.withColumn("precision", precision).withColumn("recall", recall)


def f_score(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    """F of precision and recall; 0 where both are 0."""
    b2 = beta * beta
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(F.round((1 + b2) * precision * recall / (b2 * precision + recall), 9))


def best_threshold(curve: DataFrame, group: list[str], beta: float = 1.0) -> DataFrame:
    """The point of greatest F of each group, the lowest threshold among equals."""
    scored = curve.withColumn("f", f_score(F.col("precision"), F.col("recall"), beta))
    best = scored.groupBy(*group).agg(F.max(F.struct("f", (-F.col("threshold")).alias("_t"), "precision", "recall")).alias("_b"))
    return best.select(*group, (-F.col("_b._t")).alias("threshold"), "_b.precision", "_b.recall", "_b.f")


def roc_auc(rows: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(group, auc): the share of pairs of a positive and a negative in the right order, ties by half; null without pairs."""
    # The trapezium between a score and the next higher one.
    area = F.col("new_fp") * (2 * F.col("tp") - F.col("new_tp"))
    summed = pr_curve(rows, group, score, label).withColumn("_a", area).groupBy(*group).agg(F.sum("_a").alias("_a"), F.max("positives").alias("_p"), F.max("negatives").alias("_n"))
    return summed.select(*group, F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.round(F.col("_a") / (2.0 * F.col("_p") * F.col("_n")), 6)).alias("auc"))


def average_precision(curve: DataFrame, group: list[str]) -> DataFrame:
    """(group, ap): the sum of precisions weighted by the gain in recall."""
    per = curve.groupBy(*group).agg(F.sum(F.col("new_tp") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_s"), F.max("positives").alias("_p"))
    return per.select(*group, F.when(F.col("_p") > 0, F.round(F.col("_s") / F.col("_p"), 6)).otherwise(F.lit(0.0)).alias("ap"))


def frontier(curve: DataFrame, group: list[str], targets: list[float], least_recall: float = 0.8, within: float = 0.02) -> DataFrame:
    """Points of recall `least_recall` or more that no point of at most their recall beats in precision, and the points nearest to the recall targets.

    In the order of recall, then falling precision, a point is on the frontier if its precision is above all before it. A
    target takes the nearest point, if one is `within` reach.
    """
    rows = curve.where(F.col("recall") >= least_recall)
    up = W.partitionBy(*group).orderBy("recall", F.desc("precision"), "threshold")
    before = F.max("precision").over(up.rowsBetween(W.unboundedPreceding, -1))
    keep = before.isNull() | (F.col("precision") > before)
    out = rows.withColumn("_f", keep)
    for i, r in enumerate(targets):
        gap = F.round(F.abs(F.col("recall") - F.lit(r)), 9)
        nearest = F.row_number().over(W.partitionBy(*group).orderBy(gap, "recall", F.desc("precision"), "threshold"))
        out = out.withColumn(f"_t{i}", (nearest == 1) & (gap <= within))
    chosen = F.col("_f")
    for i in range(len(targets)):
        chosen = chosen | F.col(f"_t{i}")
    return out.where(chosen).drop("_f", *[f"_t{i}" for i in range(len(targets))])
