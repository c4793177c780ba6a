"""Problem 2: score cutoffs that keep a wanted share of each group, by iterative histogram refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.operators.references import current_rows
from lexspan.sources.tables import materialise, table

#: Bins per group and pass.
BINS = 1024
STATE = "_g {key}, _lo double, _hi double, _above bigint, _rank bigint, counted bigint"


def refine_cutoffs(scores: DataFrame, targets: DataFrame, group: str, score: str, permille: str, bins: int = BINS) -> DataFrame:
    """(group, cutoff, counted, kept): per group of `targets` the highest score for which kept * 1000 >= permille * counted.

    `scores` has one row per record; null, NaN and scores outside 0..1 do not count. kept is the number of counted scores
    at or above the cutoff; equal scores stay together. Groups without counted scores, and null groups or shares, give no row;
    of several targets of a group the largest share holds; a share of 0 or less gives the group's highest score, one over
    1000 the lowest.

    Each pass counts the scores between a group's bounds into `bins` bins of equal width (partial counts before the shuffle,
    so a group with a third of all rows costs `bins` rows per task), finds the bin that holds the wanted rank and takes that
    bin's least and greatest score as the next bounds, until they are equal. The state, one row per target group, is the
    only thing held by the driver or broadcast: targets are a parameter table, not data.
    """
    spark = scores.sparkSession
    goals = targets.where(F.col(group).isNotNull() & F.col(permille).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.max(permille).alias("_p"))
    rows = scores.select(F.col(group).alias("_g"), F.col(score).alias("_s")).where("_s >= 0 AND _s <= 1 AND NOT isnan(_s)")
    rows = materialise(rows.join(F.broadcast(goals.select("_g")), "_g", "left_semi"))
    key = goals.schema["_g"].dataType.simpleString()
    first = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("counted"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi")).join(F.broadcast(goals), "_g")
    rank = F.least(F.col("counted"), F.greatest(F.lit(1), F.ceil(F.col("_p").cast("decimal(20,0)") * F.col("counted").cast("decimal(20,0)") / 1000).cast("long")))
    schema = STATE.format(key=key)
    state = first.select("_g", "_lo", "_hi", F.lit(0).cast("long").alias("_above"), rank.alias("_rank"), "counted").collect()
    exact, state = [], [tuple(r) for r in state]
    while state:
        at = F.broadcast(spark.createDataFrame(state, schema))
        width = F.col("_hi") - F.col("_lo")
        share = F.when(width > 0, (F.col("_s") - F.col("_lo")) / width).otherwise(F.lit(0.0))
        place = F.least(F.lit(bins - 1), F.floor(share * bins).cast("int"))
        counts = (
            rows.join(at, "_g")
            .where("_s >= _lo AND _s <= _hi")
            .groupBy("_g", "_above", "_rank", "counted", place.alias("_bin"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
            .withColumn("_upto", F.col("_above") + F.sum("_n").over(W.partitionBy("_g").orderBy(F.desc("_bin"))))
            .where("_upto >= _rank AND _upto - _n < _rank")
            .select("_g", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_above"), "_rank", "counted", "_upto")
            .collect()
        )
        exact += [(r._g, r._lo, r.counted, r._upto) for r in counts if r._lo == r._hi]
        state = [tuple(r)[:6] for r in counts if r._lo != r._hi]
    return spark.createDataFrame(exact, f"`{group}` {key}, cutoff double, counted bigint, kept bigint")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(table(spark, sf_dir, "points"), "id", "updated_at", ["id", "case_id", "ml_score"], tie="ingested_at")


def p2_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutoff, counted and kept points of each case with a target."""
    return refine_cutoffs(_points(spark, sf_dir), table(spark, sf_dir, "keep_targets"), "case_id", "ml_score", "keep_permille")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current points at or above their case's cutoff."""
    points = materialise(_points(spark, sf_dir).where("ml_score >= 0 AND ml_score <= 1 AND NOT isnan(ml_score)"))
    cutoffs = refine_cutoffs(points, table(spark, sf_dir, "keep_targets"), "case_id", "ml_score", "keep_permille")
    return points.join(F.broadcast(cutoffs), "case_id").where("ml_score >= cutoff").select("case_id", F.col("id").alias("point_id"))


CUTOFF_SQL = """
WITH cur AS (SELECT id, case_id, ml_score s FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST) rn FROM points)
  WHERE rn = 1 AND ml_score BETWEEN 0 AND 1),
goal AS (SELECT case_id, max(keep_permille) p FROM keep_targets WHERE case_id IS NOT NULL AND keep_permille IS NOT NULL GROUP BY case_id),
c AS (SELECT case_id, id, s, p, count(*) OVER (PARTITION BY case_id) counted,
  count(*) OVER (PARTITION BY case_id ORDER BY s DESC RANGE UNBOUNDED PRECEDING) kept FROM cur JOIN goal USING (case_id)),
cut AS (SELECT case_id, max(s) cutoff, any_value(counted) counted, min(kept) kept FROM c WHERE kept * 1000 >= p * counted GROUP BY case_id)
"""
QUERIES = {"p2_found": p2_found, "p2_cutoffs": p2_cutoffs}
SQL = {
    "p2_found": CUTOFF_SQL + "SELECT c.case_id, c.id point_id FROM c JOIN cut USING (case_id) WHERE c.s >= cut.cutoff",
    "p2_cutoffs": CUTOFF_SQL + "SELECT case_id, cutoff, counted, kept FROM cut",
}
