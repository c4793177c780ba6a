"""The best-scoring run of sentences in each document, and what an incremental run does with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Scorer = Callable[[Column, Column], Column]


def span_search(sents: DataFrame, keys: list[str], scorer: Scorer, reach: int = 5) -> DataFrame:
    """(keys, score, char_start, char_end, num_sents) of the best span of each document; documents with all sentences masked have none.

    `sents` has sent_idx, sent_start, sent_end and masked per `keys`. The best unmasked sentence (the first among equals)
    is scored alone; then it grows to the left, up to `reach` sentences and not past a masked one, to the best longer span
    if that scores strictly more; then in the same way to the right. `scorer` gives the score of a span from its places.
    Each step is one window over the few sentences next to the span, so a long document is one group of its own length.
    """
    by = W.partitionBy(*keys)
    scored = sents.withColumn("_s", scorer(F.col("sent_start"), F.col("sent_end")))
    best = scored.where("NOT masked").groupBy(*keys).agg(F.max(F.struct("_s", (-F.col("sent_idx")).alias("_i"), "sent_start", "sent_end")).alias("_b"))
    best = best.select(*keys, F.col("_b._s").alias("score"), (-F.col("_b._i")).alias("_at"), F.col("_b.sent_start").alias("char_start"), F.col("_b.sent_end").alias("char_end"), F.lit(0).alias("_left"), F.lit(0).alias("_right"))
    for side in ("left", "right"):
        near = sents.join(best, keys)
        off = F.col("_at") - F.col("sent_idx") if side == "left" else F.col("sent_idx") - F.col("_at")
        near = near.withColumn("_k", off).where((F.col("_k") >= 1) & (F.col("_k") <= reach))
        blocked = F.max(F.col("masked").cast("int")).over(by.orderBy("_k").rowsBetween(W.unboundedPreceding, 0))
        near = near.withColumn("_m", blocked).where("_m = 0")
        lo, hi = (F.col("sent_start"), F.col("char_end")) if side == "left" else (F.col("char_start"), F.col("sent_end"))
        grown = near.withColumn("_s", scorer(lo, hi)).where(F.col("_s") > F.col("score"))
        top = grown.groupBy(*keys).agg(F.max(F.struct("_s", (-F.col("_k")).alias("_n"), lo.alias("_lo"), hi.alias("_hi"))).alias("_b"))
        kept = [c for c in best.columns if c not in keys]
        new = {"score": F.coalesce("_b._s", "score"), "char_start": F.coalesce("_b._lo", "char_start"), "char_end": F.coalesce("_b._hi", "char_end"), f"_{side}": F.coalesce(-F.col("_b._n"), F.lit(0))}
        best = best.join(top, keys, "left").select(*keys, *[new.get(c, F.col(c)).alias(c) for c in kept])
    return best.select(*keys, "score", "char_start", "char_end", (1 + F.col("_left") + F.col("_right")).alias("num_sents"))


def prefilter(sents: DataFrame, keys: list[str], score: Column, threshold: float) -> DataFrame:
    """`sents` with masked (score under the threshold, but never the best sentence, the first among equals) and the document's filter_rate."""
    by = W.partitionBy(*keys)
    rows = sents.withColumn("_p", score)
    first = F.row_number().over(by.orderBy(F.desc("_p"), "sent_idx")) == 1
    rows = rows.withColumn("masked", (F.col("_p") < threshold) & ~first)
    return rows.withColumn("filter_rate", F.round(F.avg(F.col("masked").cast("double")).over(by), 6)).drop("_p")
