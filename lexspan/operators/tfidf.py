"""Term weights as long tables of (row, term, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.functions.text import word_ngrams


def term_counts(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, term, tf) of words and word pairs; null texts have no terms."""
    return rows.select(row_id, F.explode(word_ngrams(text)).alias("term")).groupBy(row_id, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(counts: DataFrame, rows: DataFrame, least: int = 4, most: float = 0.8) -> DataFrame:
    """(term, df, n): rows of each term and rows in all, for terms in at least `least` rows and at most the share `most` of them."""
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(n).where((F.col("df") >= least) & (F.col("df") <= most * F.col("n")))


def tfidf(counts: DataFrame, frequencies: DataFrame, row_id: str) -> DataFrame:
    """(row_id, term, weight): root of the term's count times smooth inverse frequency, each row scaled to a sum of 1."""
    w = counts.join(frequencies, "term").select(row_id, "term", (F.sqrt("tf") * (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("_w"))
    return w.select(row_id, "term", (F.col("_w") / F.sum("_w").over(W.partitionBy(row_id))).alias("weight"))
