"""Sentences, quotes and spans of texts as intervals of code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.functions.text import blank_tags, occurrences, part, sentence_list


def sentences(docs: DataFrame, text: str = "text", **features: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, sent_idx, sent_start, sent_end, features) of the non-blank sentences of every text with its tags blanked.

    `features` are expressions of a sentence's text, computed where it is cut.

    An end is the next sentence's start, or the text's length. Null texts and ids have no rows, blank texts none. Only
    lengths are shuffled, not the text.
    """
    pieces = docs.where(F.col(text).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.length(text).alias("_n"), F.posexplode(sentence_list(blank_tags(text))).alias("_k", "_p"))
    sized = pieces.select("doc_id", "_n", "_k", F.length("_p").alias("_l"), F.col("_p").rlike(r"\S").alias("_full"), *[f(F.col("_p")).alias(c) for c, f in features.items()])
    by = W.partitionBy("doc_id").orderBy("_k")
    placed = sized.withColumn("sent_start", (F.sum("_l").over(by) - F.col("_l")).cast("int")).where("_full")
    return placed.select("doc_id", (F.row_number().over(by) - 1).alias("sent_idx"), "sent_start", F.coalesce(F.lead("sent_start").over(by), F.col("_n")).alias("sent_end"), *features)


def boundary_arrays(sents: DataFrame) -> DataFrame:
    """(doc_id, starts): the sorted starts of each document's sentences."""
    return sents.groupBy("doc_id").agg(F.sort_array(F.collect_list("sent_start")).alias("starts"))


def bisect_right(starts: F.Column, at: F.Column) -> F.Column:
    """How many starts are at or before a place."""
    return F.size(F.filter(starts, lambda x: x <= at))


def bisect_left(starts: F.Column, at: F.Column) -> F.Column:
    """How many starts are before a place."""
    return F.size(F.filter(starts, lambda x: x < at))


def stretch(points: DataFrame, arrays: DataFrame) -> DataFrame:
    """`points` (document_id, quote_start, quote_end, ...) with idx_start, idx_end (exclusive), num_sents and num_doc_sents.

    A quote before the first sentence starts in it. Documents without sentences, and points without a quote, get nulls.
    """
    b = arrays.select(F.col("doc_id").alias("document_id"), "starts")
    rows = points.join(b, "document_id", "left")
    lo = F.greatest(bisect_right(F.col("starts"), F.col("quote_start")) - 1, F.lit(0))
    hi = bisect_left(F.col("starts"), F.col("quote_end"))
    known = F.col("starts").isNotNull() & F.col("quote_start").isNotNull() & F.col("quote_end").isNotNull()
    out = rows.withColumn("idx_start", F.when(known, lo)).withColumn("idx_end", F.when(known, hi))
    return out.withColumn("num_sents", F.col("idx_end") - F.col("idx_start")).withColumn("num_doc_sents", F.size("starts")).withColumn("num_doc_sents", F.when(F.col("starts").isNotNull(), F.col("num_doc_sents")))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows of `a` (lo, hi) joined with those of `b` (lo2, hi2) that overlap them, half-open; a null hi is endless.

    The equality on `keys` carries the join, the overlap is a residual condition.
    """
    right = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [a[k] == right[f"_{k}"] for k in keys]
    meet = (F.col("hi2").isNull() | (F.col("lo") < F.col("hi2"))) & (F.col("hi").isNull() | (F.col("hi") > F.col("lo2")))
    cond = meet
    for c in on:
        cond = c & cond
    out = a.join(right, cond, how)
    return out if how in ("left_anti", "left_semi") else out.drop(*[f"_{k}" for k in keys])


def relocate_quotes(points: DataFrame, docs: DataFrame) -> DataFrame:
    """Points with a quote and its place, checked against the text: adds matches_before, n_matches, new_start, new_end, matches_after.

    A quote that is not at its place but occurs exactly once moves there. Missing documents and null texts match nothing.
    """
    rows = points.join(docs.select(F.col("doc_id").alias("document_id"), "text"), "document_id", "left")
    quote = F.nullif(F.col("quote_text"), F.lit(""))
    same = F.coalesce(part("text", "quote_start", "quote_end") == quote, F.lit(False))
    n = F.coalesce(occurrences("text", quote), F.lit(0))
    rows = rows.withColumn("matches_before", same).withColumn("n_matches", n)
    move = ~F.col("matches_before") & (F.col("n_matches") == 1)
    found = F.position(quote, F.col("text")) - 1
    rows = rows.withColumn("new_start", F.when(move, found).otherwise(F.col("quote_start"))).withColumn("new_end", F.when(move, found + F.length(quote)).otherwise(F.col("quote_end")))
    return rows.withColumn("matches_after", F.coalesce(part("text", "new_start", "new_end") == quote, F.lit(False))).drop("text")
