"""Joins for keys of any weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts over which the rows of a key are spread.
PARTS = 16
#: Most rows of a side that is sent to every task; they are counted first.
SMALL = 200_000


def lookup(rows: DataFrame, info: DataFrame, on: str | list[str], by: Column | str, how: str = "left", parts: int = PARTS) -> DataFrame:
    """`rows` joined with `info`, which has one row a key (and `parts` times as many are shuffled).

    A key's rows are spread by a hash of `by` over `parts` tasks, so a key with a third of all rows does not meet in one. The sides are
    sorted and merged: neither is broadcast, whatever size is guessed for it. Null keys match nothing; `by` may be null.
    """
    keys = [on] if isinstance(on, str) else on
    spread = info.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    placed = rows.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    return placed.join(spread.hint("merge"), [*keys, "__part"], how).drop("__part")


def match(rows: DataFrame, info: DataFrame, on: str, by: Column | str) -> DataFrame:
    """Rows whose key is in `info`, a written table of one row a key: sent to every task if it was counted to be small, else by `lookup`."""
    if info.limit(SMALL + 1).count() <= SMALL:
        return rows.join(F.broadcast(info), on)
    return lookup(rows, info, on, by, "inner")
