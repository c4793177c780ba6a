"""Draws that depend on keys alone: the same rows give the same draw in any plan, on any cluster, in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(seed: str, *keys: Column | str) -> Column:
    """md5 of the seed and the keys, joined by colons; nulls are left out."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def key_hash_sql(seed: str, *keys: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(keys)}))"


def uniform(seed: str, *keys: Column | str) -> Column:
    """A number from 0 up to 1."""
    return F.conv(F.substring(key_hash(seed, *keys), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_sql(seed: str, *keys: str) -> str:
    return f"(('0x' || substr({key_hash_sql(seed, *keys)}, 1, 8))::BIGINT / 4294967296.0)"


def integer_below(bound: Column, seed: str, *keys: Column | str) -> Column:
    """A whole number from 0 up to `bound`, exclusive."""
    return F.pmod(F.conv(F.substring(key_hash(seed, *keys), 1, 8), 16, 10).cast("bigint"), bound.cast("bigint"))


def integer_below_sql(bound: str, seed: str, *keys: str) -> str:
    return f"(('0x' || substr({key_hash_sql(seed, *keys)}, 1, 8))::BIGINT % ({bound}))"
