"""Problem 9: mixtures of sources with wanted shares, by temperature weights and budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.llm.encoding import count_tokens
from lexspan.sources.tables import materialise, table

#: Slots of a block permutation; a source's slots are summed before the slot that ends its budget is opened.
SLOTS = 65536
SEED = 17
#: Share of the greatest entropy of the sources' weights in a tempered mixture.
EVENNESS = 0.9


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares to the power of the exponent, normalised. Sources without share stay without."""
    raised = {k: v**exponent if v > 0 else 0.0 for k, v in shares.items()}
    total = sum(raised.values())
    return {k: v / total if total else 0.0 for k, v in raised.items()}


def entropy(shares: dict[str, float]) -> float:
    """In nats."""
    return -sum(v * math.log(v) for v in shares.values() if v > 0)


def bisect_exponent(shares: dict[str, float], target_entropy: float | None = None, limits: dict[str, float] | None = None, rounds: int = 60) -> float:
    """The exponent in 0..1 (1: the shares as they are, 0: all alike).

    With a target entropy: the largest exponent whose weights reach it (0 if none does). With limits: the least exponent
    whose weights keep within all limits (1 if none does): a small source is repeated least at exponent 1.
    """

    def low(e: float) -> bool:
        w = tempered(shares, e)
        if target_entropy is not None:
            return entropy(w) >= target_entropy
        return any(w[k] > (limits or {}).get(k, 1.0) + 1e-12 for k in w)

    lo, hi = 0.0, 1.0
    if low(hi):
        return hi
    if not low(lo):
        return lo
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if low(mid) else (lo, mid)
    return lo if target_entropy is not None else hi


def budgets(tokens: dict[str, int], all_tokens: int, weights: dict[str, int], repeats: dict[str, int], whole: int = 1000) -> dict[str, int]:
    """Tokens to draw from each source, as many as all documents hold together where the limits allow it.

    Every source gets its wanted share (weights are parts of `whole`), at most tokens * repeats. What limited sources leave goes to those with room, by
    token shares to the power of a bisected exponent (the least that keeps within the room), else filled up to the room.
    """
    limit = {k: tokens[k] * repeats[k] for k in tokens}
    out = {k: min(weights[k] * all_tokens // whole, limit[k]) for k in tokens}
    left = min(all_tokens, sum(limit.values())) - sum(out.values())
    while left > 0:
        room = {k: limit[k] - out[k] for k in tokens if limit[k] > out[k] and tokens[k]}
        if not room:
            break
        shares = {k: tokens[k] / all_tokens for k in room}
        e = bisect_exponent(shares, limits={k: room[k] / left for k in room})
        w = tempered(shares, e)
        given = {k: min(room[k], int(w[k] * left)) for k in room}
        if not any(given.values()):
            k = max(room, key=lambda k: (room[k], k))
            given = {k: min(left, room[k])}
        for k, v in given.items():
            out[k] += v
        left -= sum(given.values())
    return out


def source_totals(counted: DataFrame, targets: DataFrame) -> tuple[list[dict], int]:
    """Per source of `targets` its tokens, weight and limit, and the tokens of all documents.

    One row per target source reaches the driver (a parameter table). Of several rows of a source the largest weight and
    limit hold; null weights and limits count as 0; null sources match none.
    """
    goals = targets.where("source IS NOT NULL").groupBy("source").agg(F.max(F.coalesce("weight_permille", F.lit(0))).alias("weight_permille"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    sums = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    rows = goals.join(sums, "source", "left").select("source", "weight_permille", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens")).orderBy("source").collect()
    return [r.asDict() for r in rows], int(total)


def unreachable(rows: list[dict], total: int) -> list[str]:
    """Sources whose whole limit is in their budget and falls short of their share."""
    drawn = drawn_budgets(rows, total)
    return [r["source"] for r in rows if drawn[r["source"]] * 1000 < r["weight_permille"] * total and drawn[r["source"]] == r["tokens"] * r["max_repeats"]]


def drawn_budgets(rows: list[dict], total: int) -> dict[str, int]:
    """The budget of every target source: what `mixture` draws of it."""
    by = {r["source"]: r for r in rows}
    return budgets({k: int(r["tokens"]) for k, r in by.items()}, total, {k: r["weight_permille"] for k, r in by.items()}, {k: r["max_repeats"] for k, r in by.items()})


def tempered_budgets(rows: list[dict], total: int, evenness: float) -> tuple[float, dict[str, int]]:
    """The exponent and the budgets of a mixture as large as all documents whose source weights have `evenness` times the greatest entropy.

    Weights are the sources' token shares to the power of the exponent; each budget is at most the source's tokens times its repeats, and
    what limited sources leave is dealt out as in `budgets`.
    """
    by = {r["source"]: r for r in rows if r["tokens"]}
    held = sum(r["tokens"] for r in by.values())
    shares = {k: r["tokens"] / held for k, r in by.items()}
    exponent = bisect_exponent(shares, target_entropy=evenness * math.log(len(shares))) if len(shares) > 1 else 1.0
    weights = {k: int(1_000_000 * v) for k, v in tempered(shares, exponent).items()}
    limits = {k: r["max_repeats"] for k, r in by.items()}
    return exponent, budgets({k: int(r["tokens"]) for k, r in by.items()}, total, weights, limits, 1_000_000)


def mixture(counted: DataFrame, targets: DataFrame, id_column: str = "doc_id", seed: int = SEED, evenness: float | None = None) -> DataFrame:
    """(id, source, tokens, repeats) of every drawn document; `counted` has id, source and tokens. With `evenness` the weights
    are tempered ones (`tempered_budgets`), else those of `targets`.

    A source's documents are drawn in blocks, each a permutation of all of them: as many whole blocks as the budget holds,
    then the documents of the next block whose running sum stays within the rest. Permutations follow a hash, so the draw is
    stable. The running sum is taken over the sums of SLOTS slots of the hash first and over documents only in the
    slot that ends the budget, so no task holds a whole source. Documents without tokens are not drawn.
    """
    spark = counted.sparkSession
    rows, total = source_totals(counted, targets)
    by = {r["source"]: r for r in rows}
    drawn = drawn_budgets(rows, total) if evenness is None else tempered_budgets(rows, total, evenness)[1]
    plan = [(k, n // int(by[k]["tokens"]), n % int(by[k]["tokens"])) for k, n in drawn.items() if by[k]["tokens"]]
    at = F.broadcast(spark.createDataFrame(plan, "source string, _blocks bigint, _rest bigint"))
    slot = F.xxhash64(F.lit(seed), F.col("_blocks"), F.col(id_column))
    docs = counted.select(id_column, "source", "tokens").where("tokens > 0").join(at, "source").withColumn("_h", slot).withColumn("_slot", F.pmod(F.col("_h"), F.lit(SLOTS)))
    sums = docs.groupBy("source", "_rest", "_slot").agg(F.sum("tokens").alias("_n"))
    sums = sums.withColumn("_upto", F.sum("_n").over(W.partitionBy("source").orderBy("_slot")))
    ends = sums.where("_upto > _rest").groupBy("source").agg(F.min(F.struct("_slot", (F.col("_upto") - F.col("_n")).alias("_before"))).alias("_e"))
    ends = F.broadcast(ends.select("source", F.col("_e._slot").alias("_end"), F.col("_e._before").alias("_before")))
    docs = docs.join(ends, "source", "left")
    inside = docs.where("_end IS NULL OR _slot < _end").withColumn("_more", F.when(F.col("_rest") > 0, 1).otherwise(0))
    edge = docs.where("_slot = _end").withColumn("_run", F.col("_before") + F.sum("tokens").over(W.partitionBy("source").orderBy("_h", id_column).rowsBetween(W.unboundedPreceding, 0)))
    edge = edge.withColumn("_more", F.when(F.col("_run") <= F.col("_rest"), 1).otherwise(0)).drop("_run")
    after = docs.where("_slot > _end").withColumn("_more", F.lit(0))
    every = inside.unionByName(edge).unionByName(after)
    return every.select(id_column, "source", "tokens", (F.col("_blocks") + F.col("_more")).cast("int").alias("repeats")).where("repeats > 0")


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"]))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their wanted share."""
    sums = materialise(count_tokens(table(spark, sf_dir, "documents"), ["source"]).groupBy("source").agg(F.sum("tokens").alias("tokens")))
    rows, total = source_totals(sums, table(spark, sf_dir, "mix_targets"))
    return spark.createDataFrame([(s,) for s in unreachable(rows, total)], "source string")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document occurs in the mixture."""
    return mixture(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets")).select("doc_id", "source", "repeats")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached shares of each source, and whether its wanted share can be reached at all."""
    counted, targets = _counted(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    rows, total = source_totals(counted, targets)
    short = set(unreachable(rows, total))
    goals = spark.createDataFrame([(r["source"], r["weight_permille"], r["source"] not in short) for r in rows], "source string, wanted_permille int, reachable boolean")
    drawn = mixture(counted, targets).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.max("repeats").alias("most_repeats"))
    reached = F.round(F.col("drawn_tokens") * 1000.0 / F.lit(max(1, total)), 3)
    return goals.join(drawn, "source", "left").na.fill(0, ["drawn_tokens", "most_repeats"]).select("source", "wanted_permille", reached.alias("reached_permille"), "drawn_tokens", "most_repeats", "reachable")


def p9_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture in order: a row for every time a document is drawn, with its source's block and its place in the block's permutation.

    Within a source rows go by (block, place); places are 64-bit numbers in no other order than the permutation's.
    """
    drawn = mixture(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    blocks = drawn.select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("block"))
    return blocks.select("doc_id", "source", "block", F.xxhash64(F.lit(SEED), F.col("block").cast("long"), "doc_id").alias("place"))


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached when the sources' token shares are tempered to EVENNESS times the greatest entropy, with the exponent."""
    counted, targets = _counted(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    rows, total = source_totals(counted, targets)
    exponent = tempered_budgets(rows, total, EVENNESS)[0]
    drawn = mixture(counted, targets, evenness=EVENNESS).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.max("repeats").alias("most_repeats"))
    return drawn.select("source", F.round(F.lit(exponent), 6).alias("exponent"), "drawn_tokens", F.round(F.col("drawn_tokens") * 1000.0 / F.lit(max(1, total)), 3).alias("reached_permille"), "most_repeats")


QUERIES = {"p9_blocks": p9_blocks, "p9_tempered": p9_tempered, "p9_found": p9_found, "p9_mixture": p9_mixture, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
