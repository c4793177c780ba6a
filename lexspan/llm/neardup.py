"""Problem 6: near-duplicate texts, by min-max hashing, banding and an exact check of the candidates."""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators.components import components
from lexspan.sources.tables import materialise, stored, table

#: Characters in a run, the least letters and digits of a text, and the likeness of a pair.
RUN, LEAST, LIKE = 8, 200, 0.7
#: Permutations, strata of each, signature values in a band. 24 * 8 * 2 values make 64 bands of 6: a pair alike by exactly 0.7 is missed once in 3,000.
PERMUTATIONS, STRATA, ROWS = 24, 8, 6
BANDS = PERMUTATIONS * STRATA * 2 // ROWS
#: Bits of the sketch, one of each signature value, and how many must agree. At likeness 0.7 326 of 384 do (standard deviation 7).
SKETCH_BITS, SKETCH_AGREE = 384, 288
SKETCH_WORDS = SKETCH_BITS // 64
#: Texts of a band's bucket, or of a group of candidates, that are compared in one block; larger ones are cut into pairs of blocks.
BLOCK = 256
#: Bits of the filter of documents in candidate pairs. It only spares the reading of texts; its size is fixed, whatever the data.
FILTER_BITS = 1 << 27
#: Parts over which the copies of one text are spread when they look up their representative.
SALTS = 16
#: Bytes of run hashes kept by the exact check; texts beyond are hashed anew.
HELD = 64 << 20

_NOT_KEPT = re.compile(r"[\W_]+").sub
_M = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(6).integers(1, 2**63, size=PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(7).integers(1, 2**63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plain(text: str) -> str:
    """Lower-case letters and digits of a text; no marks, spaces or punctuation."""
    return _NOT_KEPT("", text.lower())


def fingerprint(norm: str) -> bytes:
    """Sixteen bytes that stand for a plain text."""
    return hashlib.blake2b(norm.encode("utf-8", "replace"), digest_size=16).digest()


def run_hashes(norm: str) -> np.ndarray:
    """A 64-bit hash of every run of RUN characters."""
    c = np.frombuffer(norm.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        p = np.uint64(0x100000001B3)
        p2 = p * p
        h2 = c[:-1] * p + c[1:]
        h4 = h2[:-2] * p2 + h2[2:]
        h = h4[:-4] * (p2 * p2) + h4[4:]
        h ^= h >> np.uint64(31)
        h *= _M
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Min-max signature: the least and the greatest value of each stratum under each permutation.

    The runs are cut into strata by three bits of their hash; each permutation multiplies by its own odd number. Keeping
    both ends of every stratum gives 2 * STRATA values for each evaluation of the hash. An empty stratum has the ends of an empty set.
    """
    stratum = (hashes & np.uint64(STRATA - 1)).astype(np.uint8)
    order = np.argsort(stratum, kind="stable")
    counts = np.bincount(stratum, minlength=STRATA)
    with np.errstate(over="ignore"):
        values = ((hashes[order][None, :] * _ODD[:, None]) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((PERMUTATIONS, STRATA, 2), np.uint32)
    out[..., 0], out[..., 1] = 0xFFFFFFFF, 0
    filled = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[filled]
    out[:, filled, 0] = np.minimum.reduceat(values, starts, axis=1)
    out[:, filled, 1] = np.maximum.reduceat(values, starts, axis=1)
    return out.reshape(-1)


def bands_and_sketch(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each band (the band's number in it), and the sketch as 64-bit words.

    A permutation's values spread over the bands, so that a band holds values of different permutations and strata.
    """
    spread = sig[: BANDS * ROWS].reshape(ROWS, BANDS).T.astype(np.uint64)
    with np.errstate(over="ignore"):
        k = ((spread + np.uint64(1)) * _MIX).sum(axis=1, dtype=np.uint64)
        k ^= k >> np.uint64(33)
        k *= _M
    keys = (k >> np.uint64(24)) | (np.arange(BANDS, dtype=np.uint64) << np.uint64(40))
    mixed = sig[:SKETCH_BITS] * np.uint32(0x9E3779B1)
    bits = np.packbits((mixed >> np.uint32(31)).astype(np.uint8))
    return keys.view(np.int64), bits.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            ids, prints, keys, sketches = [], [], [], []
            for i, text in zip(batch.column(0).slice(lo, 256).to_pylist(), batch.column(1).slice(lo, 256).to_pylist()):
                if text is None or i is None or len(text) < LEAST:
                    continue
                norm = plain(text)
                if len(norm) < LEAST:
                    continue
                k, s = bands_and_sketch(signature(run_hashes(norm)))
                ids.append(i)
                prints.append(fingerprint(norm))
                keys.append(k)
                sketches.append(s)
            n = len(ids)
            flat = lambda a, w: pa.ListArray.from_arrays(np.arange(0, n * w + 1, w, dtype=np.int32), pa.array(np.concatenate(a) if n else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.binary()), flat(keys, BANDS), flat(sketches, SKETCH_WORDS)], names=["id", "print", "keys", "sketch"])


def _join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose sides both grow with the data: sorted and merged, never broadcast, whatever size is guessed for them."""
    return left.join(right.hint("merge"), on, how)


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, place) of the rows whose key other rows have too, from rows sorted by key and id; place counts from 0.

    The rows pass as a stream: nothing but the last row is held, however many rows a key has. A repeated row counts once.
    """
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("place", pa.int64())])
    held_key, held_id, held_place = None, None, 0

    def out(k: np.ndarray, i: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(p)], schema=schema)

    for batch in batches:
        k, i = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        if held_key is not None:
            k, i = np.concatenate([[held_key], k]), np.concatenate([[held_id], i])
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
        k, i = k[new], i[new]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        at = np.arange(len(k))
        place = at - np.maximum.accumulate(np.where(first, at, 0))
        place[k == k[0]] += held_place
        follows = np.append(~first[1:], False)
        # The last row waits for the next batch: only then it is known whether its key goes on.
        keep = (place > 0) | follows
        keep[-1] = False
        held_key, held_id, held_place = k[-1], i[-1], int(place[-1])
        if keep.any():
            yield out(k[keep], i[keep], place[keep])
    if held_place:
        yield out(np.array([held_key]), np.array([held_id]), np.array([held_place]))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of one block whose sketches agree, from rows (block, side, id, sketch words) sorted by block and id.

    side is -1 in a block of its own, where all are paired; else 0 or 1, and the two sides are paired. A block holds 2 * BLOCK rows
    at most, so the rows held over from one batch to the next are bounded.
    """
    held: list[np.ndarray] | None = None
    least = np.uint32(SKETCH_BITS - SKETCH_AGREE)

    def pairs(block: np.ndarray, side: np.ndarray, ids: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.arange(len(block) - 1)
        step = 1
        while len(at := at[(at + step < len(block))]) and len(at := at[block[at] == block[at + step]]):
            crossed = at[(side[at] < 0) | (side[at] != side[at + step])]
            for lo in range(0, len(crossed), 65536):
                x = crossed[lo : lo + 65536]
                apart = np.bitwise_count(words[x] ^ words[x + step]).sum(axis=1, dtype=np.uint32)
                x = x[apart <= least]
                a, b = ids[x], ids[x + step]
                fine = a != b
                if fine.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[fine]), pa.array(np.maximum(a, b)[fine])], names=["a", "b"])
            step += 1

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(3)]
        words = batch.column(3)
        cols.append(words.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH_WORDS))
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
        last = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1 if (cols[0] != cols[0][-1]).any() else 0
        held = [c[last:] for c in cols]
        if last:
            yield from pairs(*(c[:last] for c in cols))
    if held is not None:
        yield from pairs(*held)


def _candidates(reps: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b), a < b: representatives that share a band and agree in most bits of the sketch.

    Only keys that two or more texts have go on. A bucket of up to BLOCK texts is compared as it is; a larger one is cut into
    blocks by the texts' places in it, and every pair of its blocks is a task's row group of its own.
    """
    keys = reps.select(F.explode("keys").alias("key"), "id").repartition("key").sortWithinPartitions("key", "id")
    shared = stored(keys.mapInArrow(_shared_keys, "key bigint, id bigint, place bigint"))
    small = shared.select(F.col("key").alias("block"), F.lit(-1).alias("side"), "id")
    hot = materialise(shared.where(F.col("place") >= BLOCK).groupBy("key").agg((F.floor(F.max("place") / BLOCK) + 1).cast("int").alias("_n")))
    if not hot.isEmpty():
        salt = F.pmod("id", F.lit(SALTS)).cast("int")
        sized = _join(shared.withColumn("_s", salt), hot.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "_s"], "left")
        mine = F.floor(F.col("place") / BLOCK).cast("int")
        other = sized.select("key", "id", mine.alias("_i"), F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)).alias("_j"), F.col("_n").isNull().alias("_whole"))
        lo, hi = F.least("_i", "_j"), F.greatest("_i", "_j")
        block = F.when(F.col("_whole"), F.col("key")).otherwise(F.xxhash64("key", lo, hi))
        side = F.when(F.col("_whole") | (lo == hi), -1).when(F.col("_i") == lo, 0).otherwise(1)
        small = other.select(block.alias("block"), side.alias("side"), "id")
    rows = _join(small, sketches, "id").select("block", "side", "id", "sketch")
    blocks = rows.repartition("block").sortWithinPartitions("block", "id")
    return blocks.mapInArrow(_near, "a bigint, b bigint").distinct()


def _participants(pairs: DataFrame) -> dict[int, bytes]:
    """A bitmap of the hashed ids of the pairs' documents, in pieces of 4,096 bytes, FILTER_BITS bits at most."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("_i")).select(F.pmod(F.xxhash64("_i"), F.lit(FILTER_BITS)).alias("_p"))
    words = ids.select((F.floor(F.col("_p") / 32768)).alias("_w"), (F.col("_p") % 32768).alias("_o")).groupBy("_w").agg(F.expr("bitmap_construct_agg(_o)").alias("_b"))
    return {int(r["_w"]): bytes(r["_b"]) for r in words.collect()}


class _Runs:
    """Distinct run hashes of a group's texts, kept up to HELD bytes."""

    def __init__(self) -> None:
        self.texts: dict[int, tuple[bytes, str]] = {}
        self.known: OrderedDict[int, np.ndarray] = OrderedDict()
        self.size = 0

    def clear(self) -> None:
        self.texts.clear()
        self.known.clear()
        self.size = 0

    def add(self, i: int, norm: str) -> None:
        mark = fingerprint(norm)
        if i not in self.texts or mark < self.texts[i][0]:
            self.texts[i] = (mark, norm)

    def of(self, i: int) -> np.ndarray:
        found = self.known.get(i)
        if found is None:
            found = self.known[i] = np.unique(run_hashes(self.texts[i][1]))
            self.size += found.nbytes
            while self.size > HELD and len(self.known) > 1:
                self.size -= self.known.popitem(last=False)[1].nbytes
        else:
            self.known.move_to_end(i)
        return found


def _like(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose runs overlap by `share` or more, counted exactly over 64-bit hashes of the runs.

    Rows (group, a, b, norm) are sorted by group, texts (b null) before pairs; a group's texts are let go with the group.
    """
    group, runs = None, _Runs()
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            keep_a, keep_b = [], []
            for g, a, b, norm in zip(*(part.column(j).to_pylist() for j in range(4))):
                if g != group:
                    group = g
                    runs.clear()
                if b is None:
                    runs.add(a, norm)
                    continue
                x, y = runs.of(a), runs.of(b)
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if shared >= share * (len(x) + len(y) - shared) - 1e-9:
                    keep_a.append(a)
                    keep_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], names=["a", "b"])


def _checked(near: DataFrame, rows: DataFrame, like: float) -> DataFrame:
    """The pairs of `near` whose texts are alike by `like`, compared run by run.

    A pair goes to the group of its first text's least neighbour, so that texts alike meet in one group and a text is sent
    there once, not once for each of its pairs. The group of a text with more than BLOCK neighbours is cut into pairs of parts.
    """
    both = near.select(F.col("a").alias("id"), F.col("b").alias("_o")).union(near.select(F.col("b").alias("id"), F.col("a").alias("_o")))
    hubs = both.groupBy("id").agg(F.least(F.min("_o"), F.col("id")).alias("_g"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("_k"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("_k"))
    routed = stored(_join(near, hubs.withColumnRenamed("id", "a"), "a").select(F.xxhash64("_g", "_k", part("a"), part("b")).alias("group"), "a", "b"))
    needs = routed.select("group", F.col("a").alias("id")).union(routed.select("group", F.col("b").alias("id"))).distinct()
    bitmap = near.sparkSession.sparkContext.broadcast(_participants(near))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {w: np.frombuffer(b, np.uint8) for w, b in bitmap.value.items()}
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            chosen = [j for j, p in enumerate(at.tolist()) if (bits := pieces.get(p >> 15)) is not None and bits[(p & 32767) >> 3] >> (p & 7) & 1]
            for lo in range(0, len(chosen), 256):
                part = batch.take(pa.array(chosen[lo : lo + 256]))
                norm = [plain(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(norm, pa.string())], names=["id", "norm"])

    placed = rows.where("id IS NOT NULL AND text IS NOT NULL").select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("_p"), "id", "text")
    norms = placed.mapInArrow(texts, "id bigint, norm string").where(F.length("norm") >= LEAST)
    sent = _join(needs, norms, "id").select("group", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "norm")
    stream = sent.union(routed.select("group", "a", "b", F.lit(None).cast("string"))).repartition("group").sortWithinPartitions("group", F.col("b").isNotNull(), "a", "b")
    return stream.mapInArrow(lambda it: _like(it, like), "a bigint, b bigint")


def similar_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", like: float = LIKE) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): `members` (id, rep, copies) has every text of at least LEAST letters and digits with the least id of its exact
    copies and their number; `pairs` (a, b), a < b, the representatives alike by `like` or more. Null, empty and shorter texts and null ids
    have no row; repeated rows count once, and of several texts under one id the one with the least fingerprint does.

    One pass hashes the texts; copies are folded into one representative before anything is paired, so a third of all rows
    with one text costs nothing further on. Band keys stream past in order and those of one text alone are left out; a candidate
    pair must agree in most bits of a 48-byte sketch before its texts are compared, run by run. The texts are read again only for
    documents in candidate pairs. Nothing that grows with the data is broadcast or collected; no bucket is capped.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = stored(rows.mapInArrow(_signatures, "id bigint, print binary, keys array<bigint>, sketch array<bigint>"))
    owners = signed.groupBy("id").agg(F.min("print").alias("print"))
    copies = owners.groupBy("print").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    spread = copies.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = _join(owners.withColumn("_s", F.pmod("id", F.lit(SALTS)).cast("int")), spread, ["print", "_s"], "left")
    members = stored(found.select("id", "print", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")))
    single = members.where("id = rep").select("id", "print")
    reps = _join(signed.select("id", "print", "keys"), single, ["id", "print"], "left_semi")
    sketches = _join(signed.select("id", "print", "sketch"), single, ["id", "print"], "left_semi").dropDuplicates(["id"]).select("id", "sketch")
    near = stored(_candidates(reps, sketches))
    return members.select("id", "rep", "copies"), stored(_checked(near, rows, like))


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of documents: those of the representatives with all their copies, and the copies among themselves.

    The copies of a text are cut into parts of about BLOCK, and every pair of parts is a join key of its own, so that no task gets
    all pairs of a text with many copies.
    """
    k = F.ceil(F.col("copies") / BLOCK)
    parts = members.select("rep", "id", "copies", k.alias("_k"), F.pmod(F.xxhash64("id"), k).alias("_p"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))
    several = parts.where("copies > 1").withColumn("_q", every)
    left = several.select("rep", F.col("_p").alias("_i"), F.col("_q").alias("_j"), F.col("id").alias("_x"))
    right = several.select("rep", F.col("_q").alias("_i"), F.col("_p").alias("_j"), F.col("id").alias("_y"))
    alike = _join(left, right, ["rep", "_i", "_j"]).where("_x < _y")
    apart = pairs
    for end, to in (("a", "_x"), ("b", "_y")):
        sizes = parts.where("id = rep").select(F.col("rep").alias(end), "_k")
        cut = _join(apart, sizes, end).withColumn("_p", every).drop("_k")
        apart = _join(cut, parts.select(F.col("rep").alias(end), "_p", F.col("id").alias(to)), [end, "_p"]).drop("_p")
    both = apart.select("_x", "_y").union(alike.select("_x", "_y"))
    return both.select(F.least("_x", "_y").alias("doc_id_a"), F.greatest("_x", "_y").alias("doc_id_b"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of documents alike by 0.7 or more."""
    return expand_pairs(*similar_texts(table(spark, sf_dir, "documents")))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its class (the least id of its component), its number of links to other texts, and of exact copies."""
    members, pairs = similar_texts(table(spark, sf_dir, "documents"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    roots = components(pairs).select(F.col("node").alias("rep"), F.col("root").alias("class_id"))
    linked = stored(_join(_join(members.where("id = rep").select("rep", "copies"), links, "rep"), roots, "rep"))
    # A text with copies is looked up in several places, each by a part of them.
    salts = F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = linked.select("rep", "links", "class_id", F.explode(salts).alias("_s"))
    mine = members.withColumn("_s", F.when(F.col("copies") > 1, F.pmod("id", F.lit(SALTS)).cast("int")).otherwise(0))
    found = _join(mine, spread, ["rep", "_s"], "left")
    return found.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies")


QUERIES = {"p6_found": p6_found, "p6_classes": p6_classes}
SQL: dict[str, str] = {}
