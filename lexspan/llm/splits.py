"""Problem 4: splits that keep related records together, by an incremental table of components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators.components import components
from lexspan.operators.joins import lookup
from lexspan.operators.references import current_rows
from lexspan.sources.tables import materialise, scratch_path, stored, table

#: Slots by which small new components are dealt out; components over LARGE of the total weight (fewer than 1/LARGE) go one by one.
SLOTS, LARGE = 4096, 0.002
QUARANTINE = "quarantine"
EMPTY = "node string, component string, split string"


def extend_components(edges: DataFrame, weights: DataFrame, prior: DataFrame, targets: DataFrame, split: str = "split", permille: str = "share_permille") -> DataFrame:
    """The table (node, component, split) after a batch of links between nodes.

    `edges` (a, b) are the batch's links, a null or equal end adds a node without a link; `weights` (node, weight) are the
    records of each node so far, old and new; `prior` is the table before, empty at first. Components without an earlier
    split fill the deficits against `targets`; those with one earlier split keep it; a link between components of different
    splits puts the whole of them into `quarantine`, which stays. Repeated links count once. Targets with null or no
    positive share are left out; with no target left every new component is quarantined.

    No side of a join is broadcast but one row a slot, and a component's nodes are spread over several tasks where they look up their root or split. The
    table is written anew with every batch: only its contraction is confined to the batch.

    Ends of links are replaced by their earlier components first, so only the batch and the components it touches are
    contracted (by pointer jumping), not the whole history. Large new components are placed greedily by weight: fewer than
    1 / LARGE rows; the others by the sums of SLOTS hash slots: both bounds hold for data of any size.
    """
    spark = edges.sparkSession
    ends = edges.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).where("a IS NOT NULL").distinct()
    known = prior.select("node", "component")
    for end in ("a", "b"):
        ends = lookup(ends, known.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "b" if end == "a" else "a", parts=4)
    ends = materialise(ends)
    roots = materialise(components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))))
    moved = roots.select(F.col("node").alias("component"), F.col("root").alias("_root"))
    old = lookup(prior, moved, "component", "node").select("node", F.coalesce("_root", "component").alias("component"), "split")
    new = ends.select(F.col("a").alias("node"), F.coalesce("_a", "a").alias("component")).union(ends.select(F.col("b").alias("node"), F.coalesce("_b", "b").alias("component"))).distinct()
    new = lookup(new.join(known.select("node").hint("merge"), "node", "left_anti"), moved, "component", "node").select("node", F.coalesce("_root", "component").alias("component"), F.lit(None).cast("string").alias("split"))
    every = materialise(old.union(new))
    sized = every.join(weights.groupBy("node").agg(F.sum("weight").alias("weight")).hint("merge"), "node", "left")
    totals = materialise(
        sized.groupBy("component").agg(
            F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"),
            F.min("split").alias("_least"),
            F.max("split").alias("_most"),
        )
    )
    kept = F.when(F.col("_least").isNull(), None).when(F.col("_least") == F.col("_most"), F.col("_least")).otherwise(QUARANTINE)
    totals = totals.withColumn("split", kept)
    fresh = totals.where("split IS NULL").select("component", "weight")
    shares = {r[0]: r[1] for r in targets.where(F.col(split).isNotNull() & (F.col(permille) > 0)).groupBy(split).agg(F.max(permille)).collect()}
    if not shares:
        placed = fresh.select("component", F.lit(QUARANTINE).alias("_new"))
    else:
        total = totals.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n")).first()["n"]
        have = {r["split"]: r["n"] for r in totals.where("split IS NOT NULL").groupBy("split").agg(F.sum("weight").alias("n")).collect()}
        deficit = {k: total * v / sum(shares.values()) - have.get(k, 0) for k, v in shares.items()}
        big = fresh.where(F.col("weight") > total * LARGE)
        small = fresh.where(F.col("weight") <= total * LARGE).withColumn("_slot", F.pmod(F.xxhash64("component"), F.lit(SLOTS)).cast("int"))

        def place(rows: list) -> list[tuple]:
            out = []
            for key, weight in rows:
                best = max(sorted(deficit), key=lambda k: deficit[k])
                deficit[best] -= weight
                out.append((key, best))
            return out

        big_rows = place([(r["component"], r["weight"]) for r in big.orderBy(F.desc("weight"), "component").collect()])
        slots = place([(r["_slot"], r["n"]) for r in small.groupBy("_slot").agg(F.sum("weight").alias("n")).orderBy(F.desc("n"), "_slot").collect()])
        placed = small.join(F.broadcast(spark.createDataFrame(slots, "_slot int, _new string")), "_slot").select("component", "_new")
        placed = placed.union(spark.createDataFrame(big_rows, "component string, _new string"))
    final = totals.join(placed.hint("merge"), "component", "left").select("component", F.coalesce("split", "_new").alias("split"))
    return lookup(every.select("node", "component"), final, "component", "node", "inner").select("node", "component", "split")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "service_id", "created_at")


def span_documents(spans: DataFrame, points: DataFrame) -> DataFrame:
    """`spans` with `_doc`: the span's document or, if null, the one of its point's current row (null if neither)."""
    own = spans.where("document_id IS NOT NULL").withColumn("_doc", F.col("document_id"))
    bare = spans.where("document_id IS NULL")
    asked = bare.select(F.col("point_id").alias("id")).distinct()
    current = current_rows(points.join(asked, "id", "left_semi"), "id", "updated_at", ["id", "document_id"], tie="ingested_at")
    lent = bare.join(current.select(F.col("id").alias("point_id"), F.col("document_id").alias("_doc")), "point_id", "left")
    return own.unionByName(lent)


def torn_groups(spans: DataFrame, membership: DataFrame, group: str = "case_id", fold: str = "fold") -> DataFrame:
    """(group, component) whose records carry two or more different non-null folds; `membership` is (_doc, component).

    Least and greatest fold per (group, document) are taken before the join with the documents' components, so a document
    or component with a third of all spans is one row per group by then.
    """
    per_doc = spans.where(F.col("_doc").isNotNull() & F.col(fold).isNotNull()).groupBy(group, "_doc").agg(F.min(fold).alias("_lo"), F.max(fold).alias("_hi"))
    per = per_doc.join(membership.hint("merge"), "_doc").groupBy(group, "component").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return per.where("_lo < _hi").select(group, "component")


def _node(kind: str, column: str) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services torn apart by the folds of the spans, per case.

    The membership is the component table's: the component of a service's documents has the service as its least node.
    """
    state = split_table(spark, sf_dir, ("9999-01-01",)).where("node LIKE 'b:%' AND component LIKE 'a:%'")
    of = stored(state.select(F.substring("node", 3, 20).cast("long").alias("_doc"), F.substring("component", 3, 20).cast("long").alias("component")), "membership")
    spans = span_documents(table(spark, sf_dir, "sent_spans").select("case_id", "point_id", "document_id", "fold"), table(spark, sf_dir, "points"))
    torn = torn_groups(spans, of).select("case_id", F.col("component").alias("service_id"))
    listed = table(spark, sf_dir, "services").select(F.col("id").alias("service_id")).where("service_id IS NOT NULL").distinct()
    return torn.join(listed.hint("merge"), "service_id", "left_semi").select("case_id", "service_id")


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their links, and the spans' weights by document node."""
    docs = _documents(spark, sf_dir).where("doc_id IS NOT NULL").withColumn("b", _node("b", "doc_id")).withColumn("a", _node("a", "service_id"))
    spans = span_documents(table(spark, sf_dir, "sent_spans").select("case_id", "point_id", "document_id"), table(spark, sf_dir, "points"))
    weights = docs.select(F.col("b").alias("node"), F.lit(1).cast("long").alias("weight")).union(spans.where("_doc IS NOT NULL").groupBy(_node("b", "_doc").alias("node")).agg(F.count(F.lit(1)).alias("weight")))
    return docs, weights


def split_table(spark: SparkSession, sf_dir: str, batches: tuple[str, ...] = ("2020-01-01", "9999-01-01")) -> DataFrame:
    """The component table after the documents of each batch (by created_at; null times come in the last one).

    The table is written between batches and read again, as a pipeline would do from one day to the next.
    """
    docs, weights = _records(spark, sf_dir)
    targets = table(spark, sf_dir, "split_targets")
    state, since = spark.createDataFrame([], EMPTY), "0001-01-01"
    for until in batches:
        late = F.col("created_at").isNull() & F.lit(until == batches[-1])
        batch = docs.where(((F.col("created_at") >= since) & (F.col("created_at") < until)) | late)
        path = scratch_path(spark, "components")
        seen = docs.where((F.col("created_at") < until) | late).select(F.col("b").alias("node")).distinct()
        extend_components(batch.select("a", "b"), weights.join(seen, "node", "left_semi"), state, targets).write.parquet(path)
        state, since = spark.read.schema(EMPTY).parquet(path), until
    return state


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every document."""
    state = split_table(spark, sf_dir).where("node LIKE 'b:%'")
    return state.select(F.substring("node", 3, 20).cast("long").alias("doc_id"), "component", "split")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and spans of each split, and its share of both together."""
    _, weights = _records(spark, sf_dir)
    sums = weights.join(split_table(spark, sf_dir), "node").groupBy("split").agg(F.sum("weight").alias("records"))
    total = sums.agg(F.sum("records").alias("_all"))
    return sums.join(F.broadcast(total)).select("split", "records", F.round(F.col("records") * 1000.0 / F.col("_all"), 3).alias("permille"))


QUERIES = {"p4_found": p4_found, "p4_splits": p4_splits, "p4_shares": p4_shares}
SQL = {
    "p4_found": """
WITH cur AS (SELECT id, document_id FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST) rn FROM points) WHERE rn = 1),
s AS (SELECT s.case_id, s.fold, coalesce(s.document_id, c.document_id) doc FROM sent_spans s LEFT JOIN cur c ON s.point_id = c.id),
d AS (SELECT doc_id, service_id FROM documents WHERE service_id IN (SELECT id FROM services))
SELECT case_id, service_id FROM s JOIN d ON s.doc = d.doc_id GROUP BY 1, 2 HAVING count(DISTINCT fold) >= 2"""
}
