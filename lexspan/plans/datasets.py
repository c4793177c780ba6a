"""Draws, folds and labelled datasets of spans and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.functions.draws import integer_below, integer_below_sql, key_hash_sql, uniform_sql
from lexspan.operators.sampling import draw_sizes, fold_of, hash_rank, window_sizes
from lexspan.operators.spans import boundary_arrays, overlapping, sentences
from lexspan.plans.common import CUR, SVC, Registry, Tables
from lexspan.plans.spans import STRETCH, stretched
from lexspan.sources.tables import materialise

R = Registry()
QUERIES, SQL = R.queries, R.sql


def rank_sql(group: str, seed: str, *keys: str) -> str:
    by = f"PARTITION BY {group} " if group else ""
    return f"(row_number() OVER ({by}ORDER BY {key_hash_sql(seed, *keys)}, {', '.join(keys)}) - 1)"


@R.add("SMP1_uniform_sample", f"SELECT doc_id FROM documents QUALIFY {rank_sql('', 'pick', 'doc_id')} < 600")
def uniform_sample(t: Tables) -> DataFrame:
    return hash_rank(t.documents.select("doc_id"), [], "pick", ["doc_id"]).where("rank0 < 600").select("doc_id")


@R.add("SMP2_draw_with_replacement", f"""WITH n AS (SELECT count(*) n FROM documents), r AS (SELECT doc_id, {rank_sql('', 'order', 'doc_id')} k FROM documents),
d AS (SELECT id case_id, unnest(range(0, 20)) draw FROM cases) SELECT case_id, draw, r.doc_id FROM d, n JOIN r ON r.k = {integer_below_sql('n.n', 'draw', 'case_id', 'draw')}""")
def draw_with_replacement(t: Tables) -> DataFrame:
    """Twenty documents for each case, drawn with replacement by their place in a hash order."""
    ranked = hash_rank(t.documents.select("doc_id"), [], "order", ["doc_id"])
    n = F.broadcast(ranked.agg(F.max("group_size").alias("_n")))
    draws = t.cases.select(F.col("id").alias("case_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("draw")).join(n)
    return draws.withColumn("rank0", integer_below(F.col("_n"), "draw", "case_id", "draw")).join(ranked, "rank0").select("case_id", "draw", "doc_id")


@R.add("SMP6_stratified_cap", f"SELECT case_id, point_id, document_id, label, char_start FROM (SELECT DISTINCT case_id, point_id, document_id, label, char_start FROM sent_spans WHERE label IS NOT NULL) QUALIFY {rank_sql('label', 'cap', 'case_id', 'point_id', 'document_id', 'char_start')} < 50")
def stratified_cap(t: Tables) -> DataFrame:
    rows = t.sent_spans.where("label IS NOT NULL").select("case_id", "point_id", "document_id", "label", "char_start").distinct()
    return hash_rank(rows, ["label"], "cap", ["case_id", "point_id", "document_id", "char_start"]).where("rank0 < 50").drop("rank0", "group_size")


@R.add("SMP10_stratified_kfold", f"WITH {CUR} SELECT id, status, CAST({rank_sql('status', 'kfold', 'id')} % 5 AS INTEGER) fold FROM cur")
def stratified_kfold(t: Tables) -> DataFrame:
    return hash_rank(t.current_points(["id", "status"]), ["status"], "kfold", ["id"]).select("id", "status", (F.col("rank0") % 5).cast("int").alias("fold"))


@R.add("SMP8_rebalance", f"""WITH {CUR}, x AS (SELECT id, case_id, CASE WHEN status = 'approved' THEN 1 ELSE 0 END label FROM cur WHERE case_id IS NOT NULL),
r AS (SELECT *, {rank_sql('case_id, label', 'balance', 'id')} k, sum(label) OVER (PARTITION BY case_id) pos, sum(1 - label) OVER (PARTITION BY case_id) neg FROM x)
SELECT id, case_id, label FROM r WHERE label = 1 OR (pos > 0 AND k < least(2, neg // pos) * pos)""")
def rebalance(t: Tables) -> DataFrame:
    """All positives, and at most twice as many negatives, by case."""
    x = t.current_points(["id", "case_id", "status"]).where("case_id IS NOT NULL").select("id", "case_id", F.when(F.col("status") == "approved", 1).otherwise(0).alias("label"))
    ranked = hash_rank(x, ["case_id", "label"], "balance", ["id"])
    n = x.groupBy("case_id").agg(F.sum("label").alias("_pos"), F.sum(1 - F.col("label")).alias("_neg"))
    wanted = F.least(F.lit(2), F.coalesce(F.floor(F.try_divide("_neg", "_pos")), F.lit(0))) * F.col("_pos")
    return ranked.join(n, "case_id").where((F.col("label") == 1) | ((F.col("_pos") > 0) & (F.col("rank0") < wanted))).select("id", "case_id", "label")


@R.add("WN13_head_per_group", f"SELECT DISTINCT fold, label, document_id FROM (SELECT fold, label, document_id, dense_rank() OVER (PARTITION BY fold, label ORDER BY document_id) k FROM sent_spans WHERE document_id IS NOT NULL) WHERE k <= 10")
def head_per_group(t: Tables) -> DataFrame:
    """The ten least documents of each fold and label; every task keeps ten of a group before anything is moved."""
    rows = t.sent_spans.where("document_id IS NOT NULL").select("fold", "label", "document_id").distinct()
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("fold", "label").orderBy("document_id"))).where("_r <= 10").select("fold", "label", "document_id")


SIZES = "sz0 AS (SELECT case_id, num_sents w, count(*) n FROM pts WHERE num_sents >= 1 GROUP BY 1, 2), sizes AS (SELECT case_id, w, (sum(n) OVER o - n) / sum(n) OVER g lo, sum(n) OVER o / sum(n) OVER g hi FROM sz0 WINDOW o AS (PARTITION BY case_id ORDER BY w), g AS (PARTITION BY case_id))"


def sized_points(t: Tables) -> DataFrame:
    """Stretched points of one sentence or more with their case."""
    return stretched(t).where("num_sents >= 1 AND case_id IS NOT NULL").drop("starts")


@R.add("OP3_window_sizes", f"WITH {STRETCH}, {SIZES} SELECT case_id, w, round(hi - lo, 6) share FROM sizes WHERE case_id IS NOT NULL")
def window_sizes_query(t: Tables) -> DataFrame:
    return window_sizes(sized_points(t)).select("case_id", "w", F.round(F.col("hi") - F.col("lo"), 6).alias("share"))


FAMILIES = f"""{STRETCH}, {SIZES}, ap AS (SELECT * FROM pts WHERE status = 'approved' AND num_sents >= 1 AND case_id IS NOT NULL),
dr AS (SELECT a.*, side, z.w FROM ap a, (VALUES ('before'), ('after')) v(side) JOIN sizes z ON z.case_id = a.case_id AND {uniform_sql('side', 'side', 'a.id')} >= z.lo AND {uniform_sql('side', 'side', 'a.id')} < z.hi),
surrounding AS (SELECT case_id, document_id, id point_id, side, CASE WHEN side = 'before' THEN greatest(idx_start - w, 0) ELSE idx_end END lo, CASE WHEN side = 'before' THEN idx_start ELSE least(idx_end + w, num_doc_sents) END hi FROM dr WHERE CASE WHEN side = 'before' THEN idx_start >= 1 ELSE idx_end < num_doc_sents END),
na AS (SELECT case_id, count(*) n FROM ap GROUP BY 1),
tp0 AS (SELECT c.id target_case, p.id point_id, p.document_id, p.idx_start lo, p.idx_end hi FROM ap p JOIN cases o ON o.id = p.case_id JOIN cases c ON c.topic_id = o.topic_id AND c.id <> o.id
  WHERE NOT EXISTS (SELECT 1 FROM ap a WHERE a.case_id = c.id AND a.document_id = p.document_id AND a.idx_start < p.idx_end AND p.idx_start < a.idx_end)),
topical AS (SELECT t.* FROM tp0 t JOIN na ON na.case_id = t.target_case QUALIFY {rank_sql('target_case', 'topical', 'target_case', 'point_id')} < 3 * n),
dd AS (SELECT case_id, document_id, any_value(num_doc_sents) n, list(struct_pack(lo := idx_start, hi := idx_end)) r FROM ap GROUP BY 1, 2),
sl AS (SELECT dd.*, slot, z.w FROM dd, (SELECT unnest(range(0, 5)) slot) JOIN sizes z ON z.case_id = dd.case_id AND {uniform_sql('slot', 'dd.case_id', 'document_id', 'slot')} >= z.lo AND {uniform_sql('slot', 'dd.case_id', 'document_id', 'slot')} < z.hi),
tr AS (SELECT *, {integer_below_sql('n', 'try', 'case_id', 'document_id', 'slot', 'k')} s FROM sl, (SELECT unnest(range(0, 5)) k)),
doc_random AS (SELECT case_id, document_id, slot, CAST(s AS INTEGER) lo, CAST(s + w AS INTEGER) hi FROM tr WHERE len(list_filter(r, lambda o: s >= o.lo - w AND s < o.hi)) = 0 QUALIFY row_number() OVER (PARTITION BY case_id, document_id, slot ORDER BY k) = 1)"""


def approved(t: Tables) -> DataFrame:
    return sized_points(t).where("status = 'approved'")


def surrounding(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """Windows just before and just after each point, of sizes drawn from its case's distribution."""
    rows = draw_sizes(points.withColumn("side", F.explode(F.array(F.lit("before"), F.lit("after")))), sizes, "side", ["side", "id"])
    before = F.col("side") == "before"
    rows = rows.where(F.when(before, F.col("idx_start") >= 1).otherwise(F.col("idx_end") < F.col("num_doc_sents")))
    lo = F.when(before, F.greatest(F.col("idx_start") - F.col("w"), F.lit(0))).otherwise(F.col("idx_end"))
    hi = F.when(before, F.col("idx_start")).otherwise(F.least(F.col("idx_end") + F.col("w"), F.col("num_doc_sents")))
    return rows.select("case_id", "document_id", F.col("id").alias("point_id"), "side", lo.alias("lo"), hi.alias("hi"))


@R.add("OP4_surrounding_negatives", f"WITH {FAMILIES} SELECT * FROM surrounding")
def surrounding_negatives(t: Tables) -> DataFrame:
    points = materialise(sized_points(t))
    return surrounding(points.where("status = 'approved'"), window_sizes(points))


def topical(points: DataFrame, cases: DataFrame) -> DataFrame:
    """Points of other cases of the same topic that overlap none of the case's own, at most three times as many as those."""
    named = points.join(F.broadcast(cases.select(F.col("id").alias("case_id"), "topic_id")), "case_id")
    targets = F.broadcast(cases.select(F.col("id").alias("target_case"), "topic_id"))
    rows = named.join(targets, "topic_id").where("target_case <> case_id").select("target_case", F.col("id").alias("point_id"), "document_id", F.col("idx_start").alias("lo"), F.col("idx_end").alias("hi"))
    own = points.select(F.col("case_id").alias("target_case"), "document_id", F.col("idx_start").alias("lo2"), F.col("idx_end").alias("hi2"))
    free = overlapping(rows, own, ["target_case", "document_id"], "left_anti")
    n = points.groupBy(F.col("case_id").alias("target_case")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = hash_rank(free.join(n, "target_case"), ["target_case"], "topical", ["target_case", "point_id"])
    return ranked.where(F.col("rank0") < 3 * F.col("_n")).select("target_case", "point_id", "document_id", "lo", "hi")


@R.add("OP5_topical_negatives", f"WITH {FAMILIES} SELECT * FROM topical")
def topical_negatives(t: Tables) -> DataFrame:
    return topical(materialise(approved(t)), t.cases)


def doc_random(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """Five slots for each case and document; a slot takes the first of five drawn starts whose window touches no point."""
    docs = points.groupBy("case_id", "document_id").agg(F.max("num_doc_sents").alias("_n"), F.collect_set(F.struct(F.col("idx_start").alias("lo"), F.col("idx_end").alias("hi"))).alias("_r"))
    slots = draw_sizes(docs.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))), sizes, "slot", ["case_id", "document_id", "slot"])
    tries = F.array(*[integer_below(F.col("_n"), "try", "case_id", "document_id", "slot", F.lit(k)).cast("int") for k in range(5)])
    free = F.filter(tries, lambda s: ~F.exists("_r", lambda o: (s >= o["lo"] - F.col("w")) & (s < o["hi"])))
    first = slots.withColumn("lo", F.get(free, 0)).where("lo IS NOT NULL")
    return first.select("case_id", "document_id", "slot", "lo", (F.col("lo") + F.col("w")).cast("int").alias("hi"))


@R.add("OP6_doc_random_negatives", f"WITH {FAMILIES} SELECT * FROM doc_random")
def doc_random_negatives(t: Tables) -> DataFrame:
    points = materialise(sized_points(t))
    return doc_random(points.where("status = 'approved'"), window_sizes(points))


REVIEWED = f"""{FAMILIES}, {SVC}, np AS (SELECT document_id, count(*) k FROM cur GROUP BY 1), ns AS (SELECT doc_id, CAST(count(*) AS INTEGER) n FROM sents GROUP BY 1),
el AS (SELECT d.doc_id, ns.n FROM documents d JOIN svc s ON s.id = d.service_id AND s.is_comprehensively_reviewed JOIN np ON np.document_id = d.doc_id AND np.k >= 10 JOIN ns ON ns.doc_id = d.doc_id),
er AS (SELECT *, {rank_sql('', 'eligible', 'doc_id')} k, count(*) OVER () m FROM el),
rd AS (SELECT case_id, unnest(range(0, CAST(3 * n AS BIGINT))) draw FROM na),
rk AS (SELECT rd.*, er.doc_id, er.n FROM rd, (SELECT max(m) m FROM er) mm JOIN er ON er.k = {integer_below_sql('mm.m', 'reviewed', 'case_id', 'draw')}),
rw AS (SELECT rk.*, least(z.w, rk.n) w FROM rk JOIN sizes z ON z.case_id = rk.case_id AND {uniform_sql('rwin', 'rk.case_id', 'draw')} >= z.lo AND {uniform_sql('rwin', 'rk.case_id', 'draw')} < z.hi
  WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.case_id = rk.case_id AND p.document_id = rk.doc_id)),
reviewed_random AS (SELECT case_id, doc_id document_id, draw, CAST(CASE WHEN n - w > 0 THEN {integer_below_sql('n - w', 'rstart', 'case_id', 'draw')} ELSE 0 END AS INTEGER) lo, w FROM rw)"""


def reviewed_random(t: Tables, points: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each case three times as many windows as approved points, in documents drawn from those much annotated; documents with a point of the case are left out."""
    reviewed = t.services.where("is_comprehensively_reviewed").select(F.col("id").alias("service_id")).distinct()
    busy = t.current_points(["id", "document_id"]).groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("_k")).where("_k >= 10")
    sents = t.starts().select("doc_id", F.size("starts").alias("_n"))
    eligible = t.documents.select("doc_id", "service_id").join(reviewed, "service_id", "left_semi").join(busy, "doc_id", "left_semi").join(sents, "doc_id").select("doc_id", "_n")
    ranked = materialise(hash_rank(eligible, [], "eligible", ["doc_id"]))
    m = F.broadcast(ranked.agg(F.max("group_size").alias("_m")))
    n = points.where("status = 'approved'").groupBy("case_id").agg(F.count(F.lit(1)).alias("_a"))
    draws = n.select("case_id", F.explode(F.sequence(F.lit(0).cast("long"), 3 * F.col("_a") - 1)).alias("draw")).join(m)
    picked = draws.withColumn("rank0", integer_below(F.col("_m"), "reviewed", "case_id", "draw")).join(ranked, "rank0").select("case_id", "draw", "doc_id", "_n")
    free = picked.join(t.points.select("case_id", F.col("document_id").alias("doc_id")), ["case_id", "doc_id"], "left_anti")
    rows = draw_sizes(free, sizes, "rwin", ["case_id", "draw"]).withColumn("w", F.least("w", "_n"))
    room = F.col("_n") - F.col("w")
    lo = F.when(room > 0, integer_below(F.greatest(room, F.lit(1)), "rstart", "case_id", "draw")).otherwise(0)
    return rows.select("case_id", F.col("doc_id").alias("document_id"), "draw", lo.cast("int").alias("lo"), "w")


@R.add("OP7_reviewed_random_negatives", f"WITH {REVIEWED} SELECT * FROM reviewed_random")
def reviewed_random_negatives(t: Tables) -> DataFrame:
    points = materialise(sized_points(t))
    return reviewed_random(t, points, window_sizes(points))


SPANS = f"""{REVIEWED}, declined AS (SELECT * FROM pts WHERE status = 'declined' AND num_sents >= 1 AND case_id IS NOT NULL),
ds AS (SELECT case_id, document_id, idx_start lo, idx_end hi, 'positive' label, 'approved' source FROM ap UNION ALL SELECT case_id, document_id, idx_start, idx_end, 'negative', 'declined' FROM declined
UNION ALL SELECT case_id, document_id, lo, hi, 'negative', 'surrounding' FROM surrounding UNION ALL SELECT target_case, document_id, lo, hi, 'negative', 'topical' FROM topical
UNION ALL SELECT case_id, document_id, lo, hi, 'negative', 'doc_random' FROM doc_random UNION ALL SELECT case_id, document_id, lo, lo + w, 'negative', 'reviewed_random' FROM reviewed_random)"""


def span_dataset(t: Tables) -> DataFrame:
    """The union of the six families of spans."""
    points = materialise(sized_points(t))
    sizes, yes = materialise(window_sizes(points)), points.where("status = 'approved'")
    own = lambda d: d.select("case_id", "document_id", F.col("idx_start").alias("lo"), F.col("idx_end").alias("hi"))
    named = lambda d, label, source: d.select("case_id", "document_id", "lo", "hi", F.lit(label).alias("label"), F.lit(source).alias("source"))
    parts = [
        named(own(yes), "positive", "approved"),
        named(own(points.where("status = 'declined'")), "negative", "declined"),
        named(surrounding(yes, sizes), "negative", "surrounding"),
        named(topical(yes, t.cases).withColumnRenamed("target_case", "case_id"), "negative", "topical"),
        named(doc_random(yes, sizes), "negative", "doc_random"),
        named(reviewed_random(t, points, sizes).withColumn("hi", F.col("lo") + F.col("w")), "negative", "reviewed_random"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@R.add("OP8_span_dataset", f"""WITH {SPANS} SELECT x.case_id, x.document_id, x.lo, x.hi, x.label, x.source, a.sent_start char_start, CAST(coalesce(b.sent_start, length(d.text)) AS INTEGER) char_end
FROM ds x JOIN documents d ON d.doc_id = x.document_id JOIN sents a ON a.doc_id = x.document_id AND a.sent_idx = x.lo LEFT JOIN sents b ON b.doc_id = x.document_id AND b.sent_idx = x.hi""")
def span_dataset_query(t: Tables) -> DataFrame:
    arrays = t.starts().select(F.col("doc_id").alias("document_id"), "starts")
    sizes = t.documents.select(F.col("doc_id").alias("document_id"), F.length("text").alias("_n"))
    rows = span_dataset(t).join(arrays, "document_id").join(sizes, "document_id").withColumn("char_start", F.get("starts", F.col("lo"))).where("char_start IS NOT NULL")
    return rows.select("case_id", "document_id", "lo", "hi", "label", "source", "char_start", F.coalesce(F.get("starts", F.col("hi")), F.col("_n")).alias("char_end"))


DOCS = f"{CUR}, k AS (SELECT case_id, document_id, bool_or(status = 'approved') a, bool_or(status = 'declined') d FROM cur WHERE case_id IS NOT NULL AND document_id IS NOT NULL AND document_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2), doc_set AS (SELECT case_id, document_id, CASE WHEN a THEN 'positive' ELSE 'negative' END label, CASE WHEN a THEN 'approved' ELSE 'declined' END source FROM k WHERE a OR d)"


def doc_dataset(t: Tables) -> DataFrame:
    """One row per case and document with a decision; an approved point outweighs a declined one."""
    points = t.current_points(["id", "case_id", "document_id", "status"]).where("case_id IS NOT NULL AND document_id IS NOT NULL")
    live = t.documents.where("text IS NOT NULL").select(F.col("doc_id").alias("document_id"))
    k = points.join(live, "document_id", "left_semi").groupBy("case_id", "document_id").agg(F.bool_or(F.col("status") == "approved").alias("a"), F.bool_or(F.col("status") == "declined").alias("d")).where("a OR d")
    return k.select("case_id", "document_id", F.when(F.col("a"), "positive").otherwise("negative").alias("label"), F.when(F.col("a"), "approved").otherwise("declined").alias("source"))


@R.add("SMP11_group_sample", f"WITH {DOCS}, g AS (SELECT case_id, document_id FROM doc_set), d AS (SELECT document_id FROM (SELECT DISTINCT document_id FROM g) QUALIFY {rank_sql('', 'groups', 'document_id')} < 200) SELECT case_id, document_id FROM g WHERE document_id IN (SELECT document_id FROM d)")
def group_sample(t: Tables) -> DataFrame:
    """All rows of 200 drawn documents: groups are drawn, not rows."""
    groups = hash_rank(doc_dataset(t).select("document_id").distinct(), [], "groups", ["document_id"]).where("rank0 < 200").select("document_id")
    return doc_dataset(t).select("case_id", "document_id").join(groups, "document_id", "left_semi").select("case_id", "document_id")


@R.add("OP9_doc_dataset", f"WITH {DOCS} SELECT * FROM doc_set")
def doc_dataset_query(t: Tables) -> DataFrame:
    return doc_dataset(t)


@R.add("OP10_folds", f"""WITH {DOCS}, u AS (SELECT case_id, document_id FROM doc_set UNION SELECT case_id, document_id FROM sent_spans WHERE case_id IS NOT NULL AND document_id IS NOT NULL),
r AS (SELECT *, {rank_sql('case_id', 'folds', 'case_id', 'document_id')} k, count(*) OVER (PARTITION BY case_id) n FROM u)
SELECT case_id, document_id, CAST((k >= round_even(1.0 * (n / 5.0), 0))::INT + (k >= round_even(2.0 * (n / 5.0), 0))::INT + (k >= round_even(3.0 * (n / 5.0), 0))::INT + (k >= round_even(4.0 * (n / 5.0), 0))::INT AS INTEGER) fold FROM r""")
def folds(t: Tables) -> DataFrame:
    """A document has the same fold in both datasets, by case."""
    spans = t.sent_spans.where("case_id IS NOT NULL AND document_id IS NOT NULL").select("case_id", "document_id")
    docs = doc_dataset(t).select("case_id", "document_id").union(spans).distinct()
    return hash_rank(docs, ["case_id"], "folds", ["case_id", "document_id"]).select("case_id", "document_id", fold_of(F.col("rank0"), F.col("group_size"), 5).alias("fold"))
