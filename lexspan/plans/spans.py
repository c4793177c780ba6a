"""Sentences, quotes and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.functions.text import SENTENCE, blank_tags, blank_tags_sql, part
from lexspan.operators.spans import bisect_right, boundary_arrays, overlapping, relocate_quotes, sentences, stretch
from lexspan.plans.common import CUR, DELETED, Registry, Tables, deleted

R = Registry()
QUERIES, SQL = R.queries, R.sql

PIECES = SENTENCE.replace("'", "''")
SENTS = f"""bt AS (SELECT doc_id, length(text) n, {blank_tags_sql('text')} t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
pc AS (SELECT doc_id, n, unnest(l) piece, generate_subscripts(l, 1) k FROM (SELECT doc_id, n, regexp_extract_all(t, '{PIECES}') l FROM bt)),
st AS (SELECT doc_id, n, k, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) s FROM pc),
sents AS (SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) sent_idx, CAST(s AS INTEGER) sent_start, CAST(coalesce(lead(s) OVER w, n) AS INTEGER) sent_end FROM st WHERE regexp_matches(piece, '\\S') WINDOW w AS (PARTITION BY doc_id ORDER BY k))"""
STRETCH = f"""{CUR}, {SENTS},
sp AS (SELECT p.id, p.case_id, p.document_id, p.service_id, p.status, p.quote_start, p.quote_end, CAST(CASE WHEN count(s.sent_idx) > 0 THEN greatest(count(*) FILTER (WHERE s.sent_start <= p.quote_start) - 1, 0) END AS INTEGER) idx_start,
  CAST(CASE WHEN count(s.sent_idx) > 0 THEN count(*) FILTER (WHERE s.sent_start < p.quote_end) END AS INTEGER) idx_end, CAST(nullif(count(s.sent_idx), 0) AS INTEGER) num_doc_sents,
  CAST(CASE WHEN count(s.sent_idx) > 0 THEN count(*) FILTER (WHERE s.sent_start <= p.quote_end) - count(*) FILTER (WHERE s.sent_start <= p.quote_start) + 1 END AS INTEGER) num_alt
  FROM cur p LEFT JOIN sents s ON s.doc_id = p.document_id WHERE p.quote_start IS NOT NULL AND p.quote_end IS NOT NULL GROUP BY ALL),
pts AS (SELECT *, idx_end - idx_start num_sents FROM sp)"""


def stretched(t: Tables) -> DataFrame:
    """The current points with a quote, stretched to sentences."""
    points = t.current_points(["id", "case_id", "document_id", "service_id", "status", "quote_start", "quote_end"]).where("quote_start IS NOT NULL AND quote_end IS NOT NULL")
    return stretch(points, t.starts())


@R.add("STR1_blank_tags", f"SELECT doc_id, {blank_tags_sql('text')} blanked, length({blank_tags_sql('text')}) = length(text) same_length FROM documents")
def blank_tags_query(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", blank_tags("text").alias("blanked"), F.length("text").alias("_n")).select("doc_id", "blanked", (F.length("blanked") == F.col("_n")).alias("same_length"))


@R.add("STR11_sentences", f"WITH {SENTS} SELECT * FROM sents")
def sentences_query(t: Tables) -> DataFrame:
    return sentences(t.documents)


@R.add("AG11_sentence_arrays", f"WITH {SENTS} SELECT doc_id, list(sent_start ORDER BY sent_start) starts FROM sents GROUP BY 1")
def sentence_arrays(t: Tables) -> DataFrame:
    return boundary_arrays(sentences(t.documents))


@R.add("OP2_stretch_points", f"WITH {STRETCH} SELECT id, idx_start, idx_end, num_sents, num_doc_sents FROM pts")
def stretch_points(t: Tables) -> DataFrame:
    return stretched(t).select("id", "idx_start", "idx_end", "num_sents", "num_doc_sents")


@R.add("JN14_sentence_counts_alt", f"WITH {STRETCH} SELECT id, num_alt FROM pts")
def sentence_counts_alt(t: Tables) -> DataFrame:
    alt = 1 + bisect_right(F.col("starts"), F.col("quote_end")) - bisect_right(F.col("starts"), F.col("quote_start"))
    return stretched(t).select("id", F.when(F.col("starts").isNotNull(), alt).alias("num_alt"))


@R.add("ARR2_span_texts", f"""WITH {STRETCH} SELECT p.id, a.sent_start char_start, CAST(coalesce(b.sent_start, length(d.text)) AS INTEGER) char_end, substr(d.text, a.sent_start + 1, coalesce(b.sent_start, length(d.text)) - a.sent_start) span_text
FROM pts p JOIN documents d ON d.doc_id = p.document_id JOIN sents a ON a.doc_id = p.document_id AND a.sent_idx = p.idx_start LEFT JOIN sents b ON b.doc_id = p.document_id AND b.sent_idx = p.idx_end WHERE p.num_sents >= 1""")
def span_texts(t: Tables) -> DataFrame:
    rows = stretched(t).where("num_sents >= 1").select("id", "document_id", F.get("starts", F.col("idx_start")).alias("char_start"), F.get("starts", F.col("idx_end")).alias("_e"))
    rows = rows.where("char_start IS NOT NULL").join(t.documents.select(F.col("doc_id").alias("document_id"), "text"), "document_id")
    return rows.select("id", "char_start", F.coalesce("_e", F.length("text")).alias("char_end"), part("text", "char_start", "_e").alias("span_text"))


QUOTES = f"""{CUR}, q AS (SELECT p.id, p.document_id, p.case_id, p.service_id, p.status, p.quote_start, p.quote_end, nullif(p.quote_text, '') quote, d.text FROM cur p LEFT JOIN documents d ON p.document_id = d.doc_id WHERE p.quote_start IS NOT NULL AND p.quote_end IS NOT NULL),
m AS (SELECT *, coalesce(substr(text, quote_start + 1, quote_end - quote_start) = quote, false) matches_before, CAST(coalesce((length(text) - length(replace(text, quote, ''))) / length(quote), 0) AS INTEGER) n_matches FROM q),
r AS (SELECT *, CASE WHEN NOT matches_before AND n_matches = 1 THEN strpos(text, quote) - 1 ELSE quote_start END new_start, CASE WHEN NOT matches_before AND n_matches = 1 THEN strpos(text, quote) - 1 + length(quote) ELSE quote_end END new_end FROM m),
moved AS (SELECT *, coalesce(substr(text, new_start + 1, new_end - new_start) = quote, false) matches_after FROM r)"""


def quotes(t: Tables) -> DataFrame:
    points = t.current_points(["id", "document_id", "case_id", "service_id", "status", "quote_text", "quote_start", "quote_end"]).where("quote_start IS NOT NULL AND quote_end IS NOT NULL")
    return relocate_quotes(points, t.documents)


@R.add("STR5_relocated_quotes", f"WITH {QUOTES} SELECT id, matches_before, n_matches, CAST(new_start AS INTEGER) new_start, CAST(new_end AS INTEGER) new_end, matches_after FROM moved")
def relocated_quotes(t: Tables) -> DataFrame:
    return quotes(t).select("id", "matches_before", "n_matches", "new_start", "new_end", "matches_after")


@R.add("OP33_quote_audit", f"WITH {QUOTES} SELECT status, count(*) n, count(*) FILTER (WHERE NOT matches_before) wrong_before, count(*) FILTER (WHERE NOT matches_after) wrong_after FROM moved GROUP BY 1")
def quote_audit(t: Tables) -> DataFrame:
    return quotes(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("matches_before")).alias("wrong_before"), F.count_if(~F.col("matches_after")).alias("wrong_after"))


@R.add("OP1_clean_points", f"""WITH {CUR}, {QUOTES.replace(CUR + ', ', '')}, ds AS (SELECT DISTINCT id FROM services WHERE {DELETED}),
docs AS (SELECT doc_id, service_id, text FROM documents WHERE NOT {DELETED} AND NOT EXISTS (SELECT 1 FROM ds WHERE ds.id = service_id)),
gone AS (SELECT doc_id FROM documents WHERE {DELETED} OR EXISTS (SELECT 1 FROM ds WHERE ds.id = service_id)),
bare AS (SELECT id FROM services WHERE id NOT IN (SELECT service_id FROM docs WHERE service_id IS NOT NULL)),
textless AS (SELECT doc_id FROM docs WHERE nullif(text, '') IS NULL)
SELECT p.id, coalesce(CAST(m.new_start AS INTEGER), p.quote_start) quote_start, coalesce(CAST(m.new_end AS INTEGER), p.quote_end) quote_end FROM cur p LEFT JOIN moved m ON m.id = p.id
WHERE p.status IN ('approved', 'declined') AND NOT EXISTS (SELECT 1 FROM ds WHERE ds.id = p.service_id) AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = p.document_id)
AND NOT EXISTS (SELECT 1 FROM bare WHERE bare.id = p.service_id) AND NOT EXISTS (SELECT 1 FROM textless x WHERE x.doc_id = p.document_id)
AND NOT (p.quote_start IS NOT NULL AND nullif(p.quote_text, '') IS NULL) AND (p.quote_start IS NULL OR m.matches_after)""")
def clean_points(t: Tables) -> DataFrame:
    """Points of live services and documents with text, decided, whose quote is where it says or can be moved there."""
    gone_services = t.services.where(deleted()).select(F.col("id").alias("service_id")).distinct()
    docs = t.documents.select("doc_id", "service_id", "status", "text")
    live = docs.where(~deleted()).join(gone_services, "service_id", "left_anti")
    gone = docs.select("doc_id").join(live.select("doc_id"), "doc_id", "left_anti")
    bare = t.services.select(F.col("id").alias("service_id")).join(live.select("service_id"), "service_id", "left_anti")
    textless = live.where(F.nullif("text", F.lit("")).isNull()).select("doc_id")
    points = t.current_points(["id", "document_id", "service_id", "case_id", "status", "quote_text", "quote_start", "quote_end"]).where(F.col("status").isin("approved", "declined"))
    points = points.join(gone_services, "service_id", "left_anti").join(bare, "service_id", "left_anti")
    points = points.join(gone.union(textless).withColumnRenamed("doc_id", "document_id"), "document_id", "left_anti")
    points = points.where(~(F.col("quote_start").isNotNull() & F.nullif("quote_text", F.lit("")).isNull()))
    kept = points.where("quote_start IS NULL").select("id", "quote_start", "quote_end")
    placed = relocate_quotes(points.where("quote_start IS NOT NULL"), live).where("matches_after").select("id", F.col("new_start").alias("quote_start"), F.col("new_end").alias("quote_end"))
    return kept.unionByName(placed)


@R.add("JN11_topical_spans", """WITH a AS (SELECT DISTINCT case_id, document_id, sent_idx_start lo, sent_idx_end hi FROM sent_spans WHERE source = 'approved' AND document_id IS NOT NULL),
x AS (SELECT c.id target_case, a.* FROM a JOIN cases o ON o.id = a.case_id JOIN cases c ON c.topic_id = o.topic_id AND c.id <> o.id)
SELECT target_case, case_id, document_id, lo, hi FROM x WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.case_id = x.target_case AND a.document_id = x.document_id AND a.lo <= x.hi - 1 AND x.lo <= a.hi - 1)""")
def topical_spans(t: Tables) -> DataFrame:
    spans = t.sent_spans.where("source = 'approved' AND document_id IS NOT NULL").select("case_id", "document_id", F.col("sent_idx_start").alias("lo"), F.col("sent_idx_end").alias("hi")).distinct()
    cases = t.cases.select(F.col("id").alias("case_id"), "topic_id")
    targets = F.broadcast(t.cases.select(F.col("id").alias("target_case"), "topic_id"))
    topical = spans.join(F.broadcast(cases), "case_id").join(targets, "topic_id").where("target_case <> case_id")
    own = spans.select(F.col("case_id").alias("target_case"), "document_id", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return overlapping(topical, own, ["target_case", "document_id"], "left_anti").select("target_case", "case_id", "document_id", "lo", "hi")


@R.add("JN12_cases_of_sentences", f"WITH {CUR}, {SENTS} SELECT s.doc_id, s.sent_idx, list(p.case_id ORDER BY p.case_id) cases FROM sents s JOIN cur p ON p.document_id = s.doc_id AND p.quote_start < s.sent_end AND p.quote_end > s.sent_start WHERE p.case_id IS NOT NULL GROUP BY 1, 2")
def cases_of_sentences(t: Tables) -> DataFrame:
    points = t.current_points(["id", "document_id", "case_id", "quote_start", "quote_end"]).where("case_id IS NOT NULL AND quote_start IS NOT NULL AND quote_end IS NOT NULL")
    right = points.select(F.col("document_id").alias("doc_id"), "case_id", F.col("quote_start").alias("lo2"), F.col("quote_end").alias("hi2"))
    rows = overlapping(sentences(t.documents).withColumnsRenamed({"sent_start": "lo", "sent_end": "hi"}), right, ["doc_id"])
    return rows.groupBy("doc_id", "sent_idx").agg(F.sort_array(F.collect_list("case_id")).alias("cases"))


@R.add("JN13_masked_sentences", f"""WITH {CUR}, {SENTS}, off AS (SELECT case_id, document_id, quote_start lo, quote_end hi FROM cur WHERE status = 'declined' AND quote_start IS NOT NULL AND document_id IS NOT NULL AND case_id IS NOT NULL)
SELECT o.case_id, s.doc_id, s.sent_idx, bool_or(o.lo < s.sent_end AND (o.hi IS NULL OR o.hi > s.sent_start)) masked FROM off o JOIN sents s ON s.doc_id = o.document_id GROUP BY 1, 2, 3""")
def masked_sentences(t: Tables) -> DataFrame:
    off = t.current_points(["id", "case_id", "document_id", "status", "quote_start", "quote_end"]).where("status = 'declined' AND quote_start IS NOT NULL AND document_id IS NOT NULL AND case_id IS NOT NULL")
    off = off.groupBy("case_id", F.col("document_id").alias("doc_id")).agg(F.collect_set(F.struct(F.col("quote_start").alias("lo"), F.col("quote_end").alias("hi"))).alias("off"))
    rows = sentences(t.documents).join(off, "doc_id")
    hit = F.exists("off", lambda o: (o["lo"] < F.col("sent_end")) & (o["hi"].isNull() | (o["hi"] > F.col("sent_start"))))
    return rows.select("case_id", "doc_id", "sent_idx", hit.alias("masked"))


@R.add("JN15_without_offlimits", f"""WITH {CUR}, {SENTS}, c AS (SELECT s.doc_id, s.sent_idx, list(DISTINCT p.case_id) cs FROM sents s JOIN cur p ON p.document_id = s.doc_id AND p.quote_start < s.sent_end AND p.quote_end > s.sent_start WHERE p.case_id IS NOT NULL GROUP BY 1, 2)
SELECT s.doc_id, s.sent_idx FROM sents s LEFT JOIN c USING (doc_id, sent_idx) WHERE NOT coalesce(list_contains(c.cs, 101), false)""")
def without_offlimits(t: Tables) -> DataFrame:
    listed = cases_of_sentences(t)
    return sentences(t.documents).join(listed, ["doc_id", "sent_idx"], "left").where(~F.coalesce(F.array_contains("cases", 101), F.lit(False))).select("doc_id", "sent_idx")


@R.add("ARR3_free_starts", f"""WITH {STRETCH}, n AS (SELECT case_id, document_id, num_doc_sents n, list(struct_pack(lo := idx_start, hi := idx_end)) r FROM pts WHERE status = 'approved' AND num_doc_sents > 0 AND case_id IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT case_id, document_id, r, unnest(range(0, n)) s FROM n)
SELECT case_id, document_id, count(*) FILTER (WHERE len(list_filter(r, lambda o: s >= o.lo - 2 AND s < o.hi)) = 0) free FROM x GROUP BY 1, 2""")
def free_starts(t: Tables) -> DataFrame:
    """Starts of windows of two sentences that touch no approved span, per case and document."""
    rows = stretched(t).where("status = 'approved' AND num_doc_sents > 0 AND case_id IS NOT NULL").groupBy("case_id", "document_id", "num_doc_sents").agg(F.collect_set(F.struct(F.col("idx_start").alias("lo"), F.col("idx_end").alias("hi"))).alias("r"))
    free = F.filter(F.sequence(F.lit(0), F.col("num_doc_sents") - 1), lambda s: ~F.exists("r", lambda o: (s >= o["lo"] - 2) & (s < o["hi"])))
    return rows.select("case_id", "document_id", F.size(free).cast("long").alias("free"))


@R.add("WN8_run_to_block", f"""WITH {SENTS}, b AS (SELECT doc_id, sent_idx, sent_idx - 3 off, sent_end - sent_start > 150 blocked FROM sents WHERE sent_idx > 3),
f AS (SELECT *, max(CASE WHEN blocked THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY off) blk FROM b WHERE off <= 5) SELECT doc_id, count(*) run FROM f WHERE blk = 0 GROUP BY 1""")
def run_to_block(t: Tables) -> DataFrame:
    """How many sentences follow the fourth one, five at most, before one over 150 characters."""
    rows = sentences(t.documents).where("sent_idx > 3 AND sent_idx <= 8").withColumn("_b", (F.col("sent_end") - F.col("sent_start") > 150).cast("int"))
    blk = F.max("_b").over(W.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_k", blk).where("_k = 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("run"))
