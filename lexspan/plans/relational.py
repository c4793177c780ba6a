"""Scans, filters, projections, joins, aggregates, order and set operations over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.functions.text import blank_tags, blank_tags_sql, is_blank
from lexspan.operators.running import running_sums
from lexspan.plans.common import CUR, DELETED, SVC, Registry, Tables, deleted

R = Registry()
QUERIES, SQL = R.queries, R.sql
NAMES = ["documents", "services", "points", "cases", "topics", "sent_spans", "bot_records", "doc_labels"]


@R.add("SRC1_table_sizes", " UNION ALL ".join(f"SELECT '{n}' table_name, count(*) n FROM {n}" for n in NAMES))
def table_sizes(t: Tables) -> DataFrame:
    return reduce(DataFrame.unionByName, [getattr(t, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n in NAMES])


@R.add("SRC4_document_versions", "SELECT doc_id, text_version FROM documents WHERE doc_id IS NOT NULL")
def document_versions(t: Tables) -> DataFrame:
    return t.documents.where("doc_id IS NOT NULL").select("doc_id", "text_version")


@R.add("SRC5_lookup_documents", "SELECT d document_id, x.doc_id IS NOT NULL found, x.name FROM (SELECT DISTINCT document_id d FROM sent_spans WHERE document_id IS NOT NULL) LEFT JOIN documents x ON d = x.doc_id")
def lookup_documents(t: Tables) -> DataFrame:
    asked = t.sent_spans.where("document_id IS NOT NULL").select("document_id").distinct()
    docs = t.documents.select(F.col("doc_id").alias("_d"), "name")
    return asked.join(docs, asked.document_id == docs._d, "left").select("document_id", F.col("_d").isNotNull().alias("found"), "name")


@R.add("SRC6_points_of_a_case", f"WITH {CUR} SELECT id, status, document_id FROM cur WHERE case_id = (SELECT min(case_id) FROM points)")
def points_of_a_case(t: Tables) -> DataFrame:
    one = t.points.agg(F.min("case_id").alias("case_id"))
    return t.current_points(["id", "status", "document_id", "case_id"]).join(F.broadcast(one), "case_id", "left_semi").select("id", "status", "document_id")


@R.add("SRC7_visited_versions", "SELECT DISTINCT case_id, document_id, text_version FROM bot_records WHERE bot_version = (SELECT max(bot_version) FROM bot_records)")
def visited_versions(t: Tables) -> DataFrame:
    last = t.bot_records.agg(F.max("bot_version").alias("bot_version"))
    return t.bot_records.join(F.broadcast(last), "bot_version", "left_semi").select("case_id", "document_id", "text_version").distinct()


@R.add("SRC10_hosts", "SELECT DISTINCT lower(regexp_extract(url, '^(?:[a-z]+://)?(?:www\\.)?([^/:?#]+)', 1)) host FROM documents WHERE url IS NOT NULL AND regexp_extract(url, '^(?:[a-z]+://)?(?:www\\.)?([^/:?#]+)', 1) <> ''")
def hosts(t: Tables) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^(?:[a-z]+://)?(?:www\.)?([^/:?#]+)", 1))
    return t.documents.where("url IS NOT NULL").select(host.alias("host")).where("host <> ''").distinct()


@R.add("SRC11_cases_without_target", "SELECT id case_id FROM cases WHERE id NOT IN (SELECT case_id FROM keep_targets WHERE case_id IS NOT NULL)")
def cases_without_target(t: Tables) -> DataFrame:
    return t.cases.select(F.col("id").alias("case_id")).join(t.keep_targets.select("case_id"), "case_id", "left_anti")


@R.add("FLT1_english", "SELECT 'documents' table_name, doc_id id FROM documents WHERE lang = 'en' UNION ALL SELECT 'points', id FROM points WHERE lang = 'en'")
def english(t: Tables) -> DataFrame:
    docs = t.documents.where("lang = 'en'").select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("id"))
    return docs.unionByName(t.points.where("lang = 'en'").select(F.lit("points").alias("table_name"), "id"))


@R.add("FLT3_decided_points", f"WITH {CUR} SELECT id, case_id, status FROM cur WHERE status IN ('approved', 'declined')")
def decided_points(t: Tables) -> DataFrame:
    return t.current_points(["id", "case_id", "status"]).where(F.col("status").isin("approved", "declined"))


@R.add("FLT4_live_documents", f"SELECT doc_id, status FROM documents WHERE NOT {DELETED}")
def live_documents(t: Tables) -> DataFrame:
    return t.documents.where(~deleted()).select("doc_id", "status")


@R.add("FLT5_without_literal_keys", f"WITH {CUR} SELECT id FROM cur WHERE service_id IS DISTINCT FROM 17 AND case_id IS DISTINCT FROM 101")
def without_literal_keys(t: Tables) -> DataFrame:
    return t.current_points(["id", "service_id", "case_id"]).where(~F.col("service_id").eqNullSafe(17) & ~F.col("case_id").eqNullSafe(101)).select("id")


@R.add("FLT6_reviewed_with_points", f"""WITH {CUR}, {SVC}, n AS (SELECT document_id, count(*) num_points FROM cur GROUP BY 1)
SELECT d.doc_id, n.num_points FROM documents d JOIN svc s ON d.service_id = s.id JOIN n ON n.document_id = d.doc_id WHERE s.is_comprehensively_reviewed AND num_points >= 10""")
def reviewed_with_points(t: Tables) -> DataFrame:
    n = t.current_points(["id", "document_id"]).groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("num_points")).where("num_points >= 10")
    reviewed = t.services.where("is_comprehensively_reviewed").select(F.col("id").alias("service_id")).distinct()
    return t.documents.select("doc_id", "service_id").join(reviewed, "service_id", "left_semi").join(n, "doc_id").select("doc_id", "num_points")


@R.add("FLT7_cases_with_enough_approved", f"WITH {CUR} SELECT case_id, count(*) num_approved FROM cur WHERE status = 'approved' AND case_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 4")
def cases_with_enough_approved(t: Tables) -> DataFrame:
    return t.current_points(["id", "case_id", "status"]).where("status = 'approved' AND case_id IS NOT NULL").groupBy("case_id").agg(F.count(F.lit(1)).alias("num_approved")).where("num_approved >= 4")


@R.add("FLT8_null_counts", """SELECT count(*) FILTER (WHERE document_id IS NULL) null_document, count(*) FILTER (WHERE case_id IS NULL) null_case, count(*) FILTER (WHERE quote_text IS NULL) null_quote,
count(*) FILTER (WHERE ml_score IS NULL OR isnan(ml_score)) no_score, count(lang) with_lang FROM points""")
def null_counts(t: Tables) -> DataFrame:
    n = lambda c: F.count_if(F.col(c).isNull())
    return t.points.agg(n("document_id").alias("null_document"), n("case_id").alias("null_case"), n("quote_text").alias("null_quote"), F.count_if(F.col("ml_score").isNull() | F.isnan("ml_score")).alias("no_score"), F.count("lang").alias("with_lang"))


@R.add("FLT9_start_without_quote", f"WITH {CUR} SELECT id FROM cur WHERE quote_start IS NOT NULL AND nullif(quote_text, '') IS NULL")
def start_without_quote(t: Tables) -> DataFrame:
    return t.current_points(["id", "quote_start", "quote_text"]).where(F.col("quote_start").isNotNull() & F.nullif(F.col("quote_text"), F.lit("")).isNull()).select("id")


@R.add("FLT11_blank_texts", "SELECT doc_id FROM documents WHERE NOT coalesce(regexp_matches(" + blank_tags_sql("text") + ", '\\S'), false)")
def blank_texts(t: Tables) -> DataFrame:
    return t.documents.where(is_blank(blank_tags("text"))).select("doc_id")


@R.add("FLT13_scores_over_threshold", """WITH th AS (SELECT case_id, keep_permille / 1000.0 threshold FROM keep_targets)
SELECT b.case_id, b.document_id, b.text_version, b.bot_version, b.ml_score FROM bot_records b JOIN th USING (case_id) WHERE NOT isnan(b.ml_score) AND b.ml_score >= threshold""")
def scores_over_threshold(t: Tables) -> DataFrame:
    th = t.keep_targets.select("case_id", (F.col("keep_permille") / 1000.0).alias("threshold"))
    rows = t.bot_records.where("ml_score IS NOT NULL AND NOT isnan(ml_score)").join(F.broadcast(th), "case_id").where("ml_score >= threshold")
    return rows.select("case_id", "document_id", "text_version", "bot_version", "ml_score")


@R.add("FLT14_ordinary_lengths", f"WITH {CUR} SELECT id, quote_end - quote_start quote_len FROM cur WHERE quote_end - quote_start < 1000")
def ordinary_lengths(t: Tables) -> DataFrame:
    return t.current_points(["id", "quote_start", "quote_end"]).select("id", (F.col("quote_end") - F.col("quote_start")).alias("quote_len")).where("quote_len < 1000")


@R.add("FLT15_integrity", f"""WITH {CUR} SELECT 'quote after end' rule, count(*) violations FROM cur p JOIN documents d ON p.document_id = d.doc_id WHERE length(d.text) < p.quote_end
UNION ALL SELECT 'document twice', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(DISTINCT coalesce(text, '')) > 1)
UNION ALL SELECT 'case of no topic', count(*) FROM cases c WHERE topic_id IS NOT NULL AND topic_id NOT IN (SELECT id FROM topics WHERE id IS NOT NULL)
UNION ALL SELECT 'wrong length', count(*) FROM documents WHERE n_chars IS DISTINCT FROM length(text)""")
def integrity(t: Tables) -> DataFrame:
    docs, points = t.documents, t.current_points(["id", "document_id", "quote_end"]).where("quote_end IS NOT NULL")
    after = docs.select(F.col("doc_id").alias("document_id"), F.length("text").alias("_n")).join(points, "document_id").where("_n < quote_end")
    twice = docs.groupBy("doc_id").agg(F.count_distinct(F.coalesce("text", F.lit(""))).alias("_n")).where("_n > 1")
    stray = t.cases.where("topic_id IS NOT NULL").join(t.topics.select(F.col("id").alias("topic_id")), "topic_id", "left_anti")
    wrong = docs.where(~F.col("n_chars").eqNullSafe(F.length("text").cast("long")))
    rules = [("quote after end", after), ("document twice", twice), ("case of no topic", stray), ("wrong length", wrong)]
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(n).alias("rule"), "violations") for n, d in rules])


@R.add("FLT17_fold_split", "SELECT case_id, document_id, char_start, char_end, CASE WHEN fold = 0 THEN 'held out' ELSE 'train' END part FROM sent_spans WHERE fold IS NOT NULL")
def fold_split(t: Tables) -> DataFrame:
    return t.sent_spans.where("fold IS NOT NULL").select("case_id", "document_id", "char_start", "char_end", F.when(F.col("fold") == 0, "held out").otherwise("train").alias("part"))


@R.add("PRJ_points_derived", f"""WITH {CUR} SELECT id, quote_end - quote_start quote_len, nullif(quote_text, '') quote, CASE WHEN status = 'approved' THEN 1 ELSE 0 END label, CAST(document_id AS INTEGER) doc_int,
CASE WHEN document_id IS NULL THEN 'services/' || coalesce(CAST(service_id AS VARCHAR), '') ELSE 'documents/' || document_id END link, round_even(CASE WHEN isnan(ml_score) THEN NULL ELSE ml_score END, 3) score3 FROM cur""")
def points_derived(t: Tables) -> DataFrame:
    score = F.when(~F.isnan("ml_score"), F.col("ml_score"))
    link = F.when(F.col("document_id").isNull(), F.concat(F.lit("services/"), F.coalesce(F.col("service_id").cast("string"), F.lit("")))).otherwise(F.concat(F.lit("documents/"), F.col("document_id").cast("string")))
    return t.current_points().select("id", (F.col("quote_end") - F.col("quote_start")).alias("quote_len"), F.nullif(F.col("quote_text"), F.lit("")).alias("quote"), F.when(F.col("status") == "approved", 1).otherwise(0).alias("label"), F.col("document_id").cast("int").alias("doc_int"), link.alias("link"), F.bround(score, 3).alias("score3"))


@R.add("JN1_documents_services", f"WITH {SVC} SELECT d.doc_id, s.id service_id, s.name service_name, s.rating FROM documents d JOIN svc s ON d.service_id = s.id")
def documents_services(t: Tables) -> DataFrame:
    s = t.services.select(F.col("id").alias("service_id"), F.col("name").alias("service_name"), "rating", "url", "status", "is_comprehensively_reviewed", "created_at").distinct()
    return t.documents.select("doc_id", "service_id").join(s, "service_id").select("doc_id", "service_id", "service_name", "rating")


@R.add("JN2_points_cases", f"WITH {CUR} SELECT p.id, c.id case_id, c.title case_title, c.topic_id FROM cur p JOIN cases c ON p.case_id = c.id")
def points_cases(t: Tables) -> DataFrame:
    c = t.cases.select(F.col("id").alias("case_id"), F.col("title").alias("case_title"), "topic_id")
    return t.current_points(["id", "case_id"]).join(F.broadcast(c), "case_id").select("id", "case_id", "case_title", "topic_id")


@R.add("JN3_points_left_documents", f"WITH {CUR} SELECT p.id, p.document_id, d.source, d.n_chars FROM cur p LEFT JOIN documents d ON p.document_id = d.doc_id")
def points_left_documents(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("document_id"), "source", "n_chars")
    return t.current_points(["id", "document_id"]).join(d, "document_id", "left").select("id", "document_id", "source", "n_chars")


@R.add("JN5_cases_metrics_topics", f"""WITH {CUR}, m AS (SELECT case_id, count(*) n, count(*) FILTER (WHERE status = 'approved') approved FROM cur GROUP BY 1)
SELECT c.id case_id, c.title, t.title topic, m.n, m.approved FROM cases c JOIN m ON m.case_id = c.id JOIN topics t ON t.id = c.topic_id""")
def cases_metrics_topics(t: Tables) -> DataFrame:
    m = t.current_points(["id", "case_id", "status"]).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "approved").alias("approved"))
    topics = t.topics.select(F.col("id").alias("topic_id"), F.col("title").alias("topic"))
    return m.join(F.broadcast(t.cases.select(F.col("id").alias("case_id"), "title", "topic_id")), "case_id").join(F.broadcast(topics), "topic_id").select("case_id", "title", "topic", "n", "approved")


@R.add("JN6_document_counts", f"WITH {CUR}, n AS (SELECT document_id, count(*) num_points FROM cur WHERE document_id IS NOT NULL GROUP BY 1) SELECT doc_id, num_points FROM documents LEFT JOIN n ON document_id = doc_id")
def document_counts(t: Tables) -> DataFrame:
    n = t.current_points(["id", "document_id"]).where("document_id IS NOT NULL").groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("num_points"))
    return t.documents.select("doc_id").join(n, "doc_id", "left")


@R.add("JN7_documents_with_points", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT document_id FROM points WHERE document_id IS NOT NULL)")
def documents_with_points(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.points.select(F.col("document_id").alias("doc_id")), "doc_id", "left_semi")


@R.add("JN8_cases_of_same_topic", "SELECT a.id case_id, b.id other_id FROM cases a JOIN cases b ON a.topic_id = b.topic_id AND a.id <> b.id")
def cases_of_same_topic(t: Tables) -> DataFrame:
    a, b = t.cases.select(F.col("id").alias("case_id"), "topic_id"), t.cases.select(F.col("id").alias("other_id"), "topic_id")
    return a.join(F.broadcast(b), "topic_id").where("case_id <> other_id").select("case_id", "other_id")


@R.add("JN9_documents_without_case_points", "SELECT b.case_id, b.document_id FROM (SELECT DISTINCT case_id, document_id FROM bot_records WHERE case_id IS NOT NULL AND document_id IS NOT NULL) b WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.case_id = b.case_id AND p.document_id = b.document_id)")
def documents_without_case_points(t: Tables) -> DataFrame:
    pairs = t.bot_records.where("case_id IS NOT NULL AND document_id IS NOT NULL").select("case_id", "document_id").distinct()
    return pairs.join(t.points.select("case_id", "document_id"), ["case_id", "document_id"], "left_anti")


@R.add("JN10_points_of_live_parents", f"""WITH {CUR}, ds AS (SELECT DISTINCT id FROM services WHERE {DELETED}), dd AS (SELECT doc_id FROM documents WHERE {DELETED})
SELECT id FROM cur p WHERE NOT EXISTS (SELECT 1 FROM ds WHERE ds.id = p.service_id) AND NOT EXISTS (SELECT 1 FROM dd WHERE dd.doc_id = p.document_id)""")
def points_of_live_parents(t: Tables) -> DataFrame:
    points = t.current_points(["id", "service_id", "document_id"])
    points = points.join(t.services.where(deleted()).select(F.col("id").alias("service_id")), "service_id", "left_anti")
    return points.join(t.documents.where(deleted()).select(F.col("doc_id").alias("document_id")), "document_id", "left_anti").select("id")


@R.add("JN16_unvisited_versions", "SELECT DISTINCT d.doc_id, d.text_version FROM documents d WHERE NOT EXISTS (SELECT 1 FROM bot_records b WHERE b.document_id = d.doc_id AND b.text_version = d.text_version)")
def unvisited_versions(t: Tables) -> DataFrame:
    seen = t.bot_records.select(F.col("document_id").alias("doc_id"), "text_version")
    return t.documents.select("doc_id", "text_version").join(seen, ["doc_id", "text_version"], "left_anti").distinct()


@R.add("JN17_updated_scores", """WITH b AS (SELECT case_id, document_id, max(CASE WHEN isnan(ml_score) THEN NULL ELSE ml_score END) s FROM bot_records GROUP BY 1, 2)
SELECT id, round(coalesce(b.s, CASE WHEN isnan(p.ml_score) THEN NULL ELSE p.ml_score END), 6) score FROM points p LEFT JOIN b USING (case_id, document_id)""")
def updated_scores(t: Tables) -> DataFrame:
    new = t.bot_records.groupBy("case_id", "document_id").agg(F.max(F.when(~F.isnan("ml_score"), F.col("ml_score"))).alias("_s"))
    old = F.when(~F.isnan("ml_score"), F.col("ml_score"))
    return t.points.join(new, ["case_id", "document_id"], "left").select("id", F.round(F.coalesce("_s", old), 6).alias("score"))


@R.add("AG1_source_counts", "SELECT source, count(*) n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def source_counts(t: Tables) -> DataFrame:
    return t.documents.where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@R.add("AG2_span_sizes", "SELECT case_id, num_sents, count(*) n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY case_id), 6) share FROM sent_spans WHERE num_sents IS NOT NULL GROUP BY 1, 2")
def span_sizes(t: Tables) -> DataFrame:
    n = t.sent_spans.where("num_sents IS NOT NULL").groupBy("case_id", "num_sents").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("case_id")), 6))


@R.add("AG3_top_services", f"WITH {SVC} SELECT d.service_id, s.name, count(*) n FROM documents d JOIN svc s ON d.service_id = s.id GROUP BY 1, 2 ORDER BY n DESC, 1 LIMIT 15")
def top_services(t: Tables) -> DataFrame:
    n = t.documents.where("service_id IS NOT NULL").groupBy("service_id").agg(F.count(F.lit(1)).alias("n"))
    s = t.services.select(F.col("id").alias("service_id"), "name").distinct()
    return n.join(s, "service_id").orderBy(F.desc("n"), "service_id").limit(15).select("service_id", "name", "n")


@R.add("SRT2_bottom_cases", f"WITH {CUR} SELECT case_id, count(*) n FROM cur WHERE case_id IS NOT NULL GROUP BY 1 ORDER BY n, 1 LIMIT 10")
def bottom_cases(t: Tables) -> DataFrame:
    return t.current_points(["id", "case_id"]).where("case_id IS NOT NULL").groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "case_id").limit(10)


@R.add("SRT1_common_names", "SELECT lower(trim(name)) doc_name, count(*) n FROM documents WHERE name IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 25")
def common_names(t: Tables) -> DataFrame:
    return t.documents.where("name IS NOT NULL").groupBy(F.lower(F.trim("name")).alias("doc_name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "doc_name").limit(25)


@R.add("SRT1_shortest_quotes", f"WITH {CUR} SELECT id, quote_text, quote_end - quote_start quote_len FROM cur WHERE status = 'approved' AND quote_end - quote_start IS NOT NULL ORDER BY 3, 1 LIMIT 30")
def shortest_quotes(t: Tables) -> DataFrame:
    rows = t.current_points(["id", "status", "quote_text", "quote_start", "quote_end"]).where("status = 'approved'")
    return rows.select("id", "quote_text", (F.col("quote_end") - F.col("quote_start")).alias("quote_len")).where("quote_len IS NOT NULL").orderBy("quote_len", "id").limit(30)


@R.add("AG5_span_size_shares", """SELECT case_id, round(avg(num_sents), 6) mean_sents, round(avg(CASE WHEN num_sents > 1 THEN 1.0 ELSE 0.0 END), 6) over1, round(avg(CASE WHEN num_sents > 3 THEN 1.0 ELSE 0.0 END), 6) over3,
round(avg(CASE WHEN num_sents > 5 THEN 1.0 ELSE 0.0 END), 6) over5 FROM sent_spans WHERE num_sents IS NOT NULL GROUP BY 1""")
def span_size_shares(t: Tables) -> DataFrame:
    over = lambda n: F.round(F.avg((F.col("num_sents") > n).cast("double")), 6).alias(f"over{n}")
    return t.sent_spans.where("num_sents IS NOT NULL").groupBy("case_id").agg(F.round(F.avg("num_sents"), 6).alias("mean_sents"), over(1), over(3), over(5))


@R.add("AG6_topic_scores_having", "SELECT t.title topic, count(*) n, round(avg(c.score), 6) mean_score FROM cases c JOIN topics t ON c.topic_id = t.id GROUP BY 1 HAVING count(*) > 1")
def topic_scores_having(t: Tables) -> DataFrame:
    topics = t.topics.select(F.col("id").alias("topic_id"), F.col("title").alias("topic"))
    return t.cases.join(F.broadcast(topics), "topic_id").groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score")).where("n > 1")


DESCRIBE = "count({0}) n, round(avg({0}), 4) mean, round(stddev_samp({0}), 4) std, min({0}) least, round(quantile_cont({0}, 0.25), 4) q25, round(quantile_cont({0}, 0.5), 4) q50, round(quantile_cont({0}, 0.75), 4) q75, max({0}) most"


def describe(c: str) -> list[F.Column]:
    """Count, mean, sample deviation, least, exact quartiles and greatest."""
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"), F.min(c).alias("least"), *(F.round(q[i], 4).alias(f"q{n}") for i, n in enumerate((25, 50, 75))), F.max(c).alias("most")]


@R.add("AG7_describe_lengths", f"SELECT source, {DESCRIBE.format('n_chars')} FROM documents GROUP BY 1")
def describe_lengths(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(*describe("n_chars"))


@R.add("AG8_describe_counts", f"WITH k AS (SELECT service_id, count(*) docs FROM documents WHERE service_id IS NOT NULL GROUP BY 1) SELECT {DESCRIBE.format('docs')} FROM k")
def describe_counts(t: Tables) -> DataFrame:
    return t.documents.where("service_id IS NOT NULL").groupBy("service_id").agg(F.count(F.lit(1)).alias("docs")).agg(*describe("docs"))


@R.add("AG9_distinct_keys", "SELECT count(DISTINCT service_id) services, count(DISTINCT document_id) documents, count(DISTINCT case_id) cases, count(DISTINCT (case_id, document_id)) pairs FROM points WHERE case_id IS NOT NULL AND document_id IS NOT NULL")
def distinct_keys(t: Tables) -> DataFrame:
    rows = t.points.where("case_id IS NOT NULL AND document_id IS NOT NULL")
    return rows.agg(F.count_distinct("service_id").alias("services"), F.count_distinct("document_id").alias("documents"), F.count_distinct("case_id").alias("cases"), F.count_distinct("case_id", "document_id").alias("pairs"))


@R.add("AG10_count_if", "SELECT count(*) FILTER (WHERE num_sents > 1) over1, count(*) FILTER (WHERE label = 'positive') positives FROM sent_spans")
def count_if(t: Tables) -> DataFrame:
    return t.sent_spans.agg(F.count_if(F.col("num_sents") > 1).alias("over1"), F.count_if(F.col("label") == "positive").alias("positives"))


@R.add("AG12_status_totals", f"WITH {CUR} SELECT case_id, status, count(*) n, grouping(case_id) + grouping(status) depth FROM cur GROUP BY ROLLUP (case_id, status)")
def status_totals(t: Tables) -> DataFrame:
    return t.current_points(["id", "case_id", "status"]).rollup("case_id", "status").agg(F.count(F.lit(1)).alias("n"), (F.grouping("case_id") + F.grouping("status")).alias("depth"))


@R.add("AG13_mean_or_zero", "SELECT c.id case_id, round(coalesce(avg(CASE WHEN isnan(b.ml_score) THEN NULL ELSE b.ml_score END), 0.0), 6) mean_score FROM cases c LEFT JOIN bot_records b ON b.case_id = c.id GROUP BY 1")
def mean_or_zero(t: Tables) -> DataFrame:
    m = t.bot_records.groupBy("case_id").agg(F.avg(F.when(~F.isnan("ml_score"), F.col("ml_score"))).alias("_m"))
    return t.cases.select(F.col("id").alias("case_id")).join(m, "case_id", "left").select("case_id", F.round(F.coalesce("_m", F.lit(0.0)), 6).alias("mean_score"))


@R.add("AG17_other_statuses", f"WITH {CUR} SELECT document_id, bool_or(status NOT IN ('declined', 'draft')) has_other FROM cur WHERE document_id IS NOT NULL AND status IS NOT NULL GROUP BY 1")
def other_statuses(t: Tables) -> DataFrame:
    return t.current_points(["id", "document_id", "status"]).where("document_id IS NOT NULL AND status IS NOT NULL").groupBy("document_id").agg(F.bool_or(~F.col("status").isin("declined", "draft")).alias("has_other"))


@R.add("SET2_document_ids", "SELECT document_id FROM points WHERE document_id IS NOT NULL UNION SELECT document_id FROM sent_spans WHERE document_id IS NOT NULL")
def document_ids(t: Tables) -> DataFrame:
    ids = [x.where("document_id IS NOT NULL").select("document_id") for x in (t.points, t.sent_spans)]
    return ids[0].union(ids[1]).distinct()


@R.add("SET3_declined_only", f"WITH {CUR} SELECT DISTINCT document_id FROM cur WHERE status = 'declined' AND document_id IS NOT NULL EXCEPT SELECT document_id FROM cur WHERE status = 'approved'")
def declined_only(t: Tables) -> DataFrame:
    points = t.current_points(["id", "document_id", "status"]).where("document_id IS NOT NULL")
    return points.where("status = 'declined'").select("document_id").subtract(points.where("status = 'approved'").select("document_id"))


@R.add("SET4_merged_options", """WITH l(k, v) AS (VALUES ('weight', '1:1'), ('rebalance', 'none'), ('folds', '5')), r AS (SELECT id case_id, 'weight' k, classification v FROM cases WHERE classification IS NOT NULL UNION ALL SELECT id, 'title', title FROM cases WHERE title IS NOT NULL)
SELECT c.id case_id, l.k, coalesce(r.v, l.v) v FROM cases c CROSS JOIN l LEFT JOIN r ON r.case_id = c.id AND r.k = l.k UNION ALL SELECT case_id, k, v FROM r WHERE k NOT IN (SELECT k FROM l)""")
def merged_options(t: Tables) -> DataFrame:
    """Two maps of options in one: where both have a key the right one's value holds, unless it is null."""
    left = F.create_map(*[F.lit(x) for x in ("weight", "1:1", "rebalance", "none", "folds", "5")])
    right = F.create_map(F.lit("weight"), "classification", F.lit("title"), "title")
    merged = F.map_zip_with(left, right, lambda k, a, b: F.coalesce(b, a))
    return t.cases.select(F.col("id").alias("case_id"), F.explode(merged).alias("k", "v")).where("v IS NOT NULL")


@R.add("SRT6_first_documents", "SELECT doc_id, service_id, lang FROM documents ORDER BY doc_id LIMIT 200")
def first_documents(t: Tables) -> DataFrame:
    """The 200 documents of the least ids: the limit is what a trial run asks for."""
    return t.documents.select("doc_id", "service_id", "lang").orderBy("doc_id").limit(200)


@R.add("STR8_regex_capture", "SELECT id case_id, regexp_extract(bot_regex, 'b([a-z]+)', 1) word FROM cases WHERE nullif(trim(bot_regex), '') IS NOT NULL")
def regex_capture(t: Tables) -> DataFrame:
    return t.cases.where(F.nullif(F.trim("bot_regex"), F.lit("")).isNotNull()).select(F.col("id").alias("case_id"), F.regexp_extract("bot_regex", "b([a-z]+)", 1).alias("word"))


@R.add("STR9_prefix_and_digits", "SELECT doc_id, starts_with(url, 'https') secure, regexp_matches(text_version, '^[0-9]+$') numbered, split_part(url, '/', 3) host FROM documents")
def prefix_and_digits(t: Tables) -> DataFrame:
    host = F.when(F.col("url").isNotNull(), F.coalesce(F.get(F.split("url", "/"), 2), F.lit("")))
    return t.documents.select("doc_id", F.startswith(F.col("url"), F.lit("https")).alias("secure"), F.col("text_version").rlike("^[0-9]+$").alias("numbered"), host.alias("host"))


@R.add("JSN1_event_properties", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) k FROM events")
def event_properties(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@R.add("DT1_run_keys", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) run_key FROM events")
def run_keys(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.unix_timestamp("ts").alias("run_key"))


@R.add("WN11_points_over_time", f"WITH {CUR}, c AS (SELECT status, created_at, count(*) k FROM cur GROUP BY 1, 2) SELECT status, created_at, CAST(sum(k) OVER (PARTITION BY status ORDER BY created_at NULLS FIRST) AS BIGINT) n FROM c")
def points_over_time(t: Tables) -> DataFrame:
    """How many points of each status there are by each time at which one came."""
    per = t.current_points(["id", "status", "created_at"]).groupBy("status", "created_at").agg(F.count(F.lit(1)).alias("k"))
    return running_sums(per, ["status"], [F.asc_nulls_first("created_at")], F.date_trunc("day", "created_at"), False, {"k": "n"}).select("status", "created_at", "n")


@R.add("WN12_length_histogram", "SELECT source, CAST(floor(n_chars / 250) AS BIGINT) bin, count(*) n FROM documents WHERE n_chars IS NOT NULL GROUP BY 1, 2")
def length_histogram(t: Tables) -> DataFrame:
    return t.documents.where("n_chars IS NOT NULL").groupBy("source", F.floor(F.col("n_chars") / 250).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
