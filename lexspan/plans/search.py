"""Span search, incremental runs over unvisited document versions, corrections and reviews."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexspan.functions.draws import integer_below, integer_below_sql, uniform, uniform_sql
from lexspan.functions.text import blank_tags, is_blank
from lexspan.operators.running import running_sums
from lexspan.operators.search import prefilter, span_search
from lexspan.operators.spans import sentences
from lexspan.plans.common import CUR, Registry, Tables
from lexspan.plans.spans import SENTS
from lexspan.sources.tables import stored

R = Registry()
QUERIES, SQL = R.queries, R.sql

#: The stand-in for a trained model: a score from 0 to 1 in steps of 1/96 that depends on the span alone, with many ties.
LEVELS = 97


def scorer(lo: F.Column, hi: F.Column) -> F.Column:
    return integer_below(F.lit(LEVELS), "score", "doc_id", lo, hi) / F.lit(LEVELS - 1.0)


def scorer_sql(lo: str, hi: str) -> str:
    return f"({integer_below_sql(str(LEVELS), 'score', 'doc_id', lo, hi)} / {LEVELS - 1}.0)"


#: The prefilter's logistic model: its intercept, its scale and its coefficients over tf-idf weights, as a training run would leave them.
INTERCEPT, SCALE, LEAST_SCORE = -1.5, 10.0, 0.5
COEFFICIENTS = {"data": 0.9, "personal": 1.2, "privacy": 0.8, "cookies": 1.1, "delete": 1.3, "third": 0.7, "partners": 0.6, "advertisers": 1.4, "account": 0.4, "suspend": 1.2, "licence": 1.5, "content": 0.5, "liability": 1.3, "dispute": 1.2, "disputes": 1.1, "refunds": 0.9, "notice": 0.6, "records": 0.3, "sell": 1.4, "copy": 0.4, "terms": -0.2, "we": 0.1, "the": -0.1, "version": -0.8}
_VALUES = ", ".join(f"('{k}', {v})" for k, v in COEFFICIENTS.items())

#: df and idf of the model's terms over the English documents, as in OP14; terms out of its bounds weigh nothing.
PRE = f"""{SENTS}, model(term, coef) AS (VALUES {_VALUES}), en AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term FROM documents WHERE lang = 'en' AND text IS NOT NULL),
en_n AS (SELECT count(*) n FROM documents WHERE lang = 'en' AND text IS NOT NULL), idf AS (SELECT term, any_value(coef) coef, ln((any_value(n) + 1) / (count(*) + 1)) + 1 idf FROM en JOIN model USING (term), en_n GROUP BY 1 HAVING count(*) >= 4 AND count(*) <= 0.8 * any_value(n)),
wd AS (SELECT doc_id, k, regexp_extract_all(lower(piece), '[a-z0-9]+') w FROM pc), tf AS (SELECT doc_id, k, term, count(*) tf FROM (SELECT doc_id, k, unnest(w) term FROM wd) GROUP BY 1, 2, 3),
z AS (SELECT doc_id, k, sum(coef * idf * sqrt(tf)) z FROM tf JOIN idf USING (term) GROUP BY 1, 2),
ix AS (SELECT doc_id, k, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) sent_idx FROM st WHERE regexp_matches(piece, '\\S')),
pf0 AS (SELECT s.*, round(1 / (1 + exp(-({INTERCEPT} + {SCALE} * coalesce(z.z, 0) / greatest(len(wd.w), 1)))), 6) p FROM sents s JOIN ix USING (doc_id, sent_idx) JOIN wd USING (doc_id, k) LEFT JOIN z USING (doc_id, k)),
pf1 AS (SELECT *, p < {LEAST_SCORE} AND row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, sent_idx) > 1 masked FROM pf0),
pf AS (SELECT doc_id, sent_idx, sent_start, sent_end, masked, round(avg(masked::INT) OVER (PARTITION BY doc_id), 6) filter_rate FROM pf1)"""


def model_terms(t: Tables) -> DataFrame:
    """(term, weight): the model's coefficients times the terms' inverse frequency over the English documents; at most as many rows as coefficients."""
    docs = t.documents.where("lang = 'en' AND text IS NOT NULL")
    used = docs.select(F.explode(F.array_distinct(model_words(F.col("text")))).alias("term"))
    n = F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))
    coefficients = t.spark.createDataFrame(list(COEFFICIENTS.items()), "term string, coef double")
    df = used.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(n).where((F.col("df") >= 4) & (F.col("df") <= 0.8 * F.col("n")))
    return df.join(F.broadcast(coefficients), "term").select("term", (F.col("coef") * (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("weight"))


def all_words(text: F.Column) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def model_words(text: F.Column) -> F.Column:
    """The words of a text that the model knows, in order."""
    return F.filter(all_words(text), lambda w: w.isin(*COEFFICIENTS))


def _is(term: str) -> Callable[[F.Column], F.Column]:
    return lambda w: w == term


def model_score(t: Tables, words: F.Column, size: F.Column) -> F.Column:
    """The probability of a sentence from the words of it that the model knows and the number of all its words.

    The weights are as few as the model's coefficients: they are collected and stand in the expression, so nothing is joined.
    """
    z = F.lit(0.0)
    for term, weight in sorted((r["term"], r["weight"]) for r in model_terms(t).collect()):
        z = z + F.lit(weight) * F.sqrt(F.size(F.filter(words, _is(term))).cast("double"))
    return F.round(1 / (1 + F.exp(-(INTERCEPT + SCALE * z / F.greatest(size, F.lit(1))))), 6)


def masked(t: Tables, docs: DataFrame | None = None) -> DataFrame:
    """The sentences of `docs` (all documents) with those masked that the model gives too low a score."""
    sents = sentences(t.documents if docs is None else docs, _words=model_words, _size=lambda p: F.size(all_words(p)))
    return prefilter(sents, ["doc_id"], model_score(t, F.col("_words"), F.col("_size")), LEAST_SCORE).drop("_words", "_size")


def grow_sql(before: str, side: str) -> str:
    off, order = ("b.i - s.sent_idx", "s.sent_start, b.char_end") if side == "l" else ("s.sent_idx - b.i", "b.char_start, s.sent_end")
    lo, hi = order.split(", ")
    return f"""{side}0 AS (SELECT b.*, s.sent_start, s.sent_end, {off} k, {lo} lo, {hi} hi, max(s.masked::INT) OVER (PARTITION BY s.doc_id ORDER BY {off}) blk FROM {before} b JOIN pf s ON s.doc_id = b.doc_id WHERE {off} BETWEEN 1 AND 5),
{side}1 AS (SELECT doc_id, k, lo, hi, score old, {scorer_sql('lo', 'hi')} s FROM {side}0 WHERE blk = 0),
{side}2 AS (SELECT * FROM {side}1 WHERE s > old QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, k) = 1),
{side}b AS (SELECT b.doc_id, b.i, coalesce(g.s, b.score) score, coalesce(g.lo, b.char_start) char_start, coalesce(g.hi, b.char_end) char_end, b.n + coalesce(g.k, 0) n FROM {before} b LEFT JOIN {side}2 g ON g.doc_id = b.doc_id)"""


SEARCH = f"""{PRE}, b0 AS (SELECT doc_id, sent_idx i, {scorer_sql('sent_start', 'sent_end')} score, sent_start char_start, sent_end char_end, 1 n FROM pf WHERE NOT masked QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {scorer_sql('sent_start', 'sent_end')} DESC, sent_idx) = 1),
{grow_sql('b0', 'l')}, {grow_sql('lb', 'r')}, found AS (SELECT doc_id, round(score, 6) score, char_start, char_end, CAST(n AS INTEGER) num_sents FROM rb)"""


@R.add("OP20_prefilter", f"WITH {PRE} SELECT doc_id, sent_idx, masked, filter_rate FROM pf")
def prefilter_query(t: Tables) -> DataFrame:
    return masked(t).select("doc_id", "sent_idx", "masked", "filter_rate")


def found(t: Tables, docs: DataFrame | None = None) -> DataFrame:
    """The best span of every document of `docs`, of all without it."""
    return span_search(masked(t, docs), ["doc_id"], scorer).withColumn("score", F.round("score", 6))


@R.add("OP21_span_search", f"WITH {SEARCH} SELECT * FROM found")
def span_search_query(t: Tables) -> DataFrame:
    return found(t)


@R.add("OP28_found_spans", f"WITH {SEARCH} SELECT f.doc_id, f.score, substr(d.text, char_start + 1, char_end - char_start) quote FROM found f JOIN documents d USING (doc_id) WHERE score >= 0.9 AND d.lang = 'en'")
def found_spans(t: Tables) -> DataFrame:
    """Spans over the threshold in English documents, which alone are searched, with their text as it stands in the document."""
    docs = t.documents.where("lang = 'en'").select("doc_id", "text")
    return found(t, docs).where("score >= 0.9").join(docs, "doc_id").select("doc_id", "score", F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("quote"))


@R.add("OP22_attached_predictions", f"WITH {SEARCH} SELECT d.doc_id, d.source, f.score pred_score, f.num_sents pred_num_sents, CASE WHEN f.score >= 0.95 THEN 1 ELSE 0 END pred_label FROM documents d LEFT JOIN found f USING (doc_id)")
def attached_predictions(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source").join(found(t), "doc_id", "left")
    return rows.select("doc_id", "source", F.col("score").alias("pred_score"), F.col("num_sents").alias("pred_num_sents"), F.when(F.col("score") >= 0.95, 1).otherwise(0).alias("pred_label"))


RUN = f"""{CUR}, {SEARCH}, last AS (SELECT max(bot_version) v FROM bot_records), prs AS (SELECT DISTINCT case_id, document_id FROM bot_records WHERE case_id IS NOT NULL AND document_id IS NOT NULL),
seen AS (SELECT DISTINCT case_id, document_id, text_version FROM bot_records, last WHERE bot_version = v), ot AS (SELECT DISTINCT case_id, document_id FROM cur WHERE status NOT IN ('declined', 'draft')),
run AS (SELECT p.case_id, p.document_id, d.text_version, f.score, f.char_start, f.char_end, CASE WHEN s.case_id IS NOT NULL THEN 'skip_visited' WHEN d.doc_id IS NULL THEN 'skip_notfound' WHEN NOT coalesce(regexp_matches(d.text, '\\S'), false) THEN 'skip_empty'
  WHEN d.lang IS DISTINCT FROM 'en' THEN 'skip_non_en' WHEN o.case_id IS NOT NULL THEN 'skip_points' WHEN f.score >= 0.98 THEN 'ran_found' ELSE 'ran_notfound' END status
  FROM prs p LEFT JOIN documents d ON d.doc_id = p.document_id LEFT JOIN seen s ON s.case_id = p.case_id AND s.document_id = p.document_id AND s.text_version = d.text_version LEFT JOIN ot o ON o.case_id = p.case_id AND o.document_id = p.document_id LEFT JOIN found f ON f.doc_id = d.doc_id)"""


def run_status(t: Tables, log: DataFrame) -> DataFrame:
    """What a run does with every pair of case and document: the first condition that holds names its status.

    The status comes first; only documents that some case is to be run on are searched. Skipped pairs have no score and no span.
    """
    pairs = t.bot_records.where("case_id IS NOT NULL AND document_id IS NOT NULL").select("case_id", "document_id").distinct()
    docs = t.documents.select(F.col("doc_id").alias("document_id"), "text_version", "lang", is_blank("text").alias("_blank"), F.lit(True).alias("_known"))
    seen = log.select("case_id", "document_id", "text_version", F.lit(True).alias("_seen")).distinct()
    other = t.current_points(["id", "case_id", "document_id", "status"]).where(~F.col("status").isin("declined", "draft")).select("case_id", "document_id", F.lit(True).alias("_other")).distinct()
    rows = pairs.join(docs, "document_id", "left").join(seen, ["case_id", "document_id", "text_version"], "left").join(other, ["case_id", "document_id"], "left")
    skipped = (
        F.when(F.col("_seen"), "skip_visited")
        .when(F.col("_known").isNull(), "skip_notfound")
        .when(F.col("_blank"), "skip_empty")
        .when(~F.col("lang").eqNullSafe("en"), "skip_non_en")
        .when(F.col("_other"), "skip_points")
    )
    rows = stored(rows.select("case_id", "document_id", "text_version", skipped.alias("_skipped")), "pairs")
    asked = to_search(rows)
    spans = found(t, t.documents.join(asked, "doc_id", "left_semi")).select(F.col("doc_id").alias("document_id"), "score", "char_start", "char_end")
    ran = rows.where("_skipped IS NULL").join(spans, "document_id", "left")
    ran = ran.withColumn("status", F.when(F.col("score") >= 0.98, "ran_found").otherwise("ran_notfound"))
    kept = ["case_id", "document_id", "text_version", "score", "char_start", "char_end", "status"]
    none = rows.where("_skipped IS NOT NULL").select("case_id", "document_id", "text_version", *[F.lit(None).cast(k).alias(c) for c, k in (("score", "double"), ("char_start", "int"), ("char_end", "int"))], F.col("_skipped").alias("status"))
    return ran.select(*kept).unionByName(none)


def to_search(rows: DataFrame) -> DataFrame:
    """(doc_id) of the documents that no condition skips for every case."""
    return rows.where("_skipped IS NULL").select(F.col("document_id").alias("doc_id")).distinct()


def latest_log(t: Tables) -> DataFrame:
    last = F.broadcast(t.bot_records.agg(F.max("bot_version").alias("bot_version")))
    return t.bot_records.join(last, "bot_version", "left_semi").select("case_id", "document_id", "text_version")


#: Statuses after which a version counts as visited.
RECORDED = ("skip_empty", "skip_non_en", "ran_found", "ran_notfound")


@R.add("OP26_run_status", f"WITH {RUN} SELECT case_id, document_id, status FROM run")
def run_status_query(t: Tables) -> DataFrame:
    return run_status(t, latest_log(t)).select("case_id", "document_id", "status")


@R.add("OP27_run_totals", f"WITH {RUN} SELECT status, count(*) n FROM run GROUP BY 1")
def run_totals(t: Tables) -> DataFrame:
    return run_status(t, latest_log(t)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@R.add("SNK4_new_records", f"WITH {RUN} SELECT case_id, document_id, text_version, CASE WHEN status LIKE 'ran%' THEN char_start END char_start, CASE WHEN status LIKE 'ran%' THEN char_end END char_end, CASE WHEN status LIKE 'ran%' THEN score END ml_score FROM run WHERE status IN {RECORDED}")
def new_records(t: Tables) -> DataFrame:
    rows, ran = run_status(t, latest_log(t)).where(F.col("status").isin(*RECORDED)), F.col("status").startswith("ran")
    return rows.select("case_id", "document_id", "text_version", F.when(ran, F.col("char_start")).alias("char_start"), F.when(ran, F.col("char_end")).alias("char_end"), F.when(ran, F.col("score")).alias("ml_score"))


@R.add("SRC7_second_run_status", f"WITH {RUN} SELECT case_id, document_id, CASE WHEN status IN {RECORDED} AND text_version IS NOT NULL THEN 'skip_visited' ELSE status END status FROM run")
def second_run_status(t: Tables) -> DataFrame:
    """A run right after the first one: what that recorded is skipped."""
    log = latest_log(t)
    first = run_status(t, log).where(F.col("status").isin(*RECORDED)).select("case_id", "document_id", "text_version")
    return run_status(t, log.union(first)).select("case_id", "document_id", "status")


SPANS = f"x AS (SELECT DISTINCT case_id, document_id, char_start, char_end, label, source, fold FROM sent_spans WHERE document_id IS NOT NULL), y AS (SELECT *, round({uniform_sql('pred', 'case_id', 'document_id', 'char_start', 'char_end')}, 4) pred FROM x)"


def predicted_spans(t: Tables) -> DataFrame:
    rows = t.sent_spans.where("document_id IS NOT NULL").select("case_id", "document_id", "char_start", "char_end", "label", "source", "fold").distinct()
    return rows.withColumn("pred", F.round(uniform("pred", "case_id", "document_id", "char_start", "char_end"), 4))


@R.add("OP29_corrected_spans", f"WITH {SPANS}, c AS (SELECT DISTINCT case_id, source, document_id, char_start FROM y WHERE pred >= 0.95) SELECT y.case_id, y.document_id, y.char_start, y.char_end, y.source, CASE WHEN c.case_id IS NULL THEN y.label WHEN y.label = 'positive' THEN 'negative' ELSE 'positive' END label FROM y LEFT JOIN c USING (case_id, source, document_id, char_start)")
def corrected_spans(t: Tables) -> DataFrame:
    """Labels turned round where a correction names the span's case, source, document and start."""
    spans = predicted_spans(t)
    fixes = spans.where("pred >= 0.95").select("case_id", "source", "document_id", "char_start", F.lit(True).alias("_fix")).distinct()
    label = F.when(F.col("_fix").isNull(), F.col("label")).when(F.col("label") == "positive", "negative").otherwise("positive")
    return spans.join(fixes, ["case_id", "source", "document_id", "char_start"], "left").select("case_id", "document_id", "char_start", "char_end", "source", label.alias("label"))


@R.add("OP30_review_list", f"""WITH {SPANS} SELECT case_id, document_id, char_start, char_end, source, pred, 'documents/' || document_id link,
CAST(row_number() OVER (PARTITION BY case_id, source ORDER BY CASE WHEN source = 'approved' THEN pred ELSE -pred END, document_id, char_start, char_end, label, fold) AS INTEGER) place FROM y WHERE CASE WHEN source = 'approved' THEN pred < 0.97 ELSE pred > 0.03 END""")
def review_list(t: Tables) -> DataFrame:
    """Spans the model is not sure of, the least expected first: approved ones by rising, the others by falling score."""
    rows = predicted_spans(t).where(F.when(F.col("source") == "approved", F.col("pred") < 0.97).otherwise(F.col("pred") > 0.03))
    order = F.when(F.col("source") == "approved", F.col("pred")).otherwise(-F.col("pred"))
    by = [order.asc(), *[F.col(c).asc() for c in ("document_id", "char_start", "char_end", "label")], F.asc_nulls_last("fold")]
    placed = running_sums(rows.withColumn("_one", F.lit(1)), ["case_id", "source"], by, order, False, {"_one": "place"})
    return placed.select("case_id", "document_id", "char_start", "char_end", "source", "pred", F.concat(F.lit("documents/"), F.col("document_id").cast("string")).alias("link"), F.col("place").cast("int").alias("place"))


@R.add("NUM1_softmax", f"WITH {SPANS} SELECT case_id, document_id, char_start, char_end, label, source, fold, round(exp(pred) / (exp(1 - pred) + exp(pred)), 6) positive FROM y")
def softmax(t: Tables) -> DataFrame:
    rows = predicted_spans(t)
    return rows.select("case_id", "document_id", "char_start", "char_end", "label", "source", "fold", F.round(F.exp("pred") / (F.exp(1 - F.col("pred")) + F.exp("pred")), 6).alias("positive"))


@F.pandas_udf(DoubleType())
def batched_model(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The seam for a trained model, from texts to probabilities: it is set up once per task and scores Arrow batches. A null text has none."""
    words = re.compile("[a-z0-9]+").findall

    def score(text: str | None) -> float | None:
        if text is None:
            return None
        counts = Counter(w for w in words(text.lower()) if w in COEFFICIENTS)
        return 1 / (1 + math.exp(-(INTERCEPT + sum(COEFFICIENTS[w] * math.sqrt(n) for w, n in counts.items()) / SCALE)))

    for texts in parts:
        yield texts.map(score).astype("float64")


@R.add("UDF4_batched_scores", f"WITH model(term, coef) AS (VALUES {_VALUES}), tf AS (SELECT doc_id, term, count(*) tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term FROM documents WHERE lang = 'en') GROUP BY 1, 2), z AS (SELECT doc_id, sum(coef * sqrt(tf)) z FROM tf JOIN model USING (term) GROUP BY 1) SELECT doc_id, CASE WHEN text IS NOT NULL THEN round(1 / (1 + exp(-({INTERCEPT} + coalesce(z, 0) / {SCALE}))), 6) END score FROM documents LEFT JOIN z USING (doc_id) WHERE lang = 'en'")
def batched_scores(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'en'").select("doc_id", F.round(batched_model("text"), 6).alias("score"))


@R.add("OP32_length_analytics", f"""WITH {SEARCH}, p AS (SELECT num_sents, count(*) predicted FROM found GROUP BY 1), o AS (SELECT num_sents, count(*) given FROM sent_spans WHERE num_sents IS NOT NULL GROUP BY 1)
SELECT num_sents, coalesce(predicted, 0) predicted, coalesce(given, 0) given FROM p FULL JOIN o USING (num_sents)""")
def length_analytics(t: Tables) -> DataFrame:
    p = found(t).groupBy("num_sents").agg(F.count(F.lit(1)).alias("predicted"))
    o = t.sent_spans.where("num_sents IS NOT NULL").groupBy("num_sents").agg(F.count(F.lit(1)).alias("given"))
    return p.join(o, "num_sents", "full").na.fill(0)


@R.add("STR11_blank_in_bounds", "SELECT count(*) FILTER (WHERE text IS NULL) none, count(*) FILTER (WHERE NOT coalesce(regexp_matches(text, '\\S'), false)) blank FROM documents")
def blank_in_bounds(t: Tables) -> DataFrame:
    return t.documents.agg(F.count_if(F.col("text").isNull()).alias("none"), F.count_if(is_blank(blank_tags("text"))).alias("blank"))
