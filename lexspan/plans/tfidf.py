"""Term tables, the prefilter's training rows and its grid of setups."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions.draws import integer_below
from lexspan.functions.text import part, word_ngrams
from lexspan.operators.metrics import average_precision, pr_curve
from lexspan.operators.sampling import hash_rank
from lexspan.operators.spans import sentences
from lexspan.operators.tfidf import document_frequencies, term_counts, tfidf
from lexspan.plans.common import CUR, Registry, Tables
from lexspan.plans.datasets import rank_sql
from lexspan.plans.spans import SENTS, cases_of_sentences

R = Registry()
QUERIES, SQL = R.queries, R.sql

GRAMS = """en AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w FROM documents WHERE lang = 'en' AND text IS NOT NULL),
tc AS (SELECT doc_id, term, count(*) tf FROM (SELECT doc_id, unnest(w) term FROM en UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM en WHERE len(w) > 1) GROUP BY 1, 2),
dn AS (SELECT count(*) n FROM en), df AS (SELECT term, count(*) df, any_value(n) n FROM tc, dn GROUP BY 1 HAVING count(*) >= 4 AND count(*) <= 0.8 * any_value(n))"""


def english(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'en' AND text IS NOT NULL").select("doc_id", "text")


@R.add("STR13_ngrams", f"WITH {GRAMS} SELECT doc_id, term, tf FROM tc")
def ngrams(t: Tables) -> DataFrame:
    return term_counts(english(t), "doc_id", "text")


@R.add("AG19_document_frequency", f"WITH {GRAMS} SELECT term, df FROM df")
def document_frequency(t: Tables) -> DataFrame:
    return document_frequencies(term_counts(english(t), "doc_id", "text"), english(t)).select("term", "df")


@R.add("OP14_tfidf_weights", f"WITH {GRAMS}, w AS (SELECT doc_id, term, sqrt(tf) * (ln((n + 1) / (df + 1)) + 1) w FROM tc JOIN df USING (term)) SELECT doc_id, term, round(w / sum(w) OVER (PARTITION BY doc_id), 6) weight FROM w")
def tfidf_weights(t: Tables) -> DataFrame:
    counts = term_counts(english(t), "doc_id", "text")
    return tfidf(counts, document_frequencies(counts, english(t)), "doc_id").select("doc_id", "term", F.round("weight", 6).alias("weight"))


PREP = f"""{CUR}, {SENTS}, pos AS (SELECT id, case_id, quote_text FROM cur WHERE status = 'approved' AND case_id IS NOT NULL AND nullif(quote_text, '') IS NOT NULL),
pick AS (SELECT doc_id FROM documents WHERE lang = 'en' AND text IS NOT NULL QUALIFY {rank_sql('', 'negdocs', 'doc_id')} < 600),
drawn AS (SELECT s.* FROM sents s SEMI JOIN pick USING (doc_id) QUALIFY {rank_sql('doc_id', 'negsents', 'doc_id', 'sent_idx')} < 18),
cs AS (SELECT s.doc_id, s.sent_idx, list(p.case_id ORDER BY p.case_id) cases FROM drawn s JOIN cur p ON p.document_id = s.doc_id AND p.quote_start < s.sent_end AND p.quote_end > s.sent_start WHERE p.case_id IS NOT NULL GROUP BY 1, 2),
neg AS (SELECT s.doc_id, s.sent_idx, substr(d.text, s.sent_start + 1, s.sent_end - s.sent_start) sentence, coalesce(cs.cases, []) offlimits FROM drawn s JOIN documents d USING (doc_id) LEFT JOIN cs USING (doc_id, sent_idx))"""


def positives(t: Tables) -> DataFrame:
    return t.current_points(["id", "case_id", "status", "quote_text"]).where("status = 'approved' AND case_id IS NOT NULL AND quote_text <> ''").select("id", "case_id", "quote_text")


def negatives(t: Tables, documents: int = 600, each: int = 18) -> DataFrame:
    """Drawn sentences of drawn English documents, with the cases of the points that overlap them."""
    picked = hash_rank(english(t).select("doc_id"), [], "negdocs", ["doc_id"]).where(F.col("rank0") < documents).select("doc_id")
    some = hash_rank(sentences(t.documents.join(picked, "doc_id", "left_semi")), ["doc_id"], "negsents", ["doc_id", "sent_idx"]).where(F.col("rank0") < each).drop("rank0", "group_size")
    rows = some.join(cases_of_sentences(t), ["doc_id", "sent_idx"], "left").join(t.documents.select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "sent_idx", part("text", "sent_start", "sent_end").alias("sentence"), F.coalesce("cases", F.array().cast("array<bigint>")).alias("offlimits"))


@R.add("OP11_negative_sentences", f"WITH {PREP} SELECT doc_id, sent_idx, sentence, offlimits FROM neg")
def negative_sentences(t: Tables) -> DataFrame:
    return negatives(t)


@R.add("OP12_case_rows", f"WITH {PREP}, c AS (SELECT min(case_id) c FROM pos) SELECT quote_text, 1 label FROM pos, c WHERE case_id = c UNION ALL SELECT sentence, 0 FROM neg, c WHERE NOT list_contains(offlimits, c)")
def case_rows(t: Tables) -> DataFrame:
    """Training rows of the case of the least id, as the SQL states; `all_case_rows` has every case."""
    one = F.broadcast(positives(t).agg(F.min("case_id").alias("case_id")))
    return training_rows(t, one).drop("case_id")


def training_rows(t: Tables, cases: DataFrame) -> DataFrame:
    """(case_id, quote_text, label) of every case in `cases`: its approved quotes, and drawn sentences no point of the case touches."""
    yes = positives(t).join(cases, "case_id").select("case_id", "quote_text", F.lit(1).alias("label"))
    no = negatives(t).join(cases).where(~F.array_contains("offlimits", F.col("case_id"))).select("case_id", F.col("sentence").alias("quote_text"), F.lit(0).alias("label"))
    return yes.unionByName(no)


@R.add("OP12_all_case_rows", f"WITH {PREP}, c AS (SELECT DISTINCT case_id FROM pos) SELECT case_id, quote_text, 1 label FROM pos UNION ALL SELECT case_id, sentence, 0 FROM neg, c WHERE NOT list_contains(offlimits, case_id)")
def all_case_rows(t: Tables) -> DataFrame:
    """Training rows of every case that has an approved quote; cases are bounded, and the drawn sentences are 600 x 18 at most."""
    return training_rows(t, F.broadcast(positives(t).select("case_id").distinct()))


@R.add("OP15_grid", """WITH linear(model) AS (VALUES ('logistic l2'), ('logistic elastic'), ('sgd log')), w(weight) AS (VALUES ('2:1'), ('1:1'), ('1:3'), ('1:5')), forest(model) AS (VALUES ('forest d3 s8'), ('forest d5 s8'), ('forest d10 s8'), ('forest d5 s4'), ('forest d5 s12')), r(rebalance_to) AS (VALUES (20), (NULL))
SELECT model, weight, rebalance_to FROM linear, w, r UNION ALL SELECT model, 'balanced', rebalance_to FROM forest, r""")
def grid(t: Tables) -> DataFrame:
    """The setups to try: every linear model with four class weights, every forest with balanced ones, each with and without rebalancing."""
    each = lambda *x: F.explode(F.array(*[F.lit(v) for v in x]))
    one = t.spark.range(1)
    linear = one.select(each("logistic l2", "logistic elastic", "sgd log").alias("model")).withColumn("weight", each("2:1", "1:1", "1:3", "1:5"))
    forest = one.select(each("forest d3 s8", "forest d5 s8", "forest d10 s8", "forest d5 s4", "forest d5 s12").alias("model")).withColumn("weight", F.lit("balanced"))
    return linear.union(forest).withColumn("rebalance_to", F.explode(F.array(F.lit(20), F.lit(None).cast("int"))))


@R.add("OP16_cv_metrics")
def cv_metrics(t: Tables) -> DataFrame:
    """Average precision of two setups in three folds, trained on the span texts of all cases (label positive or not)."""
    rows = t.sent_spans.where("text IS NOT NULL AND document_id IS NOT NULL").select("document_id", "text", F.when(F.col("label") == "positive", 1.0).otherwise(0.0).alias("label")).distinct()
    rows = rows.select("document_id", "label", word_ngrams("text").alias("words"), integer_below(F.lit(3), "cv", "document_id").alias("fold"))
    vectors = IDF(inputCol="tf", outputCol="features", minDocFreq=4).fit(h := HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 12).transform(rows)).transform(h).select("document_id", "label", "fold", "features").persist()
    parts = []
    for setup, (ridge, weight) in enumerate([(0.01, 1.0), (0.1, 3.0)]):
        for fold in range(3):
            train = vectors.where(F.col("fold") != fold).withColumn("w", F.when(F.col("label") == 1.0, weight).otherwise(1.0))
            model = LogisticRegression(maxIter=10, regParam=ridge, weightCol="w").fit(train)
            scored = model.transform(vectors.where(F.col("fold") == fold)).select(F.lit(setup).alias("setup_id"), "fold", F.round(F.get(vector_to_array("probability"), 1), 6).alias("score"), F.col("label").cast("int").alias("label"))
            parts.append(average_precision(pr_curve(scored, ["setup_id", "fold"]), ["setup_id", "fold"]))
    return reduce(DataFrame.unionByName, parts)

