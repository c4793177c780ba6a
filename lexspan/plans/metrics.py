"""Curves, thresholds and model selection over scored points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.functions.draws import integer_below, integer_below_sql, uniform, uniform_sql
from lexspan.operators.metrics import average_precision, best_threshold, f_score, frontier, pr_curve, roc_auc
from lexspan.plans.common import CUR, Registry, Tables

R = Registry()
QUERIES, SQL = R.queries, R.sql

SCORED = f"{CUR}, scored AS (SELECT id, case_id, ml_score score, CASE WHEN status = 'approved' THEN 1 ELSE 0 END label FROM cur WHERE case_id IS NOT NULL AND ml_score BETWEEN 0 AND 1)"


def curve_sql(source: str, group: str, name: str) -> str:
    return f"""{name}0 AS (SELECT {group}, score threshold, sum(label) p, count(*) n FROM {source} GROUP BY ALL),
{name}1 AS (SELECT {group}, threshold, CAST(sum(p) OVER d AS BIGINT) tp, CAST(sum(n) OVER d - sum(p) OVER d AS BIGINT) fp, CAST(sum(p) OVER g AS BIGINT) positives, CAST(sum(n) OVER g - sum(p) OVER g AS BIGINT) negatives FROM {name}0
  WINDOW d AS (PARTITION BY {group} ORDER BY threshold DESC), g AS (PARTITION BY {group})),
{name} AS (SELECT *, round(tp / (tp + fp), 9) "precision", CASE WHEN positives > 0 THEN round(tp / positives, 9) ELSE 0.0 END recall FROM {name}1)"""


CURVE = f"{SCORED}, {curve_sql('scored', 'case_id', 'curve')}"
FB = "CASE WHEN \"precision\" + recall = 0 THEN 0.0 ELSE round({k} * \"precision\" * recall / ({b} * \"precision\" + recall), 9) END"
F1, F15 = FB.format(k="2.0", b="1.0"), FB.format(k="3.25", b="2.25")


def scored(t: Tables) -> DataFrame:
    """Current points with a usable score; approved ones are positive."""
    rows = t.current_points(["id", "case_id", "status", "ml_score"]).where("case_id IS NOT NULL AND ml_score >= 0 AND ml_score <= 1 AND NOT isnan(ml_score)")
    return rows.select("id", "case_id", F.col("ml_score").alias("score"), F.when(F.col("status") == "approved", 1).otherwise(0).alias("label"))


@R.add("WN1_pr_curve", f"WITH {CURVE} SELECT case_id, threshold, tp, fp, \"precision\", recall FROM curve")
def pr_curve_query(t: Tables) -> DataFrame:
    return pr_curve(scored(t), ["case_id"]).select("case_id", "threshold", "tp", "fp", "precision", "recall")


@R.add("WN2_roc_auc", f"""WITH {SCORED}, x AS (SELECT case_id, label, rank() OVER (PARTITION BY case_id ORDER BY score) + (count(*) OVER (PARTITION BY case_id, score) - 1) / 2 r FROM scored),
s AS (SELECT case_id, sum(label * r) s, sum(label) p, sum(1 - label) n FROM x GROUP BY 1) SELECT case_id, CASE WHEN p > 0 AND n > 0 THEN round((s - p * (p + 1) / 2) / (p * n), 6) END auc FROM s""")
def roc_auc_query(t: Tables) -> DataFrame:
    return roc_auc(scored(t), ["case_id"])


@R.add("WN3_average_precision", f"WITH {CURVE}, g AS (SELECT *, tp - coalesce(lag(tp) OVER (PARTITION BY case_id ORDER BY threshold DESC), 0) gain FROM curve) SELECT case_id, CASE WHEN max(positives) > 0 THEN round(sum(gain * tp / (tp + fp)) / max(positives), 6) ELSE 0.0 END ap FROM g GROUP BY 1")
def average_precision_query(t: Tables) -> DataFrame:
    return average_precision(pr_curve(scored(t), ["case_id"]), ["case_id"])


@R.add("OP23_best_f1", f"WITH {CURVE}, s AS (SELECT *, {F1} f FROM curve) SELECT case_id, threshold, \"precision\", recall, f FROM s QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY f DESC, threshold) = 1")
def best_f1(t: Tables) -> DataFrame:
    return best_threshold(pr_curve(scored(t), ["case_id"]), ["case_id"])


BEST15 = f"{CURVE}, s AS (SELECT *, {F15} f FROM curve), b AS (SELECT case_id, threshold, \"precision\", recall, f FROM s QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY f DESC, threshold) = 1)"


@R.add("NUM4_best_fbeta", f"WITH {BEST15} SELECT * FROM b")
def best_fbeta(t: Tables) -> DataFrame:
    return best_threshold(pr_curve(scored(t), ["case_id"]), ["case_id"], beta=1.5)


@R.add("OP24_topic_fbeta", f"WITH {BEST15} SELECT t.title topic, count(*) n, round(avg(b.f), 6) mean_f FROM b JOIN cases c ON b.case_id = c.id JOIN topics t ON c.topic_id = t.id GROUP BY 1 HAVING count(*) > 1")
def topic_fbeta(t: Tables) -> DataFrame:
    best = best_threshold(pr_curve(scored(t), ["case_id"]), ["case_id"], beta=1.5)
    topics = t.topics.select(F.col("id").alias("topic_id"), F.col("title").alias("topic"))
    named = best.join(F.broadcast(t.cases.select(F.col("id").alias("case_id"), "topic_id")), "case_id").join(F.broadcast(topics), "topic_id")
    return named.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f"), 6).alias("mean_f")).where("n > 1")


@R.add("AG18_confusion", f"WITH {SCORED} SELECT case_id, count(*) FILTER (WHERE score < 0.5 AND label = 0) tn, count(*) FILTER (WHERE score >= 0.5 AND label = 0) fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) fn, count(*) FILTER (WHERE score >= 0.5 AND label = 1) tp FROM scored GROUP BY 1")
def confusion(t: Tables) -> DataFrame:
    hit, yes = F.col("score") >= 0.5, F.col("label") == 1
    return scored(t).groupBy("case_id").agg(F.count_if(~hit & ~yes).alias("tn"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(hit & yes).alias("tp"))


@R.add("OP25_case_metrics", f"""WITH {SCORED}, c AS (SELECT case_id, count(*) n, count(*) FILTER (WHERE (score >= 0.5) = (label = 1)) ok, count(*) FILTER (WHERE score >= 0.5 AND label = 1) tp, count(*) FILTER (WHERE score >= 0.5) hit, sum(label) pos FROM scored GROUP BY 1),
m AS (SELECT case_id, round(ok / n, 9) accuracy, CASE WHEN hit > 0 THEN round(tp / hit, 9) ELSE 0.0 END "precision", CASE WHEN pos > 0 THEN round(tp / pos, 9) ELSE 0.0 END recall FROM c)
SELECT *, {F1} f1 FROM m""")
def case_metrics(t: Tables) -> DataFrame:
    hit, yes = F.col("score") >= 0.5, F.col("label") == 1
    c = scored(t).groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(hit == yes).alias("_ok"), F.count_if(hit & yes).alias("_tp"), F.count_if(hit).alias("_hit"), F.count_if(yes).alias("_pos"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 9)).otherwise(F.lit(0.0))
    m = c.select("case_id", ratio("_ok", "_n").alias("accuracy"), ratio("_tp", "_hit").alias("precision"), ratio("_tp", "_pos").alias("recall"))
    return m.withColumn("f1", f_score(F.col("precision"), F.col("recall")))


SMOOTH = f"{CURVE}, f AS (SELECT case_id, threshold, {F1} f FROM curve), a AS (SELECT case_id, threshold, round(avg(f) OVER (PARTITION BY case_id ORDER BY threshold ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) smooth FROM f)"


def smoothed(t: Tables) -> DataFrame:
    curve = pr_curve(scored(t), ["case_id"])
    near = W.partitionBy("case_id").orderBy("threshold").rowsBetween(-2, 2)
    return curve.withColumn("f", f_score(F.col("precision"), F.col("recall"))).select("case_id", "threshold", F.round(F.avg("f").over(near), 6).alias("smooth"))


@R.add("WN9_moving_average", f"WITH {SMOOTH} SELECT * FROM a")
def moving_average(t: Tables) -> DataFrame:
    return smoothed(t)


@R.add("WN10_local_maxima", f"WITH {SMOOTH} SELECT case_id, threshold, smooth FROM a QUALIFY smooth > lag(smooth) OVER (PARTITION BY case_id ORDER BY threshold) AND smooth > lead(smooth) OVER (PARTITION BY case_id ORDER BY threshold)")
def local_maxima(t: Tables) -> DataFrame:
    by = W.partitionBy("case_id").orderBy("threshold")
    return smoothed(t).withColumn("_a", F.lag("smooth").over(by)).withColumn("_b", F.lead("smooth").over(by)).where("smooth > _a AND smooth > _b").select("case_id", "threshold", "smooth")


#: Three setups that blend the score with noise, and five folds of points.
SETUPS = [(0, 1.0), (1, 0.7), (2, 0.4)]
TRIALS = f"""{SCORED}, blend(setup_id, w) AS (VALUES {', '.join(f'({k}, {w}::DOUBLE)' for k, w in SETUPS)}),
trials AS (SELECT setup_id, {integer_below_sql('5', 'fold', 'id')} fold, label, round(w * score + (1 - w) * {uniform_sql('noise', 'setup_id', 'id')}, 4) score FROM scored, blend),
{curve_sql('trials', 'setup_id, fold', 'tc')},
fr0 AS (SELECT *, max("precision") OVER (PARTITION BY setup_id, fold ORDER BY recall, "precision" DESC, threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before,
  row_number() OVER (PARTITION BY setup_id, fold ORDER BY round(abs(recall - 1.0), 9), recall, "precision" DESC, threshold) n1, row_number() OVER (PARTITION BY setup_id, fold ORDER BY round(abs(recall - 0.95), 9), recall, "precision" DESC, threshold) n2
  FROM tc WHERE recall >= 0.8),
fr AS (SELECT setup_id, fold, threshold, "precision", recall, round((negatives - fp) / (positives + negatives), 9) filter_rate FROM fr0
  WHERE before IS NULL OR "precision" > before OR (n1 = 1 AND round(abs(recall - 1.0), 9) <= 0.02) OR (n2 = 1 AND round(abs(recall - 0.95), 9) <= 0.02)),
tg(target) AS (VALUES (1.0::DOUBLE), (0.95::DOUBLE)),
fm AS (SELECT setup_id, fold, target, threshold, filter_rate FROM fr, tg WHERE recall >= target QUALIFY row_number() OVER (PARTITION BY setup_id, fold, target ORDER BY recall, "precision" DESC, threshold) = 1),
sm AS (SELECT setup_id, target, count(*) folds, round(avg(filter_rate), 6) mean_filter_rate, round(stddev_pop(threshold) / nullif(avg(threshold), 0), 6) threshold_cv, round(avg(threshold) - 0.2 * stddev_pop(threshold), 6) final_threshold FROM fm GROUP BY 1, 2)"""


def trials(t: Tables) -> DataFrame:
    setups = F.explode(F.array(*[F.struct(F.lit(k).alias("setup_id"), F.lit(w).alias("w")) for k, w in SETUPS]))
    rows = scored(t).withColumn("_s", setups).select("id", "label", F.col("score").alias("_o"), "_s.setup_id", "_s.w")
    blended = F.round(F.col("w") * F.col("_o") + (1 - F.col("w")) * uniform("noise", "setup_id", "id"), 4)
    return rows.select("setup_id", integer_below(F.lit(5), "fold", "id").alias("fold"), "label", blended.alias("score"))


def trial_frontier(t: Tables) -> DataFrame:
    points = frontier(pr_curve(trials(t), ["setup_id", "fold"]), ["setup_id", "fold"], [1.0, 0.95])
    rate = F.round((F.col("negatives") - F.col("fp")) / (F.col("positives") + F.col("negatives")), 9)
    return points.select("setup_id", "fold", "threshold", "precision", "recall", rate.alias("filter_rate"))


def first_meeting(t: Tables) -> DataFrame:
    """Per setup, fold and recall target the first frontier point that meets it."""
    rows = trial_frontier(t).withColumn("target", F.explode(F.array(F.lit(1.0), F.lit(0.95)))).where("recall >= target")
    first = F.row_number().over(W.partitionBy("setup_id", "fold", "target").orderBy("recall", F.desc("precision"), "threshold"))
    return rows.withColumn("_r", first).where("_r = 1").select("setup_id", "fold", "target", "threshold", "filter_rate")


def stability(t: Tables) -> DataFrame:
    mean, dev = F.avg("threshold"), F.stddev_pop("threshold")
    return first_meeting(t).groupBy("setup_id", "target").agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg("filter_rate"), 6).alias("mean_filter_rate"), F.round(F.try_divide(dev, mean), 6).alias("threshold_cv"), F.round(mean - 0.2 * dev, 6).alias("final_threshold"))


@R.add("OP17_pareto_frontier", f"WITH {TRIALS} SELECT * FROM fr")
def pareto_frontier(t: Tables) -> DataFrame:
    return trial_frontier(t)


@R.add("WN6_recall_targets", f"WITH {TRIALS} SELECT * FROM fm")
def recall_targets(t: Tables) -> DataFrame:
    return first_meeting(t)


@R.add("OP18_threshold_stability", f"WITH {TRIALS} SELECT * FROM sm")
def threshold_stability(t: Tables) -> DataFrame:
    return stability(t)


@R.add("OP19_selected_setup", f"WITH {TRIALS} SELECT setup_id, final_threshold, round(mean_filter_rate + 1 - threshold_cv, 6) score, threshold_cv < 0.2 stable FROM sm WHERE target = 1.0 ORDER BY round(mean_filter_rate + 1 - threshold_cv, 6) DESC NULLS LAST, setup_id LIMIT 1")
def selected_setup(t: Tables) -> DataFrame:
    score = F.round(F.col("mean_filter_rate") + 1 - F.col("threshold_cv"), 6)
    return stability(t).where("target = 1.0").select("setup_id", "final_threshold", score.alias("score"), (F.col("threshold_cv") < 0.2).alias("stable")).orderBy(F.desc_nulls_last("score"), "setup_id").limit(1)
