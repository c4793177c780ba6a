"""Round trips through files and the incremental stream, in the shared folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.plans.common import CUR, Registry, Tables
from lexspan.sources.files import append_log, export_csv, read_csv, read_text_files, write_partitioned
from lexspan.sources.tables import scratch_path
from lexspan.streaming.incremental import LOG, run_new_versions

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add("SNK1_partitioned_table", f"WITH {CUR} SELECT id, document_id, status FROM cur WHERE status = 'approved'")
def partitioned_table(t: Tables) -> DataFrame:
    """Written by status, read back from one partition."""
    path = scratch_path(t.spark, "points")
    write_partitioned(t.current_points(["id", "document_id", "status"]), path, "status")
    return t.spark.read.parquet(path).where("status = 'approved'").select("id", "document_id", "status")


@R.add("SNK2_csv_export", "SELECT id, title, classification, score FROM cases")
def csv_export(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "cases")
    export_csv(t.cases.select("id", "title", "classification", "score"), path, "id")
    return read_csv(t.spark, path, "id bigint, title string, classification string, score double")


@R.add("SNK3_appended_log", "SELECT case_id, document_id, bot_version, count(*) n FROM (SELECT case_id, document_id, bot_version FROM bot_records UNION ALL SELECT case_id, document_id, bot_version FROM bot_records WHERE case_id IS NULL) GROUP BY 1, 2, 3")
def appended_log(t: Tables) -> DataFrame:
    path, rows = scratch_path(t.spark, "log"), t.bot_records.select("case_id", "document_id", "bot_version")
    append_log(rows, path)
    append_log(rows.where("case_id IS NULL"), path)
    return t.spark.read.parquet(path).groupBy("case_id", "document_id", "bot_version").agg(F.count(F.lit(1)).alias("n"))


@R.add("SRC9_text_files", "SELECT title, length(title) n FROM topics WHERE title IS NOT NULL AND title <> ''")
def text_files(t: Tables) -> DataFrame:
    """One file for each topic, read as whole texts."""
    path = scratch_path(t.spark, "topics")
    t.topics.where("title IS NOT NULL AND title <> ''").select("title", "id").repartition("id").write.partitionBy("id").text(path)
    return read_text_files(t.spark, path).select(F.regexp_replace("text", "\n$", "").alias("title")).select("title", F.length("title").alias("n"))


@R.add("SNK5_streamed_versions", "SELECT DISTINCT doc_id, text_version, n_chars FROM documents WHERE doc_id IS NOT NULL AND text_version IS NOT NULL")
def streamed_versions(t: Tables) -> DataFrame:
    """Document versions taken in by the stream, in two runs of which the second finds nothing new."""
    docs, root = t.documents.select("doc_id", "text_version", "n_chars").where("doc_id IS NOT NULL AND text_version IS NOT NULL"), scratch_path(t.spark, "stream")
    docs.write.parquet(f"{root}/in")
    t.spark.createDataFrame([], LOG).write.parquet(f"{root}/log")
    for run in (1, 2):
        run_new_versions(t.spark, f"{root}/in", docs.schema, f"{root}/log", f"{root}/checkpoint{run}", lambda d: d, f"{root}/out")
    return t.spark.read.schema(docs.schema).parquet(f"{root}/out").select(*docs.columns)


RUNS = "r AS (SELECT bot_version run_key, case_id, document_id, ml_score FROM bot_records WHERE bot_version IS NOT NULL)"


@R.add("SNK6_saved_results", f"WITH {RUNS} SELECT run_key, case_id, document_id, ml_score FROM r")
def saved_results(t: Tables) -> DataFrame:
    """The results of every run, each saved under its run key."""
    path = scratch_path(t.spark, "results")
    write_partitioned(_results(t), path, "run_key")
    return t.spark.read.schema("case_id bigint, document_id bigint, ml_score double, run_key string").parquet(path).select("run_key", "case_id", "document_id", "ml_score")


@R.add("SRC13_pulled_results", f"WITH {RUNS} SELECT case_id, count(*) n, count(DISTINCT run_key) runs FROM r WHERE case_id IS NOT NULL GROUP BY 1")
def pulled_results(t: Tables) -> DataFrame:
    """The union of the results saved case by case."""
    path = scratch_path(t.spark, "pulled")
    write_partitioned(_results(t).where("case_id IS NOT NULL"), path, "case_id")
    return t.spark.read.parquet(path).groupBy(F.col("case_id").cast("bigint").alias("case_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_key").alias("runs"))


@R.add("SNK7_refused_overwrite", "SELECT count(*) n, true refused FROM bot_records WHERE bot_version IS NOT NULL")
def refused_overwrite(t: Tables) -> DataFrame:
    """Results that are there already are not replaced: the second upload is refused and the first one stays."""
    path, refused = scratch_path(t.spark, "upload"), False
    _results(t).write.mode("errorifexists").parquet(path)
    try:
        _results(t).limit(0).write.mode("errorifexists").parquet(path)
    except AnalysisException:
        refused = True
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(refused).alias("refused"))


def _results(t: Tables) -> DataFrame:
    return t.bot_records.where("bot_version IS NOT NULL").select(F.col("bot_version").alias("run_key"), "case_id", "document_id", "ml_score")
