"""Incremental runs as a stream: whatever versions of documents have arrived and are not in the log yet."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "doc_id bigint, text_version string"


def run_new_versions(spark: SparkSession, source: str, schema: StructType, log: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], out: str) -> None:
    """Process the files that came to the folder `source` since the last call, and stop.

    Of each batch the versions (doc_id, text_version) that are not in `log` are processed, written to the batch's own folder below `out`,
    and then logged in a folder of the same name below `log`; a changed version opens its document again. A batch that is repeated after a failure at any
    point does not heed its own log and writes both folders anew, so its output is there once. Rows with a null id or version are never logged and come again.
    """
    stream_id = md5(checkpoint.encode()).hexdigest()[:12]

    def batch(df: DataFrame, number: int) -> None:
        own = f"batch={stream_id}-{number}"
        logged = spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(log)
        others = logged.where(~F.contains(F.col("_metadata.file_path"), F.lit(f"/{own}/")))
        fresh = df.dropDuplicates(["doc_id", "text_version"]).join(others, ["doc_id", "text_version"], "left_anti").persist()
        process(fresh).write.mode("overwrite").parquet(f"{out}/{own}")
        fresh.where("doc_id IS NOT NULL AND text_version IS NOT NULL").select("doc_id", "text_version").write.mode("overwrite").parquet(f"{log}/{own}")
        fresh.unpersist()

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
