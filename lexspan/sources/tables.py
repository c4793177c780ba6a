"""Table access and materialisation that survives the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else one of our own (tests on one machine)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if set_dir:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(set_dir)
        return set_dir
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexspan-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


#: Paths given out in this process, for `clear_scratch`.
_GIVEN: list[str] = []


def clear_scratch(spark: SparkSession) -> int:
    """Remove the tables written below paths of `scratch_path` so far, once the results that read them are done with; how many paths there were."""
    count = len(_GIVEN)
    while _GIVEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_GIVEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return count


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """A table written to the shared folder and read again: its size is known, and only the columns asked for are read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _GIVEN.append(path)
    return path
