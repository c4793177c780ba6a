"""Readers and writers for the forms the tables come in and go out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space around a value belongs to it.
SPACES = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_database_table(spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A table of a relational database over JDBC, read in `partitions` ranges of its key."""
    bounds = {"partitionColumn": key, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(url=url, dbtable=name, **bounds, **options).load()


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): every file below `path` as one text."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and a given schema."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_partitioned(df: DataFrame, path: str, by: str, mode: str = "errorifexists") -> None:
    """Parquet in one folder for each value of `by`; an existing table is not replaced unless the mode says so."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a log. An empty frame adds none."""
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str, order: str) -> None:
    """One CSV file with a header, ordered; for small reports."""
    df.orderBy(order).coalesce(1).write.mode("errorifexists").option("header", True).option("escape", '"').options(**SPACES).csv(path)
