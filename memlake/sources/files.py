"""Files as sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonc(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, with // comment lines."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?m)^\s*//.*$", "").alias("v"))
    return text.select(F.from_json("v", schema).alias("j")).select("j.*")


def export_rows(df: DataFrame, path: str) -> None:
    """Each row as one JSON object."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def restore_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("j")).select("j.*")


def catalog_ready(spark: SparkSession, tables: list[str]) -> dict[str, bool]:
    return {t: spark.catalog.tableExists(t) for t in tables}
