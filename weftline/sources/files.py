"""Readers: whole SQL files, view catalogues, lineage records, and the settings of model clients."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUE = "table_name string, view_def string"
LINEAGE = "target string, sources array<string>"


def read_scripts(spark: SparkSession, path: str | list[str], pattern: str = "*.{sql,txt}") -> DataFrame:
    """filename, content and path of each file as a whole, in UTF-8."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"))


def read_view_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """table_name, view_def from CSV whose definitions span lines and quote with double quotes."""
    return spark.read.csv(path, schema=CATALOGUE, header=True, multiLine=True, escape='"')


def view_statements(catalogue: DataFrame, schema: str) -> DataFrame:
    """The catalogue with the statement that would fill each view; a null name or definition gives null."""
    return catalogue.withColumn("sql", F.concat(F.lit(f"INSERT INTO {schema}."), "table_name", F.lit(" "), "view_def"))


def lineage_records(spark: SparkSession, records: Mapping | list[Mapping]) -> DataFrame:
    """One record or a list of them as a table, in the given order by seq."""
    rows = [records] if isinstance(records, Mapping) else list(records)
    data = [(i, r.get("target"), list(r["sources"]) if r.get("sources") is not None else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"seq long, {LINEAGE}")


def access_token(given: str | None = None, names: tuple[str, ...] = ("HF_TOKEN", "HUGGINGFACEHUB_API_TOKEN"), env: Mapping[str, str] | None = None) -> str | None:
    """The token given, or that of the first name which the environment has."""
    env = os.environ if env is None else env
    return given or next((env[n] for n in names if env.get(n)), None)
