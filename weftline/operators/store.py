"""The session's lineage results as a table, and what is looked up in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "filename string, statement_index int, query_preview string, full_sql string, stmt_key string, target string, sources array<string>"


class LineageStore:
    """Results kept as a Parquet table at path; failed statements aren't kept, so that they are tried again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def results(self) -> DataFrame:
        p, fs = self._fs()
        return self.spark.read.schema(SCHEMA).parquet(self.path) if fs.exists(p) else self.spark.createDataFrame([], SCHEMA)

    def add(self, extracted: DataFrame) -> None:
        """Appends rows that have no error (a column error, if there is one, is null)."""
        rows = extracted.filter("error IS NULL") if "error" in extracted.columns else extracted
        fresh_statements(rows, self.results()).select(*(c.split()[0] for c in SCHEMA.split(", "))).write.mode("append").parquet(self.path)

    def clear(self) -> None:
        p, fs = self._fs()
        fs.delete(p, True)


def fresh_statements(statements: DataFrame, done: DataFrame) -> DataFrame:
    """Statements whose key isn't done yet, one of each key."""
    return statements.join(done.select("stmt_key").distinct(), "stmt_key", "left_anti").dropDuplicates(["stmt_key"]).select(statements.columns)


def overview(results: DataFrame) -> DataFrame:
    return results.select("filename", "statement_index", "target", F.size("sources").cast("long").alias("source_count"))


def as_target(results: DataFrame, name: str) -> DataFrame:
    return results.filter(F.col("target") == name.strip().lower())


def as_source(results: DataFrame, name: str) -> DataFrame:
    return results.filter(F.array_contains("sources", name.strip().lower()))


def lookup_counts(results: DataFrame, name: str) -> DataFrame:
    """One row: how often a table is a target and a source."""
    key = name.strip().lower()
    return results.agg(F.count_if(F.col("target") == key).alias("as_target"), F.count_if(F.array_contains("sources", key)).alias("as_source"))


def neighbourhood(results: DataFrame, name: str) -> DataFrame:
    """(side, node): the tables that feed a table, and those that it feeds. One pass over the results."""
    key = name.strip().lower()
    side = lambda which, node: F.struct(F.lit(which).alias("side"), node.alias("node"))
    none = F.array().cast("array<struct<side: string, node: string>>")
    up = F.when(F.col("target") == key, F.transform("sources", lambda s: side("up", s)))
    down = F.when(F.array_contains("sources", key), F.array(side("down", F.col("target"))))
    # outer: else a filter on the list would be pushed down and evaluate the lineage once more
    found = results.select(F.explode_outer(F.concat(F.coalesce(up, none), F.coalesce(down, none))).alias("f"))
    return found.filter("f IS NOT NULL").select("f.side", "f.node").distinct()


def first_of_sides(around: DataFrame, most: int = 15) -> DataFrame:
    """(side, position, node): the first by name of each side, and '...' after them where there are more.

    Ranks up to a limit: each task keeps no more rows of a side than are shown.
    """
    place = F.row_number().over(Window.partitionBy("side").orderBy("node"))
    placed = around.withColumn("position", place).filter(F.col("position") <= most + 1)  # a limit for display
    position = F.col("position").cast("long").alias("position")
    return placed.select("side", position, F.when(F.col("position") > most, "...").otherwise(F.col("node")).alias("node"))


def shown_sources(sources, most: int = 10):
    """The first sources joined by commas, and how many more there are."""
    more = F.size(sources) - most
    head = F.array_join(F.slice(sources, 1, most), ", ")
    return F.when(more > 0, F.concat(head, F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(head)


def drawn_sources(sources, most: int = 20):
    """The sources that the picture of one statement has."""
    return F.slice(sources, 1, most)
