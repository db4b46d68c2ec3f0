"""Statements and the lineage that patterns find in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import sqltext as s


def statements(scripts: DataFrame, quoted: bool = False) -> DataFrame:
    """Scripts (filename, content) to statements: filename, statement_index from 1, full_sql, query_preview, stmt_key.

    stmt_key has the script's path where the scripts have one (column path), since files of several folders may share
    a name, and its filename otherwise. quoted: semicolons in literals, quoted names and comments don't end a statement, and each statement keeps its own.
    """
    split = s.split_statements_quoted if quoted else s.split_statements
    place = F.coalesce("path", "filename") if "path" in scripts.columns else F.col("filename")
    rows = scripts.select("filename", place.alias("place"), F.posexplode(split(F.col("content"))).alias("at", "full_sql"))
    index = F.col("at") + 1
    return rows.select(
        "filename", index.alias("statement_index"), "full_sql", s.preview(F.col("full_sql")).alias("query_preview"),
        F.concat("place", F.lit("#"), index.cast("string")).alias("stmt_key"),
    )


def with_lineage(df: DataFrame, prefix: str, sql: str = "sql") -> DataFrame:
    """df with target and sources of each statement. No shuffle: expressions over one column.

    Null statements have a null target and null sources.
    """
    found = df.withColumn("_lineage", s.lineage_of(F.col(sql), prefix))
    return found.select(*(f"`{c}`" for c in df.columns), "_lineage.target", "_lineage.sources")


def source_frequency(df: DataFrame, id_col: str) -> DataFrame:
    """How many statements read each source: source, n_statements. Aggregated before it is shuffled."""
    # outer: else a filter on the list would be pushed down and evaluate the lineage once more
    rows = df.select(F.col(id_col).alias("id"), F.explode_outer("sources").alias("source")).filter("source IS NOT NULL").distinct()
    return rows.groupBy("source").agg(F.count("*").alias("n_statements"))


def edges_of(df: DataFrame, seq: str) -> DataFrame:
    """Lineage rows to edges (seq, src, tgt): parallel ones are one, with the seq of the first."""
    rows = df.select(F.col(seq).alias("row"), F.posexplode_outer("sources").alias("at", "src"), F.col("target").alias("tgt")).filter("src IS NOT NULL")
    first = rows.groupBy("src", "tgt").agg(F.min(F.struct("row", "at")).alias("first"))
    return first.select("first.row", "first.at", "src", "tgt")


def add_source(sources, name):
    """A list of sources with one more at its end, unless it is empty, null or there already."""
    return F.when(F.coalesce(name, F.lit("")) == "", sources).otherwise(F.array_union(sources, F.array(name)))
