"""Ranks within keys that stay distributed: no key's rows come together in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.shared import stored


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """df with a number from 1 within keys, by the order columns.

    Rows are range-partitioned by keys and order; each numbers its part, from where the parts before it end.
    The sums of parts are small: at most as many rows as partitions and keys together.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, rows, start = (free_name(df, name) for name in ("part", "rows", "start"))
    parts = stored(df.repartitionByRange(n, *keys, *order).withColumn(part, F.spark_partition_id()), "ranked")
    counts = parts.groupBy(*keys, part).agg(F.count("*").alias(rows))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(start, F.coalesce(F.sum(rows).over(before), F.lit(0))).drop(rows)
    own = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))
    return parts.withColumn(rank, own).join(starts, [*keys, part]).withColumn(rank, (F.col(rank) + F.col(start)).cast("long")).drop(part, start)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one made from it that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
