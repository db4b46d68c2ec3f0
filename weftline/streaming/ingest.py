"""New SQL files as they arrive: statements that aren't stored yet get lineage and are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.lineage import statements, with_lineage
from weftline.operators.store import LineageStore


def script_stream(spark: SparkSession, path: str, pattern: str = "*.{sql,txt}", files_a_batch: int = 1000) -> DataFrame:
    """filename, content of files that appear in a folder."""
    files = spark.readStream.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).option("wholetext", "true").text(path)
    return files.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"))


def ingest(scripts: DataFrame, store: LineageStore, prefix: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts storing the lineage of each batch; a batch that is run again stores nothing twice (keys decide)."""

    def one(batch: DataFrame, _: int) -> None:
        store.add(with_lineage(statements(batch), prefix, "full_sql"))

    writer = scripts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
