"""Writers: lineage as JSON, and the report of a refinement."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lineage_json(df: DataFrame, target: str = "target", sources: str = "sources") -> DataFrame:
    """df with a column json of each record."""
    return df.withColumn("json", F.to_json(F.struct(F.col(target).alias("target"), F.col(sources).alias("sources")), {"ignoreNullFields": "false"}))


def write_lineage(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lineage records as JSON lines."""
    df.select("target", "sources").write.mode(mode).option("ignoreNullFields", "false").json(path)


def refinement_reports(results: DataFrame, sample: int = 200) -> DataFrame:
    """A report (JSON) for each refined statement: key, analysis, validation, stats and samples of both texts."""
    cut = lambda c: F.when(F.length(c) > sample, F.concat(F.substring(c, 1, sample), F.lit("..."))).otherwise(F.col(c))
    body = F.struct(
        F.struct("input_hash", "success", "from_cache", "processing_time").alias("metadata"), F.struct("length_chars", "length_lines", "issues", "complexity").alias("analysis"),
        "validation", "stats", F.struct(cut("sql").alias("original"), cut("refined_sql").alias("refined")).alias("samples"),
    )
    return results.select("input_hash", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def save_report(results: DataFrame, path: str) -> bool:
    """Writes the first result's report to a file of the driver; false, and no exception, if that fails."""
    try:
        row = refinement_reports(results).first()
        report = json.loads(row["report"]) | {"saved_at": datetime.now(timezone.utc).isoformat()}
        with open(path, "w", encoding="utf-8") as f:
            f.write(json.dumps(report, ensure_ascii=False, indent=2))
        return True
    except Exception:  # reports are a convenience: losing one doesn't stop the work
        return False
