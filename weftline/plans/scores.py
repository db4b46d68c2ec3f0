"""The scoring program: statements of a view catalogue, lineage by patterns against that of a model, and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import scoring
from weftline.operators.lineage import with_lineage
from weftline.operators.model import LineageExtractor
from weftline.sources.files import view_statements
from weftline.sources.shared import stored


@dataclass
class Scores:
    validated: DataFrame
    by_table: DataFrame
    mean_f1: DataFrame
    pivot: DataFrame
    success: DataFrame


def score_catalogue(catalogue: DataFrame, extractor: LineageExtractor, schema: str, prefix: str) -> Scores:
    """Scores of the extractor on all views; rows keep the catalogue's order by seq."""
    rows = view_statements(catalogue, schema).filter("sql IS NOT NULL").withColumn("seq", F.monotonically_increasing_id())
    truth = stored(with_lineage(rows, prefix).withColumnsRenamed({"target": "true_target", "sources": "expected"}), "expected")
    found = extractor.extract(truth).withColumnRenamed("sources", "actual")
    validated = stored(scoring.validate(found), "validated")
    by_table = scoring.f1_by_table(validated, "table_name", "seq")
    return Scores(validated, by_table, scoring.mean_f1(by_table), scoring.status_pivot(validated), scoring.success_metrics(validated))


def compare_extractors(catalogue: DataFrame, extractors: dict[str, LineageExtractor], schema: str, prefix: str) -> DataFrame:
    """Success rate and mean F1 of several prompts or models on the same views."""
    every = None
    for name, extractor in extractors.items():
        v = score_catalogue(catalogue, extractor, schema, prefix).validated.withColumn("prompt_id", F.lit(name))
        every = v if every is None else every.unionByName(v)
    return scoring.compare_prompts(every, "prompt_id")
