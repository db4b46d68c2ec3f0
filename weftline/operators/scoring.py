"""Scores of extracted lineage against expected lineage, and reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.checks import name_lines, outcome, outcome_message, scores, set_sizes, shares


def validate(df: DataFrame, target: str = "target", sources: str = "actual", expected: str | None = "expected") -> DataFrame:
    """df with status, validation_type, message and metrics of its records, as checks.comprehensive gives them.

    What is used often is a column, not bound inside an expression, which would be interpreted row by row. The outcome
    is found first and the rest made of it, so that a column that isn't read costs nothing.
    """
    t, s, kind, good = F.col(target), F.col(sources), F.col("_kind"), F.col("_kind") == "comprehensive"
    kept = [f"`{c}`" for c in df.columns]
    judged = df.withColumn("_lines", name_lines(t, s)).select(*kept, outcome(t, s, F.col("_lines")).alias("_kind"))
    if expected is None:
        metrics = F.lit(None).cast("struct<precision:double,recall:double,f1_score:double>")
    else:
        scored = good & F.col(expected).isNotNull()
        judged = judged.select("*", *(F.when(scored, v).alias(f"_{k}") for k, v in set_sizes(F.col(expected), s).items()))
        metrics = F.when(scored, scores(*shares(F.col("_e"), F.col("_a"), F.col("_hits"))))
    return judged.select(
        *kept, F.when(good, F.lit("SUCCESS")).otherwise("FAILED").alias("status"), kind.alias("validation_type"),
        outcome_message(kind, t, s).alias("message"), metrics.alias("metrics"),
    )


def f1_by_table(validated: DataFrame, table: str, seq: str) -> DataFrame:
    """The F1 of each table's last row by seq; 0 where it failed."""
    f1 = F.coalesce(F.col("metrics.f1_score"), F.lit(0.0))
    return validated.groupBy(table).agg(F.max_by(f1, seq).alias("f1_score"))


def mean_f1(by_table: DataFrame) -> DataFrame:
    return by_table.agg(F.avg("f1_score").alias("mean_f1"))


#: All outcomes, so that the pivot's columns don't depend on the data.
OUTCOMES = ("comprehensive", "derived_tables", "format", "qualification", "sources", "target", "uniqueness")


def status_pivot(validated: DataFrame, outcomes: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """Messages by status and outcome, as doubles, 0 where there is none."""
    wide = validated.groupBy("status").pivot("validation_type", list(outcomes)).agg(F.count("message").cast("double"))
    return wide.na.fill(0.0)


def success_metrics(validated: DataFrame) -> DataFrame:
    """Mean precision, recall and F1 of the successes.

    Only they have metrics, and means skip nulls: a filter on the status would be pushed below the projections and
    evaluate all checks once more.
    """
    return validated.agg(*(F.avg(f"metrics.{c}").alias(c) for c in ("precision", "recall", "f1_score")))


def compare_prompts(validated: DataFrame, prompt: str) -> DataFrame:
    """Success rate and mean F1 by prompt, a failure counting 0."""
    ok = F.col("status") == "SUCCESS"
    return validated.groupBy(prompt).agg(
        F.count("*").alias("n"), F.avg(ok.cast("double")).alias("success_rate"),
        F.avg(F.coalesce("metrics.f1_score", F.lit(0.0))).alias("mean_f1"),
    )
