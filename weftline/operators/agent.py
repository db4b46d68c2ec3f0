"""Improving an extraction prompt: validate, reflect, and again, a bounded number of times; one job a round."""

from __future__ import annotations

import asyncio
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.checks import comprehensive, error_report
from weftline.functions.responses import clean_reflection, placeholder_prompt
from weftline.operators.model import Client, LineageExtractor

MOST_ROUNDS = 5
LEAST_PROMPT = 50
FALLBACK = "\n\nIMPORTANT: the errors shown above must not occur again. Give valid JSON: 'target' is a string, 'sources' a list of strings."
REFLECT = "A prompt for reading lineage out of SQL did badly.\n\nPrompt:\n{prompt}\n\nSQL:\n{sql}\n\nWhat happened:\n{errors}\n\nWrite a better prompt (attempt {round}). Give the prompt alone."
#: Few-shots for the advanced agent: what was wrong, and what helped.
SHOTS = (
    ("an alias was listed as a source", "Say that aliases and CTE names are no tables."),
    ("the target was among the sources", "Say that the written table is left out of the sources."),
    ("a name had no schema", "Ask for schema.table throughout."),
)


def f1_of(validation: dict) -> float | None:
    """The F1 of a validation; None without metrics."""
    return validation["metrics"]["f1_score"] if "metrics" in validation else None


def best_prompt(history: DataFrame, run: str = "run_id") -> DataFrame:
    """The first best of each run's successes: run, iteration_found (0 if none), f1_score (-1 if none), is_perfect.

    history: run, iteration from 1, status, f1 (null without metrics).
    """
    scored = (F.col("status") == "SUCCESS") & F.col("f1").isNotNull()
    best = F.max(F.when(scored, F.struct(F.col("f1").alias("f1"), (-F.col("iteration")).alias("at"))))
    rows = history.groupBy(run).agg(best.alias("b"))
    f1 = F.coalesce("b.f1", F.lit(-1.0))
    return rows.select(run, F.coalesce(-F.col("b.at"), F.lit(0)).cast("long").alias("iteration_found"), f1.alias("f1_score"), (f1 >= 1).alias("is_perfect"))


@dataclass
class PromptOptimiser:
    """validate -> (unless good) reflect -> validate ..., with an extractor and a client that writes prompts."""

    spark: SparkSession
    extractor: LineageExtractor
    reflect: Client
    max_iterations: int = MOST_ROUNDS
    few_shots: bool = False
    tries: int = 3
    wait: Callable[[int], float] = lambda k: 2 * (k + 1)
    log: list[dict] = field(default_factory=list)

    def _text(self, column, value: str) -> str:
        return self.spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("v")).first()["v"]

    def validate(self, prompt: str, sql: str, expected: list[str] | None = None) -> dict:
        """Status, kind of failure, message, result, metrics and the report on them, of one extraction with the prompt."""
        asked = replace(self.extractor, prompt=self._text(placeholder_prompt, prompt), max_retries=self.tries, wait=self.wait, last_wait=False)
        row = asked.extract(self.spark.createDataFrame([(sql,)], "sql string"))
        wanted = F.lit(None).cast("array<string>") if expected is None else F.array(*map(F.lit, expected)).cast("array<string>")
        v = row.withColumn("v", comprehensive(F.col("target"), F.col("sources"), wanted))
        report = error_report(F.col("v.status"), F.col("v.validation_type"), F.col("v.message"), F.col("v.metrics"), F.col("error"), F.col("target"), F.col("sources"))
        r = v.select("target", "sources", "error", "v", report.alias("report")).first()
        out = {"status": r["v"]["status"], "validation_type": r["v"]["validation_type"], "message": r["v"]["message"], "result": {"target": r["target"], "sources": r["sources"]}, "report": r["report"]}
        if r["error"] is not None:
            out["result"]["error"] = r["error"]
        if r["v"]["metrics"] is not None:
            out["metrics"] = r["v"]["metrics"].asDict()
        return out

    def improve(self, prompt: str, sql: str, validation: dict, round_: int) -> str:
        """A better prompt from the reflecting client; the old one with a warning where that fails or says little."""
        asked = REFLECT.format(prompt=prompt, sql=sql, errors=validation["report"], round=round_)
        if self.few_shots:
            asked += "\n\nEarlier cases:\n" + "\n".join(f"- {was}: {better}" for was, better in SHOTS)
        try:
            better = self._text(clean_reflection, self.reflect(asked))
        except Exception:  # a client that fails is one of the cases
            better = ""
        return better if len(better) >= (1 if self.few_shots else LEAST_PROMPT) else prompt + FALLBACK

    def optimise(self, sql: str, initial_prompt: str, expected: list[str] | None = None, output_file: str | None = None) -> dict:
        most = min(self.max_iterations, MOST_ROUNDS)
        prompts, history, done = [initial_prompt], [], 0
        while True:
            v = self.validate(prompts[-1], sql, expected)
            history.append(v)
            perfect = (f1_of(v) or 0) >= 1
            more = v["status"] == "FAILED" or (expected is not None and not perfect) or (expected is None and done < most - 1)
            if not more or done >= most:
                break
            prompts.append(self.improve(prompts[-1], sql, v, done + 1))
            done += 1
        rows = [(1, i + 1, v["status"], f1_of(v)) for i, v in enumerate(history)]
        best = best_prompt(self.spark.createDataFrame(rows, "run_id int, iteration int, status string, f1 double")).first()
        result = {
            "optimized_prompt": prompts[max(best["iteration_found"], 1) - 1], "initial_prompt": initial_prompt, "f1_score": best["f1_score"], "is_perfect": best["is_perfect"],
            "iterations": done, "iteration_found": best["iteration_found"], "final_validation": history[-1], "all_prompts": prompts[1:], "validation_history": history,
        }
        if output_file:
            save_history(result, output_file, sql, expected)
        return result

    async def optimise_async(self, *args, **kwargs) -> dict:
        return await asyncio.to_thread(self.optimise, *args, **kwargs)


def save_history(result: dict, path: str, sql: str, expected: list[str] | None, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> None:
    """The run as JSON: what was asked, what came out, and prompt and validation of each round."""
    used = [result["initial_prompt"], *result["all_prompts"]]
    rounds = [{"iteration": i + 1, "prompt": used[i] if i < len(used) else "", "validation": v} for i, v in enumerate(result["validation_history"])]
    whole = dict(timestamp=now().isoformat(), optimization_result=result, iteration_details=rounds, expected_result=expected, sql=sql)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(whole, f, indent=2)


def iteration_numbers(events: DataFrame, run: str, order: list[str]) -> DataFrame:
    """events with an iteration from 1 within each run. Runs are short: at most MOST_ROUNDS in a session."""
    return events.withColumn("iteration", F.row_number().over(Window.partitionBy(run).orderBy(*order)))
