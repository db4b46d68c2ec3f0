"""Analysis of SQL, prompts that ask a model to refine it, and what is kept of the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import sqltext as s
from weftline.functions.checks import preserved
from weftline.functions.responses import refined_sql

TEMPLATE = (
    "Rewrite this SQL so that it reads well. Indent by four spaces, drop casts of literals and needless parentheses.\n"
    "Every join, filter, union, branch and null check must keep its meaning. Answer with the SQL alone."
)


def with_analysis(df: DataFrame, model: str, temperature: float, sql: str = "sql") -> DataFrame:
    """df with input_hash, length_chars, length_lines, issues and complexity of its statements."""
    c = F.col(sql)
    return df.select(
        "*", s.fingerprint(c, model, temperature).alias("input_hash"), F.length(c).cast("long").alias("length_chars"), s.line_count(c).alias("length_lines"),
        s.lint(c).alias("issues"), s.complexity(c).alias("complexity"),
    )


def refine_prompt(sql, issues, complexity, max_tokens: int, template: str = TEMPLATE):
    """The prompt for a statement: cut at twice max_tokens characters, with its issues and counts."""
    cut = F.when(F.length(sql) > 2 * max_tokens, F.concat(F.substring(sql, 1, 2 * max_tokens), F.lit("\n-- [TRUNCATED DUE TO LENGTH]"))).otherwise(sql)
    listed = F.array_join(F.transform(issues, lambda i: F.concat(F.lit("- "), i["type"], F.lit(" (count: "), i["count"].cast("string"), F.lit(")"))), "\n")
    found = F.when(F.size(issues) > 0, F.concat(F.lit("\nIssues identified:\n"), listed)).otherwise("")
    names = (("Subqueries", "subqueries"), ("JOINs", "joins"), ("CASE statements", "case_statements"), ("UNION operations", "unions"))
    counts = F.concat_ws("\n", *(F.concat(F.lit(f"- {label}: "), complexity[k].cast("string")) for label, k in names))
    return F.concat(F.lit(template + "\n\nContext:"), found, F.lit("\n\nComplexity metrics:\n"), counts, F.lit("\n\nSQL TO REFINE:\n"), cut)


def row_stats(original, refined, issues):
    """Lengths, their ratio (1 for empty input), tokens estimated at four characters, and issues."""
    a, b = F.length(original), F.length(refined)
    return F.struct(
        a.cast("long").alias("original_length"), b.cast("long").alias("refined_length"),
        F.when(a > 0, b / F.greatest(a, F.lit(1))).otherwise(1.0).alias("length_ratio"),
        F.floor(a / 4).cast("long").alias("estimated_tokens"), F.size(issues).cast("long").alias("issue_count"),
    )


def cache_misses(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows to refine: one for each input_hash that the cache lacks."""
    return df.join(cache.select("input_hash").distinct(), "input_hash", "left_anti").dropDuplicates(["input_hash"]).select(df.columns)


def session_stats(results: DataFrame) -> DataFrame:
    """One row over (success, processing_time, estimated_tokens): totals, success rate, averages."""
    ok = F.col("success")
    n = F.count("*")
    each = lambda total, places: F.when(n > 0, F.bround(total / F.greatest(n, F.lit(1)), places)).otherwise(0.0)
    tokens, seconds = F.coalesce(F.sum("estimated_tokens"), F.lit(0)), F.coalesce(F.sum("processing_time"), F.lit(0.0))
    return results.agg(
        n.alias("total_requests"), F.count_if(ok).alias("successful_requests"), F.count_if(~ok).alias("failed_requests"),
        tokens.cast("long").alias("total_tokens"), seconds.alias("total_time"),
        each(100 * F.count_if(ok).cast("double"), 2).alias("success_rate"), each(seconds, 2).alias("average_time"), each(tokens, 1).alias("average_tokens"),
    )


class Refiner:
    """Refines statements through a backend, with a cache table of successes at cache_path.

    Hits aren't sent again and don't count as requests. The answers are written before they are read on, so that
    nothing asks the model twice. A call is given up after timeout seconds; delay_between is the pause between the
    calls of a partition.
    """

    def __init__(self, spark, backend, cache_path: str, model: str = "model", temperature: float = 0.1, max_tokens: int = 4096, max_retries: int = 3, retry_delay: float = 2.0, timeout: float | None = 120.0, delay_between: float = 1.0) -> None:
        self.spark, self.backend, self.cache_path = spark, backend, cache_path
        self.model, self.temperature, self.max_tokens = model, temperature, max_tokens
        self.max_retries, self.retry_delay = max_retries, retry_delay
        self.timeout, self.delay_between = timeout, delay_between

    def _cache(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.cache_path)
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        schema = "input_hash string, response string, processing_time double"
        return self.spark.read.schema(schema).parquet(self.cache_path) if there else self.spark.createDataFrame([], schema)

    def refine(self, df: DataFrame, use_cache: bool = True, sql: str = "sql") -> DataFrame:
        """df with refined_sql, validation, stats, success, error, processing_time and from_cache."""
        from weftline.operators.model import respond
        from weftline.sources.shared import stored

        seen = stored(with_analysis(df, self.model, self.temperature, sql), "analysed")
        cache = self._cache()
        asked = cache_misses(seen, cache) if use_cache else seen.dropDuplicates(["input_hash"])
        prompts = asked.select("input_hash", refine_prompt(F.col(sql), F.col("issues"), F.col("complexity"), self.max_tokens).alias("prompt"))
        answers = stored(respond(prompts, self.backend, self.max_retries, lambda k, d=self.retry_delay: d * 2**k, last_wait=False, timeout=self.timeout, delay=self.delay_between), "answers")
        fresh = answers.filter("error IS NULL").select("input_hash", "response", "processing_time")
        old = stored(cache.withColumn("from_cache", F.lit(True)), "cache") if use_cache else None
        known = answers.select("input_hash", "response", "error", "processing_time").withColumn("from_cache", F.lit(False))
        if old is not None:
            known = known.unionByName(old.withColumn("error", F.lit(None).cast("string")))
        out = seen.join(known.dropDuplicates(["input_hash"]), "input_hash", "left").withColumn("refined_sql", refined_sql(F.col("response")))
        fresh.write.mode("append").parquet(self.cache_path)
        good = F.col("error").isNull() & F.col("response").isNotNull()
        return out.withColumn("validation", F.when(good, preserved(F.col(sql), F.col("refined_sql")))).withColumn(
            "stats", F.when(good, row_stats(F.col(sql), F.col("refined_sql"), F.col("issues")))
        ).withColumn("success", good).drop("response")

    def clear_cache(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.cache_path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
