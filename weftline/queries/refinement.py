"""Queries of SQL analysis, refinement and the preservation of structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import checks
from weftline.functions import sqltext as s
from weftline.functions.responses import refined_sql
from weftline.operators import refinement as r
from weftline.queries import base as b
from weftline.queries.base import D_CORPUS, query


def d_count(x: str, word: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, '{word}', ''))) // {len(word)} AS BIGINT)"


_COUNTS = {k: d_count("upper(sql)", w) for k, w in s.COMPLEXITY.items()}
_COUNTS["subqueries"] = f"greatest({_COUNTS['subqueries']} - 1, 0)"


@query(f"WITH {D_CORPUS} SELECT stmt_id, md5(sql || '_stub_0.1') AS input_hash FROM corpus")
def sql_fingerprint(spark, sf_dir):
    return b.corpus(spark, sf_dir).select("stmt_id", s.fingerprint(F.col("sql"), "stub", 0.1).alias("input_hash"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS length_chars, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS length_lines FROM documents")
def sql_lengths(spark, sf_dir):
    text = F.col("text")
    return b.table(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("long").alias("length_chars"), s.line_count(text).alias("length_lines"))


@query(f"WITH {D_CORPUS} SELECT stmt_id, {', '.join(f'{v} AS {k}' for k, v in _COUNTS.items())} FROM corpus")
def complexity_counts(spark, sf_dir):
    return b.corpus(spark, sf_dir).select("stmt_id", s.complexity(F.col("sql")).alias("c")).select("stmt_id", "c.*")


_LINT = "[" + ", ".join(f"""{{'type': '{name}', 'found': regexp_extract_all(sql, '{pattern.replace("'", "''")}', {group})}}""" for name, pattern, group in s.LINT) + "]"


@query(f"""WITH {D_CORPUS}, found AS (SELECT stmt_id, unnest({_LINT}) AS i FROM corpus)
SELECT stmt_id, i.type AS type, CAST(len(i.found) AS BIGINT) AS count, array_to_string(i.found[1:2], '|') AS examples FROM found WHERE len(i.found) > 0""")
def lint_issues(spark, sf_dir):
    rows = b.corpus(spark, sf_dir).select("stmt_id", F.explode(s.lint(F.col("sql"))).alias("i"))
    return rows.select("stmt_id", "i.type", "i.count", F.array_join("i.examples", "|").alias("examples"))


_ISSUES = f"""list_filter(list_transform({_LINT}, lambda i: {{'type': i.type, 'n': len(i.found)}}), lambda i: i.n > 0)"""


@query(f"""WITH {D_CORPUS}, a AS (SELECT stmt_id, sql, {_ISSUES} AS issues FROM corpus) SELECT stmt_id,
'T' || chr(10) || chr(10) || 'Context:' || CASE WHEN len(issues) > 0 THEN chr(10) || 'Issues identified:' || chr(10) || array_to_string(list_transform(issues, lambda i: '- ' || i.type || ' (count: ' || CAST(i.n AS VARCHAR) || ')'), chr(10)) ELSE '' END
|| chr(10) || chr(10) || 'Complexity metrics:' || chr(10) || '- Subqueries: ' || CAST({_COUNTS['subqueries']} AS VARCHAR) || chr(10) || '- JOINs: ' || CAST({_COUNTS['joins']} AS VARCHAR) || chr(10)
|| '- CASE statements: ' || CAST({_COUNTS['case_statements']} AS VARCHAR) || chr(10) || '- UNION operations: ' || CAST({_COUNTS['unions']} AS VARCHAR) || chr(10) || chr(10) || 'SQL TO REFINE:' || chr(10)
|| CASE WHEN length(sql) > 300 THEN substr(sql, 1, 300) || chr(10) || '-- [TRUNCATED DUE TO LENGTH]' ELSE sql END AS prompt FROM a""")
def refine_prompt(spark, sf_dir):
    rows = b.corpus(spark, sf_dir).select("stmt_id", "sql", s.lint(F.col("sql")).alias("issues"), s.complexity(F.col("sql")).alias("c"))
    return rows.select("stmt_id", r.refine_prompt(F.col("sql"), F.col("issues"), F.col("c"), 150, "T").alias("prompt"))


_ANSWER = """CASE stmt_id % 4 WHEN 0 THEN 'Here is it:' || chr(10) || '```sql' || chr(10) || sql || chr(10) || '```' || chr(10) || 'Done.' WHEN 1 THEN '```' || chr(10) || sql || chr(10) || '```'
WHEN 2 THEN 'The refined SQL:' || chr(10) || sql || chr(10) || '  Output: above' ELSE sql || ';' END"""
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_REST = "array_to_string(list_filter(string_split(" + _STRIP.format("answer") + ", chr(10)), lambda x: NOT regexp_matches(lower(trim(x)), '^(output:|refined:|refined sql|the refined|here is|following is|i have|```)')), chr(10))"
_REST = _STRIP.format(_REST)


@query(f"""WITH {D_CORPUS}, answers AS (SELECT stmt_id, {_ANSWER} AS answer FROM corpus) SELECT stmt_id,
CASE WHEN contains(answer, '```sql') THEN {_STRIP.format("regexp_extract(answer, '```sql\\s*\\n(.*?)\\n```', 1, 's')")} WHEN contains(answer, '```') THEN {_STRIP.format("regexp_extract(answer, '```\\s*\\n(.*?)\\n```', 1, 's')")}
WHEN {_REST} <> '' AND NOT ends_with({_REST}, ';') THEN {_REST} || ';' ELSE {_REST} END AS refined FROM answers""")
def extract_refined_sql(spark, sf_dir):
    answers = b.corpus(spark, sf_dir).selectExpr("stmt_id", f"{_ANSWER} AS answer")
    return answers.select("stmt_id", refined_sql(F.col("answer")).alias("refined"))


#: Refined statements: casts go; every sixth loses a FROM, every ninth a JOIN.
_REFINED = "CASE WHEN stmt_id % 6 = 0 THEN replace({x}, 'FROM ', ' ') WHEN stmt_id % 9 = 1 THEN replace({x}, 'JOIN ', ', ') ELSE {x} END"
D_PAIRS = D_CORPUS + ", pairs AS (SELECT stmt_id, sql AS original, " + _REFINED.format(x=r"regexp_replace(sql, '::\w+', '', 'g')") + " AS refined FROM corpus)"


def pairs(spark, sf_dir):
    rows = b.corpus(spark, sf_dir).withColumn("x", s.strip_casts(F.col("sql")))
    return rows.selectExpr("stmt_id", "sql AS original", f"{_REFINED.format(x='x')} AS refined")


def _both(word: str) -> tuple[str, str]:
    return d_count("upper(original)", word), d_count("upper(refined)", word)


_CRITICAL = (("UNION ALL", "UNION ALL operations"), ("SELECT", "SELECT statements"), ("INSERT INTO", "INSERT operations"), ("FROM", "FROM clauses"))
_SOFTER = (("JOIN", "JOIN operations"), ("CASE", "CASE statements"), ("COALESCE", "COALESCE functions"), ("WHERE", "WHERE clauses"))
_CHANGED = "'{what} count changed: ' || CAST({x} AS VARCHAR) || ' -> ' || CAST({y} AS VARCHAR)"
_ERROR = "CASE " + " ".join(f"WHEN {_both(w)[0]} <> {_both(w)[1]} THEN " + _CHANGED.format(what=t, x=_both(w)[0], y=_both(w)[1]) for w, t in _CRITICAL) + " END"
_WARN = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_both(w)[0]} <> {_both(w)[1]} THEN " + _CHANGED.format(what=t, x=_both(w)[0], y=_both(w)[1]) + " END" for w, t in _SOFTER) + "], lambda x: x IS NOT NULL), '; ')"
_DONE = "CASE " + " ".join(f"WHEN {_both(w)[0]} <> {_both(w)[1]} THEN {i + 1}" for i, (w, _) in enumerate(_CRITICAL)) + " ELSE 4 END"


@query(f"WITH {D_PAIRS} SELECT stmt_id, {_ERROR} IS NULL AS passed, {_ERROR} AS error, CAST({_DONE} AS BIGINT) AS n_checked FROM pairs")
def critical_checks(spark, sf_dir):
    v = pairs(spark, sf_dir).select("stmt_id", checks.preserved(F.col("original"), F.col("refined")).alias("v"))
    return v.select("stmt_id", "v.passed", "v.error", F.size("v.critical_checks").cast("long").alias("n_checked"))


@query(f"WITH {D_PAIRS} SELECT stmt_id, CASE WHEN {_ERROR} IS NULL THEN {_WARN} ELSE '' END AS warnings FROM pairs")
def warning_checks(spark, sf_dir):
    v = pairs(spark, sf_dir).select("stmt_id", checks.preserved(F.col("original"), F.col("refined")).alias("v"))
    return v.select("stmt_id", F.array_join("v.warnings", "; ").alias("warnings"))


_STATS = f"""SELECT stmt_id, CAST(length(original) AS BIGINT) AS original_length, CAST(length(refined) AS BIGINT) AS refined_length,
round(length(refined) / CAST(length(original) AS DOUBLE), 6) AS length_ratio, CAST(length(original) // 4 AS BIGINT) AS estimated_tokens,
CAST(len({_ISSUES.replace("(sql,", "(original,")}) AS BIGINT) AS issue_count, {_ERROR} IS NULL AS success FROM pairs"""


def _stats(spark, sf_dir):
    v = pairs(spark, sf_dir)
    stats = r.row_stats(F.col("original"), F.col("refined"), s.lint(F.col("original")))
    return v.select("stmt_id", stats.alias("s"), checks.keeps_structure(F.col("original"), F.col("refined")).alias("success")).select("stmt_id", "s.*", "success")


@query(f"WITH {D_PAIRS} {_STATS}")
def refine_stats(spark, sf_dir):
    return _stats(spark, sf_dir).withColumn("length_ratio", F.round("length_ratio", 6))


@query(f"""WITH {D_PAIRS}, s AS ({_STATS}) SELECT count(*) AS total_requests, count(*) FILTER (success) AS successful_requests, count(*) FILTER (NOT success) AS failed_requests,
CAST(sum(estimated_tokens) AS BIGINT) AS total_tokens, round(sum(stmt_id % 8) / 8.0, 6) AS total_time, round_even(100.0 * count(*) FILTER (success) / count(*), 2) AS success_rate,
round_even(sum(stmt_id % 8) / 8.0 / count(*), 2) AS average_time, round_even(CAST(sum(estimated_tokens) AS DOUBLE) / count(*), 1) AS average_tokens FROM s""")
def session_stats(spark, sf_dir):
    rows = _stats(spark, sf_dir).withColumn("processing_time", (F.col("stmt_id") % 8) / 8)
    return r.session_stats(rows).withColumn("total_time", F.round("total_time", 6))


@query(f"WITH {D_CORPUS}, h AS (SELECT DISTINCT md5(sql || '_stub_0.1') AS input_hash FROM corpus), cache AS (SELECT md5(sql || '_stub_0.1') AS input_hash FROM corpus WHERE stmt_id % 3 = 0) SELECT input_hash FROM h WHERE input_hash NOT IN (SELECT input_hash FROM cache)")
def refine_cache_misses(spark, sf_dir):
    rows = b.corpus(spark, sf_dir).withColumn("input_hash", s.fingerprint(F.col("sql"), "stub", 0.1))
    return r.cache_misses(rows, rows.filter("stmt_id % 3 = 0")).select("input_hash")


@query(f"WITH {D_PAIRS}, s AS ({_STATS}) SELECT round(100.0 * avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 4) AS success_percent FROM s")
def batch_success_rate(spark, sf_dir):
    return _stats(spark, sf_dir).agg(F.round(100 * F.avg(F.col("success").cast("double")), 4).alias("success_percent"))


@query(f"""WITH {D_PAIRS} SELECT stmt_id, CASE WHEN length(original) > 200 THEN substr(original, 1, 200) || '...' ELSE original END AS sample, CAST(length(original) AS VARCHAR) AS original_length,
CASE WHEN {_ERROR} IS NULL THEN 'true' ELSE 'false' END AS passed, {_COUNTS['joins'].replace('upper(sql)', 'upper(original)')} AS joins FROM pairs""")
def refinement_report(spark, sf_dir):
    from weftline.sources.export import refinement_reports

    rows = r.with_analysis(pairs(spark, sf_dir).withColumnRenamed("original", "sql"), "stub", 0.1).withColumnRenamed("refined", "refined_sql")
    rows = rows.withColumn("input_hash", F.col("stmt_id").cast("string")).withColumn("validation", checks.preserved(F.col("sql"), F.col("refined_sql")))
    rows = rows.withColumn("stats", r.row_stats(F.col("sql"), F.col("refined_sql"), F.col("issues")))
    rows = rows.withColumns({"success": F.lit(True), "from_cache": F.lit(False), "processing_time": F.lit(0.0)})
    # read once, whatever is asked of it
    said = "samples struct<original: string>, stats struct<original_length: string>, validation struct<passed: string>, analysis struct<complexity: struct<joins: bigint>>"
    report = refinement_reports(rows).select(F.col("input_hash").cast("long").alias("stmt_id"), F.from_json("report", said).alias("r"))
    return report.select("stmt_id", F.col("r.samples.original").alias("sample"), "r.stats.original_length", "r.validation.passed", "r.analysis.complexity.joins")
