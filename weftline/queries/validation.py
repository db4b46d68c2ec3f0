"""Queries of the checks of lineage records and of the scores over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import checks as c
from weftline.operators import scoring
from weftline.queries import base as b
from weftline.queries.base import d_spoilt, query

_FAULT = """CASE WHEN len(string_split({x}, '.')) <> 2 THEN '{k} ''' || {x} || ''' should be fully qualified (schema.table)'
WHEN split_part({x}, '.', 1) = '' OR split_part({x}, '.', 2) = '' THEN '{k} ''' || {x} || ''' has missing schema or table name' END"""
_TARGET = f"CASE WHEN coalesce(target, '') = '' THEN 'Target cannot be empty' ELSE {_FAULT.format(x='target', k='Target')} END"
_SOURCES = f"array_to_string(list_filter(list_transform(actual, lambda x: {_FAULT.format(x='x', k='Source')}), lambda e: e IS NOT NULL), '; ')"
_DERIVED = r"""array_to_string(list_concat(
list_transform(list_filter(actual, lambda x: regexp_matches(lower(x), '^((t|subquery|cte)_\d+|.*_alias)$') OR lower(x) IN ('t1', 't2', 'subquery', 'derived')), lambda x: 'Derived table detected: ' || x),
CASE WHEN target <> '' AND list_contains(actual, target) THEN ['Target ''' || target || ''' should not appear in sources'] ELSE [] END), '; ')"""
_AGAIN = "list_filter(list_transform(range(1, len(actual) + 1), lambda i: CASE WHEN list_contains(list_transform(actual[1:i-1], lambda y: lower(y)), lower(actual[i])) THEN actual[i] END), lambda z: z IS NOT NULL)"
_UNIQUE = f"CASE WHEN len({_AGAIN}) > 0 THEN 'Duplicate sources found: [' || array_to_string(list_transform({_AGAIN}, lambda z: '''' || z || ''''), ', ') || ']' ELSE '' END"
_LOOSE = "array_to_string(list_transform(list_filter(actual, lambda x: NOT contains(x, '.')), lambda x: 'Name ''' || x || ''' is not fully qualified'), '; ')"
_HITS = "len(list_intersect(list_distinct(actual), list_distinct(expected)))"
_P = f"CASE WHEN len(actual) = 0 AND len(expected) = 0 THEN 1.0 WHEN len(actual) > 0 THEN {_HITS} / CAST(len(list_distinct(actual)) AS DOUBLE) ELSE 0.0 END"
_R = f"CASE WHEN len(actual) = 0 AND len(expected) = 0 THEN 1.0 WHEN len(expected) > 0 THEN {_HITS} / CAST(len(list_distinct(expected)) AS DOUBLE) ELSE 0.0 END"
D_VALIDATED = f"""{d_spoilt()}, scored AS (SELECT *, {_P} AS p, {_R} AS r FROM compared),
validated AS (SELECT stmt_id, target, expected, actual, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1_score,
CASE WHEN target IS NULL THEN 'format' WHEN ({_TARGET}) IS NOT NULL THEN 'target' WHEN {_SOURCES} <> '' THEN 'sources' WHEN {_DERIVED} <> '' THEN 'derived_tables'
WHEN {_UNIQUE} <> '' THEN 'uniqueness' WHEN {_LOOSE} <> '' THEN 'qualification' ELSE 'comprehensive' END AS validation_type,
CASE WHEN target IS NULL THEN '''target'' should be a string' WHEN ({_TARGET}) IS NOT NULL THEN {_TARGET} WHEN {_SOURCES} <> '' THEN {_SOURCES} WHEN {_DERIVED} <> '' THEN {_DERIVED}
WHEN {_UNIQUE} <> '' THEN {_UNIQUE} ELSE 'All validations passed' END AS message,
CASE WHEN validation_type = 'comprehensive' THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM scored)"""


def _check(name, make, bad, good):
    @query(f"WITH {d_spoilt()} SELECT stmt_id, coalesce({bad}, '') = '' AS valid, CASE WHEN coalesce({bad}, '') = '' THEN {good} ELSE {bad} END AS message FROM compared")
    def run(spark, sf_dir):
        return b.compared(spark, sf_dir).select("stmt_id", make(F.col("target"), F.col("actual")).alias("v")).select("stmt_id", "v.*")

    b.QUERIES[name] = b.QUERIES.pop("run")
    b.ORACLE_SQL[name] = b.ORACLE_SQL.pop("run")


_check("check_format", c.check_format, "CASE WHEN target IS NULL THEN '''target'' should be a string' END", "'Valid format'")
_check("check_target", lambda t, a: c.check_target(t), _TARGET, "'Valid target name'")
_check("check_sources", lambda t, a: c.check_sources(a), _SOURCES, "CASE WHEN len(actual) = 0 THEN 'No sources (valid case)' ELSE 'All source names valid' END")
_check("check_derived", lambda t, a: c.check_derived(a, t), _DERIVED, "'No derived tables detected'")
_check("check_unique", lambda t, a: c.check_unique(a), _UNIQUE, "'All sources are unique'")
_check("check_qualified", lambda t, a: c.check_qualified(a), _LOOSE, "'All names are fully qualified'")


def validated(spark, sf_dir):
    return scoring.validate(b.compared(spark, sf_dir))


@query(f"WITH {D_VALIDATED} SELECT stmt_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score FROM validated")
def prf1(spark, sf_dir):
    m = b.compared(spark, sf_dir).select("stmt_id", c.prf1(F.col("expected"), F.col("actual")).alias("m")).select("stmt_id", "m.*")
    return m.select("stmt_id", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1_score")))


@query(f"WITH {D_VALIDATED} SELECT stmt_id, status, validation_type, message, CASE WHEN status = 'SUCCESS' THEN round(f1_score, 6) END AS f1_score FROM validated")
def comprehensive_validation(spark, sf_dir):
    return validated(spark, sf_dir).select("stmt_id", "status", "validation_type", "message", F.round("metrics.f1_score", 6).alias("f1_score"))


_BY = "by_table AS (SELECT stmt_id % 500 AS table_id, round(arg_max(CASE WHEN status = 'SUCCESS' THEN f1_score ELSE 0.0 END, stmt_id), 6) AS f1_score FROM validated GROUP BY ALL)"


@query(f"WITH {D_VALIDATED}, {_BY} SELECT * FROM by_table")
def f1_by_table(spark, sf_dir):
    rows = validated(spark, sf_dir).withColumn("table_id", F.col("stmt_id") % 500)
    return scoring.f1_by_table(rows, "table_id", "stmt_id").withColumn("f1_score", F.round("f1_score", 6))


@query(f"WITH {D_VALIDATED}, {_BY} SELECT round(avg(f1_score), 6) AS mean_f1 FROM by_table")
def mean_f1(spark, sf_dir):
    return scoring.mean_f1(f1_by_table(spark, sf_dir)).select(F.round("mean_f1", 6).alias("mean_f1"))


@query(f"""WITH {D_VALIDATED} SELECT status, {', '.join(f"CAST(count(*) FILTER (validation_type = '{k}') AS DOUBLE) AS {k}" for k in scoring.OUTCOMES)} FROM validated GROUP BY status""")
def status_pivot(spark, sf_dir):
    return scoring.status_pivot(validated(spark, sf_dir))


@query(f"WITH {D_VALIDATED} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1_score), 6) AS f1_score FROM validated WHERE status = 'SUCCESS'")
def success_metrics_mean(spark, sf_dir):
    return scoring.success_metrics(validated(spark, sf_dir)).select(*(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1_score")))


@query(f"""WITH {D_VALIDATED} SELECT CAST(stmt_id % 2 AS BIGINT) AS prompt_id, count(*) AS n, round(avg(CASE WHEN status = 'SUCCESS' THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
round(avg(CASE WHEN status = 'SUCCESS' THEN f1_score ELSE 0.0 END), 6) AS mean_f1 FROM validated GROUP BY 1""")
def prompt_ab_compare(spark, sf_dir):
    rows = validated(spark, sf_dir).withColumn("prompt_id", F.col("stmt_id") % 2)
    return scoring.compare_prompts(rows, "prompt_id").select("prompt_id", "n", F.round("success_rate", 6).alias("success_rate"), F.round("mean_f1", 6).alias("mean_f1"))


_SHOWN = "array_to_string(list_transform(actual, lambda x: '''' || x || ''''), ', ')"


@query(f"""WITH {D_VALIDATED} SELECT stmt_id, CASE WHEN status = 'SUCCESS' THEN (CASE WHEN f1_score >= 1 THEN 'PERFECT F1 SCORE = 1.0' ELSE 'SUCCESS with F1 score: ' || printf('%.4f', f1_score) END)
|| chr(10) || 'Precision: ' || printf('%.4f', precision) || ', Recall: ' || printf('%.4f', recall)
ELSE upper(validation_type) || ': ' || message || chr(10) || 'Current extraction: target=''' || coalesce(target, 'N/A') || ''', sources=[' || {_SHOWN} || ']' END AS report FROM validated""")
def format_errors(spark, sf_dir):
    v = validated(spark, sf_dir)
    none = F.lit(None).cast("string")
    report = c.error_report(F.col("status"), F.col("validation_type"), F.col("message"), F.col("metrics"), none, F.col("target"), F.col("actual"))
    return v.select("stmt_id", report.alias("report"))
