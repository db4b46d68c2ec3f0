"""Queries of the session's store and of what its pages show."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.sqltext import preview
from weftline.operators import lineage as ops
from weftline.operators import store as st
from weftline.queries import base as b
from weftline.queries.base import D_LINEAGE, PREFIX, query
from weftline.queries.extraction import D_STATEMENTS, scripts

_PREVIEW = "CASE WHEN length({x}) > 200 THEN substr({x}, 1, 200) || '...' ELSE {x} END"


def results(spark, sf_dir):
    return b.lineage(spark, sf_dir)


@query(f"WITH {D_STATEMENTS} SELECT filename || '#' || CAST(statement_index AS VARCHAR) AS stmt_key FROM statements WHERE statement_index % 2 = 0")
def incremental_new_statements(spark, sf_dir):
    rows = ops.statements(scripts(spark, sf_dir))
    return st.fresh_statements(rows, rows.filter("statement_index % 2 = 1")).select("stmt_key")


@query(f"SELECT doc_id, {_PREVIEW.format(x='text')} AS preview FROM documents")
def query_preview(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


@query(f"""WITH {D_STATEMENTS}, cleaned AS (SELECT filename, statement_index, {b.d_clean('full_sql')} AS c FROM statements), aimed AS (SELECT *, {b.d_target('c')} AS target FROM cleaned)
SELECT filename, statement_index, target, CAST(len({b.d_sources('c', 'target')}) AS BIGINT) AS source_count FROM aimed""")
def overview(spark, sf_dir):
    return st.overview(ops.with_lineage(ops.statements(scripts(spark, sf_dir)), PREFIX, "full_sql"))


@query(f"WITH {D_LINEAGE} SELECT stmt_id FROM lineage WHERE target = 'zx_mart.cust_3'")
def as_target(spark, sf_dir):
    return st.as_target(results(spark, sf_dir), " ZX_mart.cust_3 ").select("stmt_id")


@query(f"WITH {D_LINEAGE} SELECT stmt_id FROM lineage WHERE list_contains(sources, 'zx_mart.cust_3')")
def as_source(spark, sf_dir):
    return st.as_source(results(spark, sf_dir), "zx_mart.cust_3").select("stmt_id")


@query(f"WITH {D_LINEAGE} SELECT count(*) FILTER (target = 'zx_mart.cust_3') AS as_target, count(*) FILTER (list_contains(sources, 'zx_mart.cust_3')) AS as_source FROM lineage")
def lookup_counts(spark, sf_dir):
    return st.lookup_counts(results(spark, sf_dir), "zx_mart.cust_3")


_AROUND = "around AS (SELECT DISTINCT 'up' AS side, unnest(sources) AS node FROM lineage WHERE target = 'zx_mart.cust_3' UNION SELECT 'down', target FROM lineage WHERE list_contains(sources, 'zx_mart.cust_3'))"


@query(f"WITH {D_LINEAGE}, {_AROUND} SELECT side, node FROM around")
def neighbourhood(spark, sf_dir):
    return st.neighbourhood(results(spark, sf_dir), "zx_mart.cust_3")


@query(f"WITH {D_LINEAGE}, {_AROUND}, r AS (SELECT side, node, row_number() OVER (PARTITION BY side ORDER BY node) AS position FROM around) SELECT side, position, CASE WHEN position > 15 THEN '...' ELSE node END AS node FROM r WHERE position <= 16")
def neighbourhood_top15(spark, sf_dir):
    return st.first_of_sides(st.neighbourhood(results(spark, sf_dir), "zx_mart.cust_3"))


_GATHERED = "gathered AS (SELECT target, list_sort(list_distinct(flatten(list(sources)))) AS s FROM lineage GROUP BY target)"


def _gathered(spark, sf_dir):
    """All sources of each target, distinct and sorted; aggregated before they are shuffled."""
    # outer: else a filter on the list would be pushed down and evaluate the lineage once more
    rows = results(spark, sf_dir).select("target", F.explode_outer("sources").alias("s")).filter("s IS NOT NULL")
    return rows.groupBy("target").agg(F.array_sort(F.collect_set("s")).alias("s"))


@query(f"WITH {D_LINEAGE}, {_GATHERED} SELECT target, array_to_string(s[1:10], ', ') || CASE WHEN len(s) > 10 THEN ' and ' || CAST(len(s) - 10 AS VARCHAR) || ' more' ELSE '' END AS shown FROM gathered")
def truncated_sources(spark, sf_dir):
    return _gathered(spark, sf_dir).select("target", st.shown_sources(F.col("s")).alias("shown"))


@query(f"WITH {D_LINEAGE}, {_GATHERED} SELECT target, CAST(len(s[1:20]) AS BIGINT) AS n_drawn, array_to_string(s[1:20], '|') AS drawn FROM gathered")
def single_query_graph(spark, sf_dir):
    rows = _gathered(spark, sf_dir).select("target", st.drawn_sources(F.col("s")).alias("d"))
    return rows.select("target", F.size("d").cast("long").alias("n_drawn"), F.array_join("d", "|").alias("drawn"))
