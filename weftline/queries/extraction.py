"""Queries of statement preparation and lineage by patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import sqltext as s
from weftline.operators import lineage as ops
from weftline.queries import base as b
from weftline.queries.base import D_CORPUS, D_LINEAGE, OBJECT, PREFIX, d_clean, d_sources, d_target, query

_SCRIPTS = "scripts AS (SELECT 'bucket_' || CAST(bucket AS VARCHAR) AS filename, string_agg(sql, ' ;' || chr(10) ORDER BY stmt_id) || ';; ' AS content FROM corpus GROUP BY bucket)"
_PIECES = "list_filter(list_transform(string_split(content, ';'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
D_STATEMENTS = f"""{D_CORPUS}, {_SCRIPTS}, listed AS (SELECT filename, {_PIECES} AS p FROM scripts),
statements AS (SELECT filename, unnest(p) AS full_sql, CAST(unnest(range(1, len(p) + 1)) AS INT) AS statement_index FROM listed)"""


def scripts(spark, sf_dir):
    return _joined(b.corpus(spark, sf_dir))


def _joined(rows):
    joined = F.expr("listagg(sql, ' ;\n') WITHIN GROUP (ORDER BY stmt_id)")
    return rows.groupBy("bucket").agg(F.concat(joined, F.lit(";; ")).alias("content")).select(F.concat(F.lit("bucket_"), F.col("bucket").cast("string")).alias("filename"), "content")


@query(f"WITH {D_STATEMENTS} SELECT filename, statement_index, full_sql, filename || '#' || CAST(statement_index AS VARCHAR) AS stmt_key FROM statements")
def split_statements(spark, sf_dir):
    return ops.statements(scripts(spark, sf_dir)).select("filename", "statement_index", "full_sql", "stmt_key")


#: The statements with semicolons in their literal and comments, which end nothing.
_WITHIN = """replace(replace(replace(sql, 'zx_lit.decoy', 'zx;lit' || chr(39) || chr(39) || ';s'), 'zx_block.decoy', 'zx;block; -- '), 'zx_line.decoy', 'zx;line /* it' || chr(39) || 's')"""


@query(f"""WITH {D_CORPUS}, placed AS (SELECT bucket, {_WITHIN} AS sql, row_number() OVER (PARTITION BY bucket ORDER BY stmt_id) AS i, count(*) OVER (PARTITION BY bucket) AS n FROM corpus)
SELECT 'bucket_' || CAST(bucket AS VARCHAR) AS filename, CAST(i AS INT) AS statement_index, sql || CASE WHEN i = n THEN ';' ELSE ' ;' END AS full_sql FROM placed""")
def split_statements_quoted(spark, sf_dir):
    rows = b.corpus(spark, sf_dir).withColumn("sql", F.expr(_WITHIN))
    return ops.statements(_joined(rows), quoted=True).select("filename", "statement_index", "full_sql")


def _text(name, column, sql):
    @query(f"WITH {D_CORPUS} SELECT stmt_id, {sql} AS text FROM corpus")
    def run(spark, sf_dir):
        return b.corpus(spark, sf_dir).select("stmt_id", column(F.col("sql")).alias("text"))

    b.QUERIES[name] = b.QUERIES.pop("run")
    b.ORACLE_SQL[name] = b.ORACLE_SQL.pop("run")


_text("strip_literals", s.strip_literals, "regexp_replace(sql, '''.*?''', '', 'gs')")
_text("strip_line_comments", s.strip_line_comments, r"regexp_replace(sql, '--[^\n]*', '', 'g')")
_text("strip_block_comments", s.strip_block_comments, r"regexp_replace(sql, '/\*.*?\*/', '', 'gs')")
_text("strip_casts", s.strip_casts, r"regexp_replace(sql, '::\w+', '', 'g')")
_text("clean_sql", s.clean_sql, d_clean("sql"))


@query(f"WITH {D_CORPUS} SELECT stmt_id, array_to_string(regexp_extract_all({d_clean('sql')}, '{OBJECT}', 1, 'i'), '|') AS matches FROM corpus")
def match_objects(spark, sf_dir):
    return b.corpus(spark, sf_dir).select("stmt_id", F.array_join(s.match_objects(s.clean_sql(F.col("sql")), PREFIX), "|").alias("matches"))


@query(f"WITH {D_CORPUS}, m AS (SELECT stmt_id, unnest(regexp_extract_all(sql, '{OBJECT}', 1, 'i')) AS m FROM corpus) SELECT m AS name, {b.d_valid('m')} AS valid, count(*) AS n FROM m GROUP BY ALL")
def object_validity(spark, sf_dir):
    found = b.corpus(spark, sf_dir).select(F.explode(s.match_objects(F.col("sql"), PREFIX)).alias("name"))
    return found.groupBy("name", s.is_object(F.col("name"), PREFIX).alias("valid")).agg(F.count("*").alias("n"))


@query(f"WITH {D_CORPUS} SELECT stmt_id, {d_target(d_clean('sql'))} AS target FROM corpus")
def extract_target(spark, sf_dir):
    return b.lineage(spark, sf_dir).select("stmt_id", "target")


@query(f"WITH {D_CORPUS} SELECT stmt_id, array_to_string({d_sources(d_clean('sql'), 'CAST(NULL AS VARCHAR)')}, '|') AS sources FROM corpus")
def extract_sources(spark, sf_dir):
    rows = b.corpus(spark, sf_dir).withColumn("c", s.clean_sql(F.col("sql")))
    return rows.select("stmt_id", F.array_join(s.sources_of(F.col("c"), F.lit(None).cast("string"), PREFIX), "|").alias("sources"))


@query(f"WITH {D_LINEAGE} SELECT stmt_id, target, array_to_string(sources, '|') AS sources FROM lineage")
def regex_lineage(spark, sf_dir):
    return b.lineage(spark, sf_dir).select("stmt_id", "target", F.array_join("sources", "|").alias("sources"))


@query(f"WITH {D_LINEAGE}, e AS (SELECT DISTINCT stmt_id, unnest(sources) AS source FROM lineage) SELECT source, count(*) AS n_statements FROM e GROUP BY source")
def source_frequency(spark, sf_dir):
    return ops.source_frequency(b.lineage(spark, sf_dir), "stmt_id")


@query("""SELECT 'view_' || CAST(p_partkey AS VARCHAR) AS table_name, CASE WHEN p_partkey % 10 <> 0 THEN 'INSERT INTO zx_v.view_' || CAST(p_partkey AS VARCHAR) || ' SELECT * FROM zx_p.' || p_brand END AS sql FROM part""")
def ddl_synthesis(spark, sf_dir):
    from weftline.sources.files import view_statements

    body = F.when(F.col("p_partkey") % 10 != 0, F.concat(F.lit("SELECT * FROM zx_p."), "p_brand"))
    views = b.table(spark, sf_dir, "part").select(F.concat(F.lit("view_"), F.col("p_partkey").cast("string")).alias("table_name"), body.alias("view_def"))
    return view_statements(views, "zx_v").select("table_name", "sql")


@query(f"""WITH {D_LINEAGE} SELECT stmt_id, CAST(len(sources) AS BIGINT) AS n_before,
CAST(len(CASE WHEN list_contains(sources, 'zx_stage.late') THEN sources ELSE list_append(sources, 'zx_stage.late') END) AS BIGINT) AS n_after FROM lineage""")
def add_source(spark, sf_dir):
    rows = b.lineage(spark, sf_dir)
    return rows.select("stmt_id", F.size("sources").cast("long").alias("n_before"), F.size(ops.add_source(F.col("sources"), F.lit("zx_stage.late"))).cast("long").alias("n_after"))


@query(f"""WITH {D_LINEAGE} SELECT stmt_id, '{{"target":"' || target || '","sources":[' || array_to_string(list_transform(sources, lambda x: '"' || x || '"'), ',') || ']}}' AS json FROM lineage""")
def lineage_json(spark, sf_dir):
    from weftline.sources.export import lineage_json as to_json

    return to_json(b.lineage(spark, sf_dir)).select("stmt_id", "json")


@query(f"""WITH {D_LINEAGE} SELECT stmt_id, 'INSERT' AS kind, {d_clean("'INSERT INTO ' || target || ' SELECT 1 FROM ' || sources[1]")} AS rebuilt FROM lineage WHERE len(sources) > 0""")
def rebuild_statement(spark, sf_dir):
    rows = b.lineage(spark, sf_dir).filter(F.size("sources") > 0)
    text = F.concat(F.lit("INSERT INTO "), "target", F.lit(" SELECT 1 FROM "), F.col("sources")[0])
    return rows.select("stmt_id", F.lit("INSERT").alias("kind"), s.clean_sql(text).alias("rebuilt"))
