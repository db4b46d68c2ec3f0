"""The registry of queries, and inputs built from the driver's tables: each in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from weftline.functions.sqltext import PLAIN, QUOTED, WRITES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PREFIX = "zx_"


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that DuckDB compares it with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


#: A statement an order: four kinds of write, quoted and repeated names, decoys in comments and a literal, a cast.
STATEMENT = f"""
CASE o_orderkey % 4 WHEN 0 THEN 'INSERT INTO ' WHEN 1 THEN 'CREATE TABLE IF NOT EXISTS ' WHEN 2 THEN 'merge into ' ELSE 'UPDATE ' END
|| 'zx_mart.cust_' || {_s('o_custkey % 50')} || CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN ' AS ' WHEN 2 THEN ' USING (' ELSE ' SET x = (' END
|| 'SELECT a.c::numeric(38,8), zx_stage.ord_' || {_s('o_orderkey % 97')} || '.d, ' || chr(39) || 'zx_lit.decoy ' || {_s('o_orderkey')} || chr(39) || '::text AS k /* zx_block.decoy */' || chr(10)
|| 'FROM ZX_stage.ord_' || {_s('o_orderkey % 97')} || ' a -- zx_line.decoy' || chr(10)
|| 'JOIN zx_stage."Nat$' || {_s('o_custkey % 25')} || '" n ON ((n.k = a.k) AND (1 = 1))' || chr(10)
|| 'LEFT JOIN zx_mart.cust_' || {_s('o_custkey % 7')} || ' c ON c.id = a.id'
|| CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'UNION ALL SELECT CASE WHEN b.v IS NULL THEN 0 END, max(b.w) OVER(PARTITION BY b.k), 1 FROM zx_stage.late b WHERE b.q IS NOT NULL' ELSE '' END
|| CASE WHEN o_orderkey % 4 >= 2 THEN ')' ELSE '' END
"""
CORPUS = f"SELECT o_orderkey AS stmt_id, o_custkey AS bucket, {STATEMENT} AS sql FROM orders"


def spread(df: DataFrame) -> DataFrame:
    """df in as many tasks as a shuffle has: one small file makes one task, and what is made of its rows is worth more.

    By the hash of the rows, which have keys: dealing them out in turn would sort them first, in the few tasks that read.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stmt_id, bucket, sql."""
    return _orders(spark, sf_dir).selectExpr("o_orderkey AS stmt_id", "o_custkey AS bucket", f"{STATEMENT} AS sql")


def duck(sql: str) -> str:
    """The common SQL as DuckDB takes it."""
    return sql.replace("AS STRING", "AS VARCHAR")


# what the text functions do, in DuckDB's regular expressions
OBJECT = rf"\b(zx_[\w.]+?[.](?:{QUOTED}|{PLAIN}))"


def d_clean(x: str) -> str:
    for pattern, flags in (("''.*?''", "gs"), (r"--[^\n]*", "g"), (r"/\*.*?\*/", "gs"), (r"::\w+", "g")):
        x = f"regexp_replace({x}, '{pattern}', '', '{flags}')"
    return x


def d_valid(m: str) -> str:
    return rf"NOT regexp_matches({m}, '[()]|\bAS\b|\d+zx_|\.\*')"


def d_name(m: str) -> str:
    return f"""lower(replace({m}, '"', ''))"""


def d_target(c: str) -> str:
    out = []
    for write in WRITES:
        name = f"regexp_extract(regexp_extract({c}, '{write}([^\\s()]+)', 1, 'i'), '{OBJECT}', 1, 'i')"
        out.append(f"CASE WHEN {name} <> '' AND {d_valid(name)} THEN {d_name(name)} END")
    return f"coalesce({', '.join(out)})"


def d_sources(c: str, target: str) -> str:
    names = f"list_transform(list_filter(regexp_extract_all({c}, '{OBJECT}', 1, 'i'), lambda m: {d_valid('m')}), lambda m: {d_name('m')})"
    return f"list_sort(list_distinct(list_filter({names}, lambda n: n IS DISTINCT FROM {target})))"


D_CORPUS = f"corpus AS ({duck(CORPUS)})"
D_LINEAGE = f"""{D_CORPUS}, cleaned AS (SELECT *, {d_clean('sql')} AS c FROM corpus),
aimed AS (SELECT *, {d_target('c')} AS target FROM cleaned),
lineage AS (SELECT stmt_id, bucket, sql, target, {d_sources('c', 'target')} AS sources FROM aimed)"""

#: Expected against actual lineage: the actual one is spoilt by the statement's number.
SPOILT = """CASE WHEN stmt_id % 19 = 0 THEN NULL WHEN stmt_id % 17 = 0 THEN '' ELSE target END AS target, sources AS expected"""


def d_spoilt() -> str:
    """CTE compared(stmt_id, target, expected, actual)."""
    a = "CASE WHEN stmt_id % 5 = 0 THEN sources[2:] ELSE sources END"
    a = f"CASE WHEN stmt_id % 7 = 0 THEN list_append({a}, 'zx_more.extra') ELSE {a} END"
    return f"""{D_LINEAGE}, base AS (SELECT stmt_id, target AS t, {SPOILT}, {a} AS a1 FROM lineage),
step2 AS (SELECT *, CASE WHEN stmt_id % 11 = 0 THEN list_append(a1, upper(expected[-1])) ELSE a1 END AS a2 FROM base),
step3 AS (SELECT *, CASE WHEN stmt_id % 13 = 0 THEN list_append(a2, 'loose') ELSE a2 END AS a3 FROM step2),
compared AS (SELECT stmt_id, target, expected, CASE WHEN stmt_id % 23 = 0 THEN list_append(a3, t) WHEN stmt_id % 29 = 0 THEN list_append(a3, 'zx_mart.x_alias') ELSE a3 END AS actual FROM step3)"""


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.lineage import with_lineage

    return with_lineage(corpus(spark, sf_dir), PREFIX)


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stmt_id, target, expected, actual, as d_spoilt()."""
    from pyspark.sql import functions as F

    i = F.col("stmt_id")
    df = lineage(spark, sf_dir).select("stmt_id", F.col("target").alias("t"), F.col("sources").alias("expected"))
    a = F.when(i % 5 == 0, F.slice("expected", 2, 1000)).otherwise(F.col("expected"))
    # written out once: appending to what was appended doubles the expression at each step
    more = lambda *cases: reduce(lambda w, case: w.when(i % case[0] == 0, F.array(case[1])), cases, F).otherwise(F.array().cast("array<string>"))
    late = more((23, F.col("t")), (29, F.lit("zx_mart.x_alias")))
    a = F.concat(a, more((7, F.lit("zx_more.extra"))), more((11, F.upper(F.element_at("expected", -1)))), more((13, F.lit("loose"))), late)
    target = F.when(i % 19 == 0, F.lit(None)).when(i % 17 == 0, F.lit("")).otherwise(F.col("t"))
    return df.select("stmt_id", target.alias("target"), "expected", a.alias("actual"))


#: Lineage edges: region, nation, customer, order; seq in that order.
EDGES = """
SELECT CAST(n_nationkey AS BIGINT) AS seq, 'region_' || CAST(n_regionkey AS STRING) AS src, 'nation_' || CAST(n_nationkey AS STRING) AS tgt FROM nation
UNION ALL SELECT 1000 + c_custkey, 'nation_' || CAST(c_nationkey AS STRING), 'customer_' || CAST(c_custkey AS STRING) FROM customer
UNION ALL SELECT 1000000000 + o_orderkey, 'customer_' || CAST(o_custkey AS STRING), 'order_' || CAST(o_orderkey AS STRING) FROM orders
"""
#: With back edges, so that there are cycles.
EDGES_CYCLIC = EDGES + """
UNION ALL SELECT CAST(900 AS BIGINT), 'nation_3', 'region_0' UNION ALL SELECT CAST(901 AS BIGINT), 'nation_7', 'nation_3' UNION ALL SELECT CAST(902 AS BIGINT), 'nation_3', 'nation_7'
"""


def edges(spark: SparkSession, sf_dir: str, sql: str = EDGES) -> DataFrame:
    for t in ("nation", "customer", "orders"):
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
    frames = {t: table(spark, sf_dir, t) for t in ("nation", "customer", "orders") if "{" + t + "}" in sql}
    return spark.sql(sql, **frames)


def d_edges(sql: str = EDGES) -> str:
    return f"edges AS ({duck(sql)})"


#: Answers of models, by the statement's number: fenced and bare JSON, a text for sources, single quotes, prose, broken, none.
RESPONSE = """
CASE o_orderkey % 7
WHEN 0 THEN '```json' || chr(10) || '{"target": "ZX_m.T' || CAST(o_custkey % 9 AS STRING) || '", "sources": ["zx_a.s1", "ZX_b.S2"]}' || chr(10) || '```'
WHEN 1 THEN '{"target": "zx_m.t", "sources": ["zx_a.s' || CAST(o_custkey % 5 AS STRING) || '", "", "zx_a.s0"]}'
WHEN 2 THEN '{"target": "zx_m.t' || CAST(o_custkey % 3 AS STRING) || '", "sources": "zx_a.only"}'
WHEN 3 THEN '{' || chr(39) || 'target' || chr(39) || ': ' || chr(39) || 'zx_m.q' || CAST(o_custkey % 4 AS STRING) || chr(39) || ', ' || chr(39) || 'sources' || chr(39) || ': [' || chr(39) || 'zx_a.Q1' || chr(39) || ', ' || chr(39) || 'zx_a.q2' || chr(39) || ']}'
WHEN 4 THEN 'It is this:' || chr(9) || chr(10) || '{"target": "zx_m.p", "sources": ["zx_a.p' || CAST(o_custkey % 6 AS STRING) || '"]} as asked.'
WHEN 5 THEN 'target: zx_m.broken' || CAST(o_custkey % 2 AS STRING) || ', sources: [zx_a.b1, zx_a.B2'  || CASE WHEN o_custkey % 2 = 0 THEN ']' ELSE '' END
ELSE '' END
"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).selectExpr("o_orderkey AS id", f"{RESPONSE} AS response")


D_RESPONSES = f"responses AS (SELECT o_orderkey AS id, {duck(RESPONSE)} AS response FROM orders)"
