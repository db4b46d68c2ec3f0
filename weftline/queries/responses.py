"""Queries of model answers, of extraction by a model, and of the prompt-improving agent."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import responses as x
from weftline.functions.sqltext import PLAIN, QUOTED
from weftline.operators.agent import best_prompt as best
from weftline.operators.agent import iteration_numbers
from weftline.operators.model import LineageExtractor, stub_backend
from weftline.queries import base as b
from weftline.queries.base import D_CORPUS, D_RESPONSES, PREFIX, query

_CLEAN = r"trim(regexp_replace(response, '[\x00-\x1F]+', ' ', 'g'))"
_BLOCK = rf"nullif(regexp_extract({_CLEAN}, '\{{.*\}}', 0, 's'), '')"
_BARE = """lower(replace(replace({}, '"', ''), '''', ''))"""


@query(f"WITH {D_CORPUS} SELECT stmt_id, 'S' AS system, 'P' || chr(10) || chr(10) || 'SQL Query:' || chr(10) || '```sql' || chr(10) || replace(replace(sql || '{{}}', '{{', '{{{{'), '}}', '}}}}') || chr(10) || '```' AS human FROM corpus")
def build_messages(spark, sf_dir):
    m = x.build_messages(F.concat("sql", F.lit("{}")), "S", "P")
    return b.corpus(spark, sf_dir).select("stmt_id", m.alias("m")).select("stmt_id", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("human"))


@query(f"WITH {D_RESPONSES} SELECT id, {_CLEAN} AS text FROM responses")
def control_char_clean(spark, sf_dir):
    return b.responses(spark, sf_dir).select("id", x.clean_controls(F.col("response")).alias("text"))


@query(f"WITH {D_RESPONSES} SELECT id, {_BLOCK} AS block FROM responses")
def find_json_block(spark, sf_dir):
    return b.responses(spark, sf_dir).select("id", x.json_block(x.clean_controls(F.col("response"))).alias("block"))


_JSON = f"blocks AS (SELECT id, {_CLEAN} AS text, CASE WHEN json_valid({_BLOCK}) THEN CAST({_BLOCK} AS JSON) END AS j FROM responses)"
_LISTED = f"""list_transform(list_filter(CASE json_type(j, '$.sources') WHEN 'VARCHAR' THEN [j ->> '$.sources'] WHEN 'ARRAY' THEN CAST(j -> '$.sources' AS VARCHAR[]) ELSE [] END, lambda s: s <> ''), lambda s: {_BARE.format('s')})"""
_STRICT = f"strict AS (SELECT id, text, j IS NOT NULL AS ok, coalesce({_BARE.format("(j ->> '$.target')")}, '') AS target, {_LISTED} AS sources FROM blocks)"


@query(f"WITH {D_RESPONSES}, {_JSON}, {_STRICT} SELECT id, CASE WHEN ok THEN target END AS target, CASE WHEN ok THEN array_to_string(sources, '|') END AS sources FROM strict")
def parse_json_response(spark, sf_dir):
    p = b.responses(spark, sf_dir).select("id", x.parse_json(x.json_block(x.clean_controls(F.col("response")))).alias("p"))
    return p.select("id", "p.target", F.array_join("p.sources", "|").alias("sources"))


def _when(patterns, group="1"):
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}', 'is') THEN regexp_extract(text, '{p}', {group}, 'is') END" for p in patterns) + ", '')"


_Q = ('"', "''")
_T = _when((*(rf"{q}target{q}{x.COLON}{q}([^{q}]+){q}" for q in _Q), rf"""target["'']?{x.COLON}["'']?([^"'',\s}}]+)"""))
_L = _when((*(rf"{q}sources{q}{x.COLON}{x.LIST}" for q in _Q), rf"""sources["'']?{x.COLON}{x.LIST}"""))
_OUT = """lower(trim(trim({}), chr(34) || chr(39)))"""
_LOOSE = f"""loose AS (SELECT id, {_OUT.format('t')} AS target, list_transform(list_filter(CASE WHEN len(a) > 0 THEN a WHEN len(q) > 0 THEN q ELSE w END, lambda s: trim(s) <> ''), lambda s: {_OUT.format('s')}) AS sources
FROM (SELECT id, {_T} AS t, regexp_extract_all({_L}, '"([^"]+)"', 1) AS a, regexp_extract_all({_L}, '''([^'']+)''', 1) AS q, regexp_extract_all({_L}, '([^,\\]\\s]+)', 1) AS w FROM blocks))"""


@query(f"WITH {D_RESPONSES}, {_JSON}, {_LOOSE} SELECT id, target, array_to_string(sources, '|') AS sources FROM loose")
def regex_fallback_response(spark, sf_dir):
    p = b.responses(spark, sf_dir).select("id", x.parse_loosely(x.clean_controls(F.col("response"))).alias("p"))
    return p.select("id", "p.target", F.array_join("p.sources", "|").alias("sources"))


@query(f"""WITH {D_RESPONSES}, {_JSON}, {_STRICT}, {_LOOSE} SELECT s.id, CASE WHEN ok THEN s.target ELSE l.target END AS target, array_to_string(CASE WHEN ok THEN s.sources ELSE l.sources END, '|') AS sources
FROM strict s JOIN loose l ON s.id = l.id""")
def coalesced_response(spark, sf_dir):
    p = b.responses(spark, sf_dir).select("id", x.parse_response(F.col("response")).alias("p"))
    return p.select("id", "p.target", F.array_join("p.sources", "|").alias("sources"))


_STUB = rf"""regexp_extract_all(sql, '\b({PREFIX}\w*[.](?:{QUOTED}|{PLAIN}))', 1, 'i')"""


@query(f"""WITH {D_CORPUS}, named AS (SELECT stmt_id, list_transform({_STUB}, lambda m: {b.d_name('m')}) AS n FROM corpus)
SELECT stmt_id, n[1] AS target, array_to_string(list_sort(list_distinct(list_filter(n, lambda m: m <> n[1]))), '|') AS sources, CAST(NULL AS VARCHAR) AS error FROM named""")
def model_extract_stub(spark, sf_dir):
    """Extraction by the offline backend, whose first name is the target: prompt, call, parsing and all."""
    extractor = LineageExtractor(stub_backend(PREFIX), wait=lambda k: 0)
    return extractor.extract(b.corpus(spark, sf_dir)).select("stmt_id", "target", F.array_join("sources", "|").alias("sources"), "error")


@query(f"""WITH {D_CORPUS}, p AS (SELECT stmt_id, CASE WHEN stmt_id % 2 = 0 THEN sql ELSE 'Look at {{query}} now' END AS prompt FROM corpus)
SELECT stmt_id, CASE WHEN contains(prompt, '{{query}}') THEN prompt ELSE prompt || chr(10) || chr(10) || 'SQL Query:' || chr(10) || '```sql' || chr(10) || '{{query}}' || chr(10) || '```' || chr(10) || chr(10) || 'Your Response (JSON ONLY):' END AS prompt FROM p""")
def placeholder_prompt(spark, sf_dir):
    prompt = F.when(F.col("stmt_id") % 2 == 0, F.col("sql")).otherwise("Look at {query} now")
    return b.corpus(spark, sf_dir).select("stmt_id", x.placeholder_prompt(prompt).alias("prompt"))


_REPLY = "' Improved prompt: x' || chr(10) || '# note' || chr(10) || text || chr(10) || 'Improved PROMPT: y' || chr(10) || '#' || source || chr(10) || ' '"


@query(f"""SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split(regexp_replace({_REPLY}, '^\\s+|\\s+$', '', 'g'), chr(10)), lambda x: NOT (starts_with(x, '#') OR starts_with(lower(x), 'improved prompt:'))), chr(10)), '^\\s+|\\s+$', '', 'g') AS prompt FROM documents""")
def clean_reflection(spark, sf_dir):
    replies = b.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_REPLY} AS reply")
    return replies.select("doc_id", x.clean_reflection(F.col("reply")).alias("prompt"))


_HISTORY = """history AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration,
CASE WHEN event_type = 'click' THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE floor(value / 10) / 10.0 END AS f1 FROM events)"""


@query(f"""WITH {_HISTORY}, ranked AS (SELECT run_id, iteration, f1, row_number() OVER (PARTITION BY run_id ORDER BY f1 DESC, iteration) AS k FROM history WHERE status = 'SUCCESS' AND f1 IS NOT NULL)
SELECT h.run_id, CAST(coalesce(r.iteration, 0) AS BIGINT) AS iteration_found, coalesce(r.f1, -1.0) AS f1_score, coalesce(r.f1, -1.0) >= 1 AS is_perfect FROM (SELECT DISTINCT run_id FROM history) h LEFT JOIN ranked r ON r.run_id = h.run_id AND r.k = 1""")
def best_prompt(spark, sf_dir):
    events = iteration_numbers(b.table(spark, sf_dir, "events").withColumnRenamed("user_id", "run_id"), "run_id", ["ts", "event_id"])
    f1 = F.when(F.col("event_type").isin("click", "view"), None).otherwise(F.floor(F.col("value") / 10) / 10.0)
    status = F.when(F.col("event_type") == "click", "FAILED").otherwise("SUCCESS")
    return best(events.select("run_id", "iteration", status.alias("status"), f1.alias("f1")))


@query()
def optimise_loop_stub(spark, sf_dir):
    """The agent's rounds with offline backends; a loop of jobs, so that SQL has no counterpart."""
    from weftline.operators.agent import PromptOptimiser, f1_of

    agent = PromptOptimiser(spark, LineageExtractor(stub_backend(PREFIX), wait=lambda k: 0), lambda prompt: "Name the written table and each table that is read, with their schemas, as JSON.", 2)
    first = b.lineage(spark, sf_dir).orderBy("stmt_id").first()
    result = agent.optimise(first["sql"], "Give the lineage as JSON.", first["sources"])
    rows = [(i + 1, v["status"], v["validation_type"], f1_of(v)) for i, v in enumerate(result["validation_history"])]
    return spark.createDataFrame(rows, "iteration int, status string, validation_type string, f1_score double")


@query("""SELECT c_custkey, lower(replace(replace('"ZX_' || c_mktsegment || '".' || chr(39) || c_name || chr(39), '"', ''), chr(39), '')) AS name FROM customer""")
def normalise_names(spark, sf_dir):
    from weftline.functions.sqltext import bare_name

    written = F.concat(F.lit('"ZX_'), "c_mktsegment", F.lit('".\''), "c_name", F.lit("'"))
    return b.table(spark, sf_dir, "customer").select("c_custkey", bare_name(written).alias("name"))


_VIEW = "'INSERT INTO zx_v.view_' || p_partkey || ' SELECT * FROM zx_p.' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') || ' JOIN zx_q.part_' || (p_partkey % 50)"


@query(f"""WITH views AS (SELECT 'view_' || p_partkey AS table_name, {_VIEW} AS sql FROM part),
named AS (SELECT table_name, list_transform(regexp_extract_all(sql, '{b.OBJECT}', 1, 'i'), lambda m: {b.d_name('m')}) AS truth, list_transform({_STUB}, lambda m: {b.d_name('m')}) AS found FROM views),
sides AS (SELECT table_name, list_distinct(list_filter(truth, lambda m: m <> truth[1])) AS e, list_distinct(list_filter(found, lambda m: m <> found[1])) AS a FROM named)
SELECT table_name, CASE WHEN len(e) + len(a) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(e, a)) / (len(e) + len(a)) END AS f1_score FROM sides""")
def score_catalogue_stub(spark, sf_dir):
    """The scoring program on a catalogue of views with the offline backend."""
    from weftline.plans.scores import score_catalogue

    body = F.concat(F.lit("SELECT * FROM zx_p."), "p_brand", F.lit(" JOIN zx_q.part_"), (F.col("p_partkey") % 50).cast("string"))
    brand = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")
    views = b.spread(b.table(spark, sf_dir, "part").select("p_partkey", "p_brand")).withColumn("p_brand", brand).select(F.concat(F.lit("view_"), F.col("p_partkey").cast("string")).alias("table_name"), body.alias("view_def"))
    return score_catalogue(views, LineageExtractor(stub_backend(PREFIX), wait=lambda k: 0), "zx_v", PREFIX).by_table
