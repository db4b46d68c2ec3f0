"""That the work of a row is done once: what plans evaluate, and that the short ways give what the long ones do."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import checks, sqltext
from weftline.operators import graph, scoring
from weftline.queries import QUERIES


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["truncated_sources", "single_query_graph"])  # F10, F15
def test_lineage_is_evaluated_once(spark, sf_dir, name):
    once = optimized(QUERIES["regex_lineage"](spark, sf_dir)).count("MERGE")
    assert optimized(QUERIES[name](spark, sf_dir)).count("MERGE") == once


def test_lint_searches_once_by_rule(spark):  # F1, F2, F18
    one = spark.createDataFrame([("SELECT 'a'::text WHERE (1 = 1) AND x ^ y",), ("",), (None,)], "sql string")
    df = one.select(sqltext.lint(F.col("sql")).alias("i"))
    assert optimized(df.filter("rand() >= 0")).count("regexp_extract_all") == len(sqltext.LINT)
    assert [[(i["type"], i["count"], i["examples"]) for i in r["i"]] for r in df.collect()] == [
        [("Redundant type cast", 1, ["'a'::text"]), ("Tautological condition", 1, ["(1 = 1)"]), ("Odd symbols in identifiers", 1, ["^"])], [], [],
    ]


@pytest.mark.parametrize("text", ["'a'::text", "((((x))))", "(1 = 1)", "IS NOT NULL)))", "$$", "^", "**", "((a) AND (b))"])
def test_lint_marks_are_in_every_match(text):
    import re

    hit = [marks for (_, pattern, _), marks in zip(sqltext.LINT, sqltext.LINT_MARKS) if re.search(pattern, text)]
    assert hit and all(any(m in text for m in marks) for marks in hit)


def test_structure_is_counted_on_texts_upper_cased_once(spark):  # F1, F2, F11, F12, F13, F17
    texts = [("select a from b join c", "SELECT a FROM b, c"), ("select 1", "1"), ("x", "x"), (None, "select"), ("select", None)]
    rows = spark.createDataFrame(texts, "a string, b string").filter("rand() >= 0")
    both = rows.select(checks.preserved(F.col("a"), F.col("b")).alias("v"), checks.keeps_structure(F.col("a"), F.col("b")).alias("k"))
    assert optimized(rows.select(checks.preserved(F.col("a"), F.col("b")).alias("v"))).count("upper(") == 2
    got = [(r["v"]["passed"], r["k"]) for r in both.collect()]
    assert got[:3] == [(True, True), (False, False), (True, True)]


def test_checks_do_not_split_names_or_repeat_themselves(spark):  # F3 to F9
    rows = spark.createDataFrame([("a.b", ["a.c", "t_1", "A.C"], ["a.c"])], "t string, s array<string>, e array<string>").filter("rand() >= 0")
    plan = optimized(rows.select(checks.comprehensive(F.col("t"), F.col("s"), F.col("e")).alias("v")))
    assert "split(" not in plan and plan.count("_alias") == 1


def test_spoilt_sources_are_appended_in_a_line(spark, sf_dir):  # F3 to F9
    assert optimized(QUERIES["comprehensive_validation"](spark, sf_dir)).count("zx_more.extra") == 1


@pytest.mark.parametrize("name", [".b", "a.", "a.b", "a", "a.b.c", ".", "", "..", "é.b"])
def test_name_faults(spark, name):
    parts = name.split(".")
    good = len(parts) == 2 and all(parts)
    assert spark.createDataFrame([(name,)], "n string").select(checks.check_target(F.col("n"))["valid"]).first()[0] == good


def test_ascii_text_takes_the_plain_patterns(spark):
    ascii_text = "INSERT INTO zx_a.t SELECT 1::int FROM ZX_b.s JOIN zx_c.\"Q$\" x"
    texts = [ascii_text, ascii_text + " -- é", ascii_text.replace("zx_a.t", "zx_a.té"), "UPDATE zx_a.t SET x = 1", ""]
    rows = spark.createDataFrame([(x,) for x in texts], "sql string").filter("rand() >= 0")
    k = sqltext.clean_sql(F.col("sql"))
    t = sqltext.target_of(k, "zx_")
    long_way = F.struct(t.alias("target"), sqltext.sources_of(k, t, "zx_").alias("sources"))
    got = rows.select(sqltext.lineage_of(F.col("sql"), "zx_").alias("short"), long_way.alias("long")).collect()
    assert [r["short"] for r in got] == [r["long"] for r in got] and got[2]["short"]["target"] == "zx_a.té"
    assert r"(?i)\b(zx_" in optimized(rows.select(sqltext.lineage_of(F.col("sql"), "zx_").alias("l")))


def test_report_is_parsed_once(spark, sf_dir):  # F1
    plan = optimized(QUERIES["refinement_report"](spark, sf_dir))
    assert "get_json_object" not in plan and plan.count("from_json") == 1


def test_layout_makes_its_layers_and_links_once(spark, monkeypatch):  # F14
    names, keep = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: names.append(name) or keep(df, name))
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "a", "c")], "seq long, src string, tgt string")
    got = {r["node"]: (r["layer"], r["y"]) for r in graph.layout(graph.layers(edges)).collect()}
    assert got == {"a": (0, 1.0), "b": (1, 0.0), "c": (1, 0.0)}
    assert names.count("links") == 1 and names.count("layered") == 1


def test_a_small_catalogue_is_spread(spark, sf_dir, monkeypatch):  # F16
    from weftline.plans import scores

    seen, run = [], scores.score_catalogue
    monkeypatch.setattr(scores, "score_catalogue", lambda views, *a: seen.append(views.rdd.getNumPartitions()) or run(views, *a))
    QUERIES["score_catalogue_stub"](spark, sf_dir)
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def test_plain_names_take_the_short_way(spark):  # F4 to F8
    texts = ["insert into ZX_a.T select * from zx_b.\"S s\", azx_c.d", "UPDATE zx_a.AS SET x", "UPDATE zx_a.as SET x", "SELECT zx_a1zx_b.c", "MERGE INTO zx_a.\"q(\"", "SELECT 1", "'zx_a.b", ""]
    rows = spark.createDataFrame([(x,) for x in texts], "sql string").filter("rand() >= 0")
    k = sqltext.clean_sql(F.col("sql"), True)
    t = sqltext.target_of(k, "zx_", True)
    long_way = F.struct(t.alias("target"), sqltext.sources_of(k, t, "zx_", True).alias("sources"))
    short = sqltext._plain_lineage(F.col("sql"), "zx_")
    got = rows.select(sqltext.lineage_of(F.col("sql"), "zx_").alias("l"), long_way.alias("long"), short.isNull().alias("doubtful")).collect()
    assert [r["l"] for r in got] == [r["long"] for r in got]
    assert [r["doubtful"] for r in got] == [False, True, True, True, True, False, False, False]


def test_messages_are_made_only_where_they_are_read(spark, sf_dir):  # F5 to F7
    for name in ("f1_by_table", "success_metrics_mean", "prompt_ab_compare"):
        plan = optimized(QUERIES[name](spark, sf_dir))
        assert "should be fully qualified" not in plan and "Duplicate sources" not in plan
    assert "should be fully qualified" in optimized(QUERIES["comprehensive_validation"](spark, sf_dir))


def test_columns_of_validation_are_those_of_comprehensive(spark):  # F5 to F7
    names = [None, "", "a.b", "A.B", "a", ".b", "a.", "a.b.c", "t_1", "x.y_alias", "X.Y_ALIAS", "a.b\na.b", "a.b\nc.d", "x.y\n", "é.b", "É.b", "derived"]
    lists = [None, []] + [[x] for x in names] + [["c.d", x] for x in names] + [["c.d", x, "e.f"] for x in names] + [[None, "a.b\nc.d"], ["a.b", "A.b"], ["é.b", "É.b"], ["e.f", "e.f"]]
    rows = [(t, s, e) for t in names + ["z.z"] for s in lists for e in (["c.d", "e.f"], [], None)]
    df = spark.createDataFrame(rows, "target string, actual array<string>, expected array<string>").repartition(4)
    whole = checks.comprehensive(F.col("target"), F.col("actual"), F.col("expected"))
    both = scoring.validate(df.withColumn("whole", whole)).select("whole", F.struct("status", "validation_type", "message", "metrics").alias("parts"))
    assert both.filter("whole.status = 'SUCCESS'").count() > 20 and both.filter("NOT (whole <=> parts)").count() == 0
    assert scoring.validate(df, expected=None).filter("metrics IS NOT NULL").count() == 0


def test_literals_are_split_off_and_doubt_is_plain_text(spark):  # F5 to F7
    texts = ["", "a", "'", "''", "a'b", "a'b'c", "a'b'c'd", "'a''b'", "a'\n'b", "'é'x'", None]
    rows = spark.createDataFrame([(x,) for x in texts], "s string").filter("rand() >= 0")
    got = rows.select(sqltext.strip_literals(F.col("s")).alias("short"), F.regexp_replace("s", "'[^']*'", "").alias("long"))
    assert [r["short"] for r in got.collect()] == [r["long"] for r in got.collect()] and "split(" in optimized(got)
    names = ["zx_a.b", "zx_as.x", "zx_a.as", "zx_a.$as", "zx_a.has", "zx_a.\"x(\"", "zx_a.\".*\"", "zx_a.\")\"", "zx_1zx_a.b", "zx_a1.zx_b", ""]
    rows = spark.createDataFrame([(x,) for x in names], "n string").filter("rand() >= 0")
    got = rows.select(sqltext._is_doubtful(F.col("n"), "zx_").alias("short"), F.col("n").rlike(r"[()]|\bas\b|\dzx_|\.\*").alias("long")).collect()
    assert [r["short"] for r in got] == [r["long"] for r in got]
