"""Column functions on hand-made cases."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import checks, responses, sqltext
from weftline.operators.lineage import add_source, statements, with_lineage

P = "zx_"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("v")).first()["v"]


def lineage(spark, sql):
    r = with_lineage(spark.createDataFrame([(sql,)], "sql string"), P).first()
    return r["target"], r["sources"]


@pytest.mark.parametrize(
    "sql, target, sources",
    [
        ("INSERT INTO zx_a.t SELECT zx_b.u.col FROM zx_b.u, zx_b.U", "zx_a.t", ["zx_b.u"]),
        ("INSERT INTO zx_a.t SELECT * FROM zx_b.u.v", "zx_a.t", ["zx_b.u"]),  # three parts are cut to two
        ("INSERT INTO other.t SELECT 1 FROM zx.u", None, []),
        ('INSERT INTO zx_a."T$x" SELECT 1 FROM "zx_q".r, zx_c."two words"', "zx_a.t$x", ["zx_c.two words"]),
        ('INSERT INTO zx_a."two words" SELECT 1', None, ["zx_a.two words"]),  # a target with a space is lost
        ("INSERT INTO zx_a.t SELECT * FROM zx_a.t JOIN zx_b.s ON 1=1", "zx_a.t", ["zx_b.s"]),
        ("SELECT * FROM zx_b.s", None, ["zx_b.s"]),
        ("CREATE TABLE IF NOT EXISTS zx_a.t AS SELECT 1 FROM zx_b.s", "zx_a.t", ["zx_b.s"]),
        ("create view zx_a.v AS SELECT 1 FROM zx_b.s", None, ["zx_a.v", "zx_b.s"]),
        ("merge\n into zx_a.t using zx_b.s", "zx_a.t", ["zx_b.s"]),
        ("SELECT last_update zx_b.s FROM zx_c.d", "zx_b.s", ["zx_c.d"]),  # keywords have no boundary before them
        ("INSERT INTO x SELECT 1; UPDATE zx_a.t SET b = 1", "zx_a.t", []),
        ("-- it's\nINSERT INTO zx_a.t SELECT 'x' FROM zx_b.s", None, []),  # an apostrophe in a comment opens a literal
        ("INSERT INTO zx_a.t SELECT 'zx_n.n', a::zx_c.d FROM /* zx_e.f */ zx_b.s -- zx_g.h", "zx_a.t", ["zx_b.s"]),
        ("INSERT INTO zx_a.t SELECT ézx_b.s, zx_b.é FROM zx_b.s", "zx_a.t", ["zx_b.s", "zx_b.é"]),
        ("", None, []),
    ],
)
def test_lineage(spark, sql, target, sources):
    assert lineage(spark, sql) == (target, sources)


def test_null_statement(spark):
    assert lineage(spark, None) == (None, None)


@settings(max_examples=25, deadline=None)
@given(names=st.lists(st.sampled_from(["zx_a.t", "zx_b.u", 'zx_b."U$"', "zx_c.v", "a.b", "x"]), max_size=6))
def test_sources_are_sorted_distinct_and_not_the_target(spark, names):
    target, sources = lineage(spark, "INSERT INTO zx_a.t SELECT 1 FROM " + ", ".join(names))
    assert target == "zx_a.t" and sources == sorted({n.replace('"', "").lower() for n in names if n.startswith("zx_")} - {target})


def test_statements(spark):
    df = spark.createDataFrame([("f", " a ;; b\n; ; 'x;y' "), ("g", ""), ("h", None)], "filename string, content string")
    assert [(r.filename, r.statement_index, r.full_sql, r.stmt_key) for r in statements(df).collect()] == [
        ("f", 1, "a", "f#1"), ("f", 2, "b", "f#2"), ("f", 3, "'x", "f#3"), ("f", 4, "y'", "f#4"),
    ]
    quoted = spark.createDataFrame([("f", "a 'x;''y'; b -- c;d\n; /* ; */ \"q;r\" ;")], "filename string, content string")
    assert [r.full_sql for r in statements(quoted, quoted=True).collect()] == ["a 'x;''y';", "b -- c;d\n;", '/* ; */ "q;r" ;']
    odd = spark.createDataFrame([("it's; b",), ("/* open ; x; y",), ("a-b/c; 'u",), (";;",)], "content string").selectExpr("content AS filename", "content")
    assert sorted(r.full_sql for r in statements(odd, quoted=True).collect()) == sorted(["it's;", "b", "/* open ;", "x;", "y", "a-b/c;", "'u"])


@pytest.mark.parametrize("size", [3_000, 1_000_000])
def test_long_statements_are_split(spark, size):
    parts, n = [], 0
    while n < size:
        parts.append(f"'x;{n}''y' AS \"c;{n}\" /* ; */ -- ;\n")
        n += len(parts[-1]) + 2
    first = "INSERT INTO zx_a.t SELECT " + ", ".join(parts) + " FROM zx_b.u;"
    df = spark.createDataFrame([("f", first + " SELECT 1;")], "filename string, content string")
    assert [r.full_sql for r in statements(df, quoted=True).orderBy("statement_index").collect()] == [first, "SELECT 1;"]
    long = spark.createDataFrame([("f", "x" * 300)], "filename string, content string")
    assert statements(long).first()["query_preview"] == "x" * 200 + "..."


def test_complexity_and_lint(spark):
    sql = "WITH a AS (SELECT 1) SELECT '1'::text, '2'::date, ((((b)))) FROM x JOIN y ON (1 = 1) UNION ALL SELECT CASE WHEN (((c IS NOT NULL))) THEN max(d) OVER(PARTITION BY e) END, z$$ WHERE ((f) AND (g))"
    c = one(spark, sqltext.complexity(F.col("s")), s=sql)
    assert c.asDict() == {"subqueries": 2, "joins": 1, "unions": 1, "case_statements": 1, "window_functions": 1, "ctes": 1}
    issues = {i["type"]: (i["count"], i["examples"]) for i in one(spark, sqltext.lint(F.col("s")), s=sql)}
    assert issues == {
        "Redundant type cast": (2, ["'1'::text", "'2'::date"]), "Excessive parentheses": (1, ["((((b))))"]), "Tautological condition": (1, ["(1 = 1)"]),
        "Nested null check": (1, ["IS NOT NULL)))"]), "Odd symbols in identifiers": (1, ["$$"]), "Complex AND condition": (1, ["((f) AND (g))"]),
    }
    assert one(spark, sqltext.complexity(F.col("s")), s="")["subqueries"] == 0


@pytest.mark.parametrize(
    "answer, target, sources",
    [
        ('{"target": "A.\'B\'", "sources": ["C.d", "", "C.d"]}', "a.b", ["c.d", "c.d"]),
        ('```json\n{"target": "a.b", "sources": "c.D"}\n```', "a.b", ["c.d"]),
        ('{"target": "a.b", "sources": 7}', "a.b", []),
        ('{"target": "a.b"}', "a.b", []),
        ('{"sources": ["x.y"]}', "", ["x.y"]),
        ("{'target': 'A.b', 'sources': ['c.d', 'E.f']}", "a.b", ["c.d", "e.f"]),
        ("Target: a.b, sources: [c.d, e.f]", "a.b", ["c.d", "e.f"]),
        ('"target" : "a.b" and no list', "a.b", []),
        ("nothing", "", []),
        ("", "", []),
    ],
)
def test_answers(spark, answer, target, sources):
    r = one(spark, responses.parse_response(F.col("s")), s=answer)
    assert (r["target"], r["sources"]) == (target, sources)


@pytest.mark.parametrize(
    "answer, sql",
    [
        ("Here:\n```sql\n SELECT 1 \n```\nbye", "SELECT 1"),
        ("```\nSELECT 1\n```", "SELECT 1"),
        ("Here is it\nSELECT 1\nOutput: ok", "SELECT 1;"),
        ("SELECT 1;", "SELECT 1;"),
        ("```sql\nSELECT 1", "SELECT 1;"),
        ("  ", ""),
    ],
)
def test_refined_sql(spark, answer, sql):
    assert one(spark, responses.refined_sql(F.col("s")), s=answer) == sql


def test_messages_and_prompts(spark):
    m = one(spark, responses.build_messages(F.col("s"), "sys", "ask"), s="a {b}")
    assert [(x["role"], x["content"]) for x in m] == [("system", "sys"), ("human", "ask" + responses.ASK + "a {{b}}\n```")]
    assert one(spark, responses.placeholder_prompt(F.col("s")), s="x {query}") == "x {query}"
    assert one(spark, responses.placeholder_prompt(F.col("s")), s="x").startswith("x" + responses.ASK + "{query}\n```")
    assert one(spark, responses.clean_reflection(F.col("s")), s="Improved prompt: a\n# b\nc\n") == "c"


@pytest.mark.parametrize(
    "target, sources, kind",
    [
        (None, ["a.b"], "format"), ("x.y", None, "format"), ("", [], "target"), ("x", [], "target"), ("x.y.z", [], "target"), (".y", [], "target"), ("x.", [], "target"),
        ("x.y", ["a"], "sources"), ("x.y", ["a.b", ""], "sources"), ("x.y", ["a."], "sources"), ("x.y", ["a.b_alias"], "derived_tables"), ("x.y", ["x.y"], "derived_tables"),
        ("x.y", ["a.b", "A.b"], "uniqueness"), ("x.y", [], "comprehensive"), ("x.y", ["a.b", "c.d"], "comprehensive"),
    ],
)
def test_validation(spark, target, sources, kind):
    df = spark.createDataFrame([(target, sources, ["a.b"])], "t string, s array<string>, e array<string>")
    v = df.select(checks.comprehensive(F.col("t"), F.col("s"), F.col("e")).alias("v")).first()["v"]
    assert v["validation_type"] == kind and (v["status"] == "SUCCESS") == (kind == "comprehensive") == (v["metrics"] is not None)


def test_check_messages(spark):
    v = one(spark, checks.check_sources(F.col("s")), s=["a", "", "b.", "c.d"])
    assert v["message"] == "Source 'a' should be fully qualified (schema.table); Source 1 is empty; Source 'b.' has missing schema or table name"
    v = one(spark, checks.check_derived(F.col("s"), F.lit("c.d")), s=["t_1", "T1", "cte_22", "c.d", "subquery", "x_y"])
    assert v["message"].split("; ") == [f"Derived table detected: {x}" for x in ("t_1", "T1", "cte_22", "subquery")] + ["Target 'c.d' should not appear in sources"]
    assert one(spark, checks.check_unique(F.col("s")), s=["a.b", "A.B", "a.b", "c"])["message"] == "Duplicate sources found: ['A.B', 'a.b']"
    assert one(spark, checks.check_qualified(F.col("s")), s=["a", "b.c"])["message"] == "Name 'a' is not fully qualified"
    assert one(spark, checks.check_sources(F.col("s")), s=[])["message"] == "No sources (valid case)"


@settings(max_examples=30, deadline=None)
@given(e=st.lists(st.sampled_from("abcd"), max_size=5), a=st.lists(st.sampled_from("abcd"), max_size=5))
def test_scores_are_those_of_sets_and_f1_is_symmetric(spark, e, a):
    df = spark.createDataFrame([(e, a)], "e array<string>, a array<string>")
    m, n = df.select(checks.prf1(F.col("e"), F.col("a")).alias("m"), checks.prf1(F.col("a"), F.col("e")).alias("n")).first()
    hits = len(set(e) & set(a))
    p, r = (1.0, 1.0) if not e and not a else (hits / len(set(a)) if a else 0.0, hits / len(set(e)) if e else 0.0)
    assert m["precision"] == pytest.approx(p) and m["recall"] == pytest.approx(r) and m["f1_score"] == pytest.approx(n["f1_score"]) == pytest.approx(2 * p * r / (p + r) if p + r else 0)


def test_preservation(spark):
    v = one(spark, checks.preserved(F.col("a"), F.col("b")), a="INSERT INTO x SELECT 1 FROM y WHERE z", b="insert into x select 1 from y")
    assert v["passed"] and v["error"] is None and v["warnings"] == ["WHERE clauses count changed: 1 -> 0"] and len(v["critical_checks"]) == 4
    v = one(spark, checks.preserved(F.col("a"), F.col("b")), a="SELECT 1 FROM y WHERE z", b="SELECT 1, (SELECT 2)")
    assert not v["passed"] and v["error"] == "SELECT statements count changed: 1 -> 2" and v["warnings"] == []
    assert {k: x["match"] for k, x in v["critical_checks"].items()} == {"UNION ALL": True, "SELECT": False}


def test_add_source(spark):
    for name, out in (("c", ["a", "b", "c"]), ("a", ["a", "b"]), ("", ["a", "b"]), (None, ["a", "b"])):
        assert one(spark, add_source(F.col("s"), F.col("n")), s=["a", "b"], n=name) == out


def test_fingerprint(spark):
    import hashlib

    assert one(spark, sqltext.fingerprint(F.col("s"), "m", 0.1), s="x") == hashlib.md5(b"x_m_0.1").hexdigest()
    assert re.fullmatch("[0-9a-f]{32}", one(spark, sqltext.fingerprint(F.col("s"), "m", 0), s=""))
