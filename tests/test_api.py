"""The classes for single statements, records and graphs."""

from weftline import api
from weftline.operators.model import LineageExtractor, stub_backend


def test_records():
    r = api.Lineage("t", ["a"])
    for name in ("b", "a", "", None):
        r.add_source(name)
    assert r.source_count == 2 and r.to_dict() == {"target": "t", "sources": ["a", "b"]} and '"target": "t"' in r.to_json()


def test_extractors(spark):
    sql = "INSERT INTO zx_a.t SELECT 1 FROM zx_b.u"
    assert api.PatternExtractor(spark, "zx_").extract(sql) == api.Lineage("zx_a.t", ["zx_b.u"])
    m = api.ModelExtractor(spark, LineageExtractor(stub_backend("zx_"), max_retries=1, wait=lambda k: 0))
    assert m.extract_with_result(sql) == api.Lineage("zx_a.t", ["zx_b.u"])
    good, bad = m.batch_extract([sql, "nothing"])
    assert good == {"target": "zx_a.t", "sources": ["zx_b.u"]} and bad["query"] == "nothing" and bad["error"] and bad["target"] == ""
    assert m.get_config_info()["max_retries"] == 1
    assert api.parse_answer(spark, "{'target': 'A.b', 'sources': ['c.d']}") == api.Lineage("a.b", ["c.d"])
    assert api.normalise(spark, ["\"A\".'b'"]) == ["a.b"] and api.split_statements(spark, "a; b;") == ["a", "b"]


def test_validator(spark):
    v = api.Validator(spark)
    assert v.output_format({"target": "a"}) == (False, "Missing 'sources'") and not v.output_format({"target": None, "sources": []})[0]
    assert v.target_name("a.b")[0] and not v.target_name("a")[0] and v.source_names([])[0] and not v.no_derived_tables(["a.b"], "a.b")[0]
    assert not v.unique_sources(["a.b", "A.b"])[0] and not v.fully_qualified_names(["x"])[0]
    assert v.precision_recall_f1(["a", "b"], ["a"]) == (1.0, 0.5, 2 / 3)
    out = v.comprehensive({"target": "a.b", "sources": ["c.d"]}, {"sources": ["c.d"]})
    assert out["status"] == "SUCCESS" and out["metrics"]["f1_score"] == 1.0
    assert "metrics" not in v.comprehensive({"target": "a.b", "sources": ["c.d"]}) and v.comprehensive({"target": "", "sources": []})["validation_type"] == "target"


def test_graph(spark, tmp_path):
    g = api.LineageGraph(spark).build({"target": "c", "sources": ["a", "b"]}).build([{"target": "d", "sources": ["c"]}, {"target": "e", "sources": []}])
    s = g.summary()
    assert (s["tables"], s["relationships"], s["sources"], s["targets"], s["intermediates"], s["cycle"]) == (4, 3, ["a", "b"], ["d", "e"], ["c"], [])
    assert g.paths("a", "d") == [["a", "c", "d"]] and g.paths("d", "a") == []
    view = g.view("d", exclude_intermediates=True)
    assert sorted(view["edges"]) == [("a", "d"), ("b", "d")] and view["title"] == "Data Lineage: d - Intermediates Collapsed" and view["legend"]["Focus Target"] == "#FFD700"
    assert g.export_to_dot(str(tmp_path / "g.dot")).startswith("digraph DataLineage {")


def test_refiner(spark, tmp_path):
    from weftline.operators.refinement import Refiner

    backend = lambda: lambda prompt: "```sql\nSELECT 1 FROM t;\n```"
    r = api.SqlRefiner(spark, Refiner(spark, backend, str(tmp_path / "cache"), retry_delay=0, delay_between=0))
    rows = r.batch_refine(["SELECT 1 FROM t", "SELECT  2 FROM t"])
    assert [x["refined_sql"] for x in rows] == ["SELECT 1 FROM t;"] * 2 and all(x["success"] for x in rows)
    assert r.refine_sql("SELECT 1 FROM t")["from_cache"]
    stats = r.get_session_stats()
    assert stats["total_requests"] == 2 and stats["success_rate"] == 100 and stats["config"]["timeout"] == 120
