"""Operators over small graphs, stores, models and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph as g
from weftline.operators import store as st
from weftline.operators.agent import FALLBACK, PromptOptimiser, best_prompt, save_history
from weftline.operators.lineage import edges_of, statements, with_lineage
from weftline.operators.model import LineageExtractor, create_extractor, http_backend, respond, stub_backend
from weftline.operators.ranking import ranked
from weftline.operators.refinement import Refiner, session_stats
from weftline.plans.scores import compare_extractors, score_catalogue
from weftline.sources import export, files
from weftline.streaming.ingest import ingest, script_stream

P = "zx_"
#: a, b -> c -> d -> e, f; g -> d; c -> f
EDGES = [(0, "a", "c"), (1, "b", "c"), (2, "c", "d"), (3, "g", "d"), (4, "d", "e"), (5, "d", "f"), (6, "c", "f")]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "seq long, src string, tgt string")


def pairs(df):
    return sorted((r.src, r.tgt) for r in df.collect())


def test_classes_and_summary(spark):
    e = edges(spark)
    kinds = {r.node: r.kind for r in g.classify(e).collect()}
    assert kinds == {"a": "source", "b": "source", "g": "source", "c": "intermediate", "d": "intermediate", "e": "target", "f": "target"}
    loose = g.classify(e, spark.createDataFrame([("lonely",), ("a",)], "tgt string"))
    assert {r.node: r.kind for r in loose.collect()} == kinds | {"lonely": "target", "a": "intermediate"}
    assert {r.metric: r.value for r in g.summary(e, g.classify(e)).collect()} == {"tables": 7, "relationships": 7, "source": 3, "target": 2, "intermediate": 2}
    assert g.classify(edges(spark, [(0, "s", "s")])).first()["kind"] == "intermediate"
    assert g.summary(edges(spark, []), g.classify(edges(spark, []))).filter("value > 0").count() == 0


def test_upstream(spark):
    e = edges(spark)
    far = lambda d: {r.node: r.dist for r in g.upstream(e, "f", d).collect()}
    assert far(0) == {"f": 0} and far(1) == {"f": 0, "d": 1, "c": 1} and far(None) == {"f": 0, "d": 1, "c": 1, "g": 2, "a": 2, "b": 2}
    assert set(far(1)) <= set(far(2)) <= set(far(None))
    with pytest.raises(g.UnknownNode):
        g.upstream(e, "nowhere")
    assert pairs(g.induced(e, g.upstream(e, "f", 1))) == [("c", "d"), ("c", "f"), ("d", "f")]


def brute_collapse(rows, kept):
    out = {(a, b) for a, b in rows if a in kept and b in kept}
    for start in kept:
        todo, seen = [b for a, b in rows if a == start and b not in kept], set()
        while todo:
            x = todo.pop()
            if x in seen:
                continue
            seen.add(x)
            for a, b in rows:
                if a == x:
                    if b in kept:
                        if b != start:
                            out.add((start, b))
                    else:
                        todo.append(b)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_collapse_keeps_reachability_with_cycles(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(12)})
    e = edges(spark, [(i, a, b) for i, (a, b) in enumerate(rows)])
    sources, targets = {a for a, _ in rows}, {b for _, b in rows}
    kept = (sources | targets) - (sources & targets)
    focus = sorted(sources & targets)[0]
    assert pairs(g.collapse(e, g.classify(e))) == brute_collapse(rows, kept)
    assert pairs(g.collapse(e, g.classify(e), focus)) == brute_collapse(rows, kept | {focus})


def test_layers_layout_legend(spark):
    e = edges(spark)
    assert {r.node: r.layer for r in g.layers(e).collect()} == {"a": 0, "b": 0, "g": 0, "c": 1, "d": 2, "e": 3, "f": 2}
    assert {r.node: r.layer for r in g.layers(e, "f").collect()} == {"f": 0, "c": 1, "d": 1, "a": 2, "b": 2, "g": 2, "e": 0}
    at = {r.node: (round(r.x, 6), round(r.y, 6)) for r in g.layout(g.layers(e)).collect()}
    assert at["a"] == (-0.25, 1.0) and at["b"] == (0.0, 1.0) and at["g"] == (0.25, 1.0) and at["e"] == (0.0, 0.0) and at["d"] == (round(1 / 3 - 0.5, 6), round(1 / 3, 6))
    assert {r.y for r in g.layout(spark.createDataFrame([("x", 0)], "node string, layer int")).collect()} == {0.5}
    seen = {r.entry: r.colour for r in g.legend(g.classify(e), "d", collapsed=True).collect()}
    assert seen == {"Focus Target": "#FFD700", "Source Table": "#90EE90", "Target Table": "#F08080"}
    assert g.title("All") == "All" and g.title("x", "t", 2, True) == "Data Lineage: t (Depth=2) - Intermediates Collapsed"


def test_view(spark):
    nodes, shown = g.lineage_view(edges(spark), "f", collapsed=True)
    assert pairs(shown) == [("a", "f"), ("b", "f"), ("g", "f")]
    assert {r.node: r.colour for r in nodes.collect()} == {"a": "#90EE90", "b": "#90EE90", "g": "#90EE90", "f": "#FFD700"}


def test_more_hops_than_are_kept_apart(spark):
    chain = edges(spark, [(i, f"n{i:02}", f"n{i + 1:02}") for i in range(11)])
    assert {r.node: r.dist for r in g.upstream(chain, "n11").collect()} == {f"n{i:02}": 11 - i for i in range(12)}
    assert pairs(g.collapse(chain, g.classify(chain))) == [("n00", "n11")]


def test_cycles(spark):
    assert not g.has_cycle(edges(spark)).first()["has_cycle"] and g.one_cycle(edges(spark)) == []
    loop = edges(spark, [*EDGES, (7, "e", "g"), (8, "x", "x")])
    assert g.has_cycle(loop).first()["has_cycle"]
    assert sorted(g.one_cycle(loop)) == [("d", "e"), ("e", "g"), ("g", "d")]
    assert not g.has_cycle(edges(spark, [])).first()["has_cycle"] and g.one_cycle(edges(spark, [])) == []
    assert g.one_cycle(edges(spark, [(0, "x", "x")])) == [("x", "x")]
    long = edges(spark, [(i, f"n{i:03}", f"n{(i + 1) % 100 + 20 * (i == 99):03}") for i in range(100)])  # a tail of 20 leads into a loop of 80
    part = g.one_cycle(long)
    assert len(part) == 3 and all(a[1] == b[0] for a, b in zip(part, part[1:])) and min(a for a, _ in part) >= "n020"


def test_paths(spark):
    e = edges(spark, [*EDGES, (7, "d", "c")])
    found = lambda *a, **k: [r.path for r in g.simple_paths(e, *a, **k).orderBy("path_no").collect()]
    assert found("a", "f") == [["a", "c", "d", "f"], ["a", "c", "f"]]
    assert found("a", "f", longest=2) == [["a", "c", "f"]] and found("a", "f", most=1) == [["a", "c", "d", "f"]] and found("a", "f", most=None) == found("a", "f")
    assert found("a", "a") == found("e", "a") == found("nowhere", "f") == found("a", "nowhere") == []


def test_dot(spark, tmp_path):
    text = g.write_dot(edges(spark, [(0, "a", "c"), (1, "b", "c"), (2, "c", "d"), (3, "a", "d")]), str(tmp_path / "x.dot"))
    assert text == (tmp_path / "x.dot").read_text()
    body = [x.strip() for x in text.splitlines()]
    assert body[4:8] == ['"a" [fillcolor="#90EE90"];', '"c" [fillcolor="#ADD8E6"];', '"b" [fillcolor="#90EE90"];', '"d" [fillcolor="#F08080"];']
    assert body[9:] == ['"a" -> "c";', '"a" -> "d";', '"c" -> "d";', '"b" -> "c";', "}"]


def test_ranks_of_a_hot_key(spark):
    df = spark.range(5000).select((F.col("id") >= 4900).cast("int").alias("k"), (F.col("id") * 7919 % 5003).alias("v"))
    rows = ranked(df, ["k"], ["v"]).collect()
    for k in (0, 1):
        mine = sorted((r.v, r["rank"]) for r in rows if r.k == k)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    clash = spark.createDataFrame([("p", 1, 2, 3)], "k string, _part int, PART int, start int")
    assert ranked(clash, ["k"], ["start"]).first().asDict() == {"k": "p", "_part": 1, "PART": 2, "start": 3, "rank": 1}


def test_edges_collapse_parallel_ones(spark):
    df = spark.createDataFrame([(0, "t", ["a", "b"]), (1, "u", []), (2, "t", ["b", "c"])], "i long, target string, sources array<string>")
    assert sorted((r.src, r.tgt, r.row) for r in edges_of(df, "i").collect()) == [("a", "t", 0), ("b", "t", 0), ("c", "t", 2)]


# ---- store, files, streams


def test_store(spark, tmp_path):
    store = st.LineageStore(spark, str(tmp_path / "store"))
    scripts = spark.createDataFrame([("f", "INSERT INTO zx_a.t SELECT 1 FROM zx_b.u; UPDATE zx_b.u SET x = (SELECT 1 FROM zx_c.v)")], "filename string, content string")
    rows = with_lineage(statements(scripts), P, "full_sql").withColumn("error", F.when(F.col("statement_index") == 2, "failed"))
    store.add(rows)
    assert store.results().count() == 1
    store.add(rows.withColumn("error", F.lit(None).cast("string")))  # the failed one is tried again, the other isn't kept twice
    assert store.results().count() == 2
    assert st.lookup_counts(store.results(), " ZX_b.u ").first() == (1, 1)
    assert {(r.side, r.node) for r in st.neighbourhood(store.results(), "zx_b.u").collect()} == {("up", "zx_c.v"), ("down", "zx_a.t")}
    assert [r.source_count for r in st.overview(store.results()).collect()] == [1, 1]
    store.clear()
    assert store.results().count() == 0


def test_display_limits(spark):
    names = [f"n{i:02d}" for i in range(25)]
    around = spark.createDataFrame([("up", n) for n in names] + [("down", "x")], "side string, node string")
    rows = sorted((r.side, r.position, r.node) for r in st.first_of_sides(around).collect())
    assert rows[0] == ("down", 1, "x") and [r[2] for r in rows[1:]] == [*names[:15], "..."]
    r = spark.createDataFrame([(names,)], "s array<string>").select(st.shown_sources(F.col("s")).alias("a"), F.size(st.drawn_sources(F.col("s"))).alias("b")).first()
    assert r["a"].endswith("n09 and 15 more") and r["b"] == 20


def test_files(spark, tmp_path):
    (tmp_path / "a.sql").write_text("INSERT INTO zx_a.т SELECT 1;\nSELECT 2", encoding="utf-8")
    (tmp_path / "b.txt").write_text("SELECT 3")
    (tmp_path / "c.md").write_text("no")
    rows = {r.filename: r.content for r in files.read_scripts(spark, str(tmp_path)).collect()}
    assert rows == {"a.sql": "INSERT INTO zx_a.т SELECT 1;\nSELECT 2", "b.txt": "SELECT 3"}
    (tmp_path / "views.csv").write_text('table_name,view_def\nv1,"SELECT ""a""\nFROM zx_b.u"\nv2,\n')
    views = files.view_statements(files.read_view_catalogue(spark, str(tmp_path / "views.csv")), "zx_v")
    assert [(r.table_name, r.sql) for r in views.orderBy("table_name").collect()] == [("v1", 'INSERT INTO zx_v.v1 SELECT "a"\nFROM zx_b.u'), ("v2", None)]
    assert files.lineage_records(spark, {"target": "t", "sources": ["a"]}).count() == 1 and files.lineage_records(spark, [{"target": None}]).first()["sources"] is None
    assert files.access_token("x", env={}) == "x" and files.access_token(env={"HUGGINGFACEHUB_API_TOKEN": "b", "HF_TOKEN": "a"}) == "a" and files.access_token(env={}) is None
    df = spark.createDataFrame([("t", ["a"])], "target string, sources array<string>")
    assert json.loads(export.lineage_json(df).first()["json"]) == {"target": "t", "sources": ["a"]}
    export.write_lineage(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_stream_stores_each_statement_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("INSERT INTO zx_a.t SELECT 1 FROM zx_b.u; SELECT 1 FROM zx_c.v")
    store = st.LineageStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest(script_stream(spark, str(tmp_path / "in")), store, P, str(tmp_path / "checkpoint")).awaitTermination()
        (tmp_path / "in" / "b.sql").write_text("INSERT INTO zx_a.w SELECT 1 FROM zx_b.u")
    assert sorted(r.stmt_key.rpartition("/")[2] for r in store.results().collect()) == ["a.sql#1", "a.sql#2", "b.sql#1"]


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "a.sql").write_text(f"INSERT INTO zx_a.{folder} SELECT 1")
    scripts = files.read_scripts(spark, [str(tmp_path / "in" / "x"), str(tmp_path / "in" / "y")])
    rows = with_lineage(statements(scripts), P, "full_sql")
    store = st.LineageStore(spark, str(tmp_path / "store"))
    store.add(rows.unionByName(rows))  # a statement of the batch twice
    store.add(rows)
    assert sorted((r.filename, r.target) for r in store.results().collect()) == [("a.sql", "zx_a.x"), ("a.sql", "zx_a.y")]


def test_the_shared_folder_of_a_cluster_is_asked_for(monkeypatch):
    from types import SimpleNamespace

    from weftline.sources.shared import shared_root

    unset = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_root(SimpleNamespace(sparkContext=unset))
    assert shared_root(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: {"spark.checkpoint.dir": "hdfs:///x/"}, master="yarn"))) == "hdfs:///x"


# ---- models, refinement, agents


def flaky(fail_times, answer):
    def make():
        calls = []

        def client(prompt):
            calls.append(prompt)
            if len(calls) <= fail_times:
                raise RuntimeError("down")
            return answer

        return client

    return make


def test_retries(spark):
    prompts = spark.createDataFrame([("p",)], "prompt string").coalesce(1)
    good = respond(prompts, flaky(2, "yes"), 3, wait=lambda k: 0).first()
    assert (good["response"], good["error"]) == ("yes", None)
    bad = respond(prompts, flaky(3, "yes"), 3, wait=lambda k: 0).first()
    assert bad["response"] is None and bad["error"] == "Max retries exceeded: down"
    assert respond(spark.createDataFrame([(None,)], "prompt string"), flaky(0, "x"), 1).first()["error"] == "no prompt"
    assert respond(prompts.limit(0), flaky(0, "x"), 1).count() == 0


def test_a_call_that_hangs_is_given_up(spark):
    def hanging():
        import time

        return lambda prompt: time.sleep(60) if prompt == "hang" else prompt.upper()

    prompts = spark.createDataFrame([("a",), ("hang",), ("b",)], "prompt string").coalesce(1)
    rows = {r.prompt: r for r in respond(prompts, hanging, 2, wait=lambda k: 0, timeout=0.5).collect()}
    assert rows["a"].response == "A" and rows["b"].response == "B" and rows["hang"].response is None and "no answer within 0.5 s" in rows["hang"].error
    paused = respond(prompts.filter("prompt <> 'hang'"), hanging, 1, delay=0.6).agg(F.max("processing_time")).first()[0]
    assert paused < 0.5  # the pause between calls isn't a call's time


def test_client_over_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.headers["Authorization"], body))
            said = json.dumps({"choices": [{"message": {"content": '{"target": "ZX_a.t", "sources": ["zx_b.u"]}'}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    backend = http_backend(f"http://127.0.0.1:{server.server_port}/v1/chat/completions", "m", files.access_token("secret"), max_new_tokens=7, do_sample=True, temperature=0.5)
    row = LineageExtractor(backend).extract(spark.createDataFrame([("INSERT INTO zx_a.t SELECT 1 FROM zx_b.u",)], "sql string")).first()
    server.shutdown()
    assert (row.target, row.sources, row.error) == ("zx_a.t", ["zx_b.u"], None)
    assert asked[0][0] == "Bearer secret" and asked[0][1]["max_tokens"] == 7 and asked[0][1]["temperature"] == 0.5 and "zx_b.u" in asked[0][1]["messages"][0]["content"]


def test_extractor(spark):
    e = create_extractor("m", backend=stub_backend(P), wait=lambda k: 0, max_retries=2)
    rows = e.extract(spark.createDataFrame([(1, "INSERT INTO zx_a.T SELECT 1 FROM zx_b.u"), (2, "nothing" * 30), (3, None)], "i int, sql string")).orderBy("i").collect()
    assert (rows[0]["target"], rows[0]["sources"], rows[0]["error"]) == ("zx_a.t", ["zx_b.u"], None)
    assert rows[1]["target"] == "" and rows[1]["sources"] == [] and rows[1]["error"] and len(rows[1]["query"]) == 100
    assert rows[2]["error"] is not None
    assert create_extractor(wait=lambda k: 0).works(spark) and e.config()["model"] == "m"


def test_scores(spark):
    views = spark.createDataFrame([("v1", "SELECT 1 FROM zx_b.u"), ("v2", "SELECT 1 FROM zx_b.u, zx_c.w"), ("v2", "SELECT 1"), ("v3", None)], "table_name string, view_def string")
    e = LineageExtractor(stub_backend(P), wait=lambda k: 0)
    s = score_catalogue(views, e, "zx_v", P)
    assert {r.table_name: r.f1_score for r in s.by_table.collect()} == {"v1": 1.0, "v2": 1.0} and s.mean_f1.first()["mean_f1"] == 1.0
    assert s.pivot.first()["comprehensive"] == 3.0 and s.pivot.first()["target"] == 0.0 and s.success.first() == (1.0, 1.0, 1.0)
    both = compare_extractors(views, {"good": e, "bad": LineageExtractor(flaky(99, ""), max_retries=1, wait=lambda k: 0)}, "zx_v", P)
    assert {r.prompt_id: (r.n, r.success_rate) for r in both.collect()} == {"good": (3, 1.0), "bad": (3, 0.0)}


def test_refiner_caches_successes(spark, tmp_path):
    sql = "INSERT INTO zx_a.t SELECT '1'::text FROM zx_b.u"
    df = spark.createDataFrame([(1, sql), (2, sql), (3, "SELECT 2")], "i int, sql string")
    answer = "```sql\n" + sql.replace("::text", "") + "\n```"
    r = Refiner(spark, flaky(0, answer), str(tmp_path / "cache"), retry_delay=0, delay_between=0)
    rows = {x.i: x for x in r.refine(df).collect()}
    assert rows[1].success and rows[1].validation["passed"] and rows[1].stats["issue_count"] == 1 and rows[1].refined_sql == rows[2].refined_sql
    assert not rows[3].validation["passed"] and not rows[1].from_cache
    again = Refiner(spark, flaky(99, ""), str(tmp_path / "cache"), retry_delay=0, delay_between=0).refine(df)
    assert all(x.from_cache and x.success for x in again.collect())
    reports = export.refinement_reports(again).collect()
    assert json.loads(reports[0]["report"])["metadata"]["from_cache"] is True
    assert export.save_report(again, str(tmp_path / "report.json")) and not export.save_report(again, "/nowhere/x.json")
    r.clear_cache()
    failed = Refiner(spark, flaky(99, ""), str(tmp_path / "cache"), max_retries=1, retry_delay=0, delay_between=0).refine(df.limit(1)).first()
    assert not failed["success"] and failed["validation"] is None


def test_session_stats(spark):
    df = spark.createDataFrame([(True, 1.25, 10), (False, 2.0, 5), (True, 0.5, 6)], "success boolean, processing_time double, estimated_tokens long")
    s = session_stats(df).first()
    assert (s.total_requests, s.successful_requests, s.failed_requests, s.total_tokens, s.success_rate, s.average_time, s.average_tokens) == (3, 2, 1, 21, 66.67, 1.25, 7.0)
    assert session_stats(df.limit(0)).first()["success_rate"] == 0


def test_best_prompt_is_the_first_of_the_best(spark):
    rows = [(1, 1, "SUCCESS", 0.5), (1, 2, "SUCCESS", 0.9), (1, 3, "SUCCESS", 0.9), (2, 1, "FAILED", None), (3, 1, "SUCCESS", None), (3, 2, "FAILED", 1.0)]
    got = {r.run_id: (r.iteration_found, r.f1_score) for r in best_prompt(spark.createDataFrame(rows, "run_id int, iteration int, status string, f1 double")).collect()}
    assert got == {1: (2, 0.9), 2: (0, -1.0), 3: (0, -1.0)}


def test_agent(spark, tmp_path):
    sql, expected = "INSERT INTO zx_a.t SELECT 1 FROM zx_b.u", ["zx_b.u"]
    better = "A better prompt that is long enough to be taken: name all tables with schemas."
    perfect = PromptOptimiser(spark, LineageExtractor(stub_backend(P), wait=lambda k: 0), lambda p: better).optimise(sql, "first", expected, str(tmp_path / "h.json"))
    assert perfect["is_perfect"] and perfect["iterations"] == 0 and perfect["optimized_prompt"] == "first" and perfect["iteration_found"] == 1
    assert json.loads((tmp_path / "h.json").read_text())["iteration_details"][0]["prompt"] == "first"
    failing = PromptOptimiser(spark, LineageExtractor(flaky(99, ""), max_retries=1, wait=lambda k: 0), lambda p: "# short", max_iterations=9)
    out = failing.optimise(sql, "first", expected)
    assert out["iterations"] == 5 and len(out["validation_history"]) == 6 and out["f1_score"] == -1 and out["iteration_found"] == 0
    assert out["all_prompts"][0] == "first" + FALLBACK and out["optimized_prompt"] == "first"
    unknown = PromptOptimiser(spark, LineageExtractor(stub_backend(P), wait=lambda k: 0), lambda p: better, max_iterations=2).optimise(sql, "first")
    assert unknown["iterations"] == 1 and unknown["all_prompts"] == [better]
    save_history(out | {"all_prompts": []}, str(tmp_path / "x.json"), sql, expected)
    assert json.loads((tmp_path / "x.json").read_text())["iteration_details"][1]["prompt"] == ""
