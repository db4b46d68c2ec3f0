"""Queries of the lineage graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph as g
from weftline.operators import lineage as ops
from weftline.queries import base as b
from weftline.queries.base import D_LINEAGE, EDGES_CYCLIC, d_edges, query

_KIND = "CASE WHEN max(w) = 0 THEN 'source' WHEN max(r) = 0 THEN 'target' ELSE 'intermediate' END"
_COLOUR = "CASE kind WHEN 'source' THEN '#90EE90' WHEN 'target' THEN '#F08080' ELSE '#ADD8E6' END"
D_CLASSES = f"classes AS (SELECT node, {_KIND} AS kind FROM (SELECT src AS node, 1 AS r, 0 AS w FROM edges UNION ALL SELECT tgt, 0, 1 FROM edges) GROUP BY node)"


@query(f"""WITH {D_LINEAGE}, e AS (SELECT stmt_id, unnest(sources) AS src, unnest(range(0, len(sources))) AS at, target AS tgt FROM lineage)
SELECT src, tgt, min(stmt_id) AS seq FROM e GROUP BY src, tgt""")
def build_edges(spark, sf_dir):
    return ops.edges_of(b.lineage(spark, sf_dir), "stmt_id").select("src", "tgt", F.col("row").alias("seq"))


@query(f"WITH {d_edges()}, {D_CLASSES} SELECT node, kind, {_COLOUR} AS colour FROM classes")
def node_class_color(spark, sf_dir):
    return g.classify(b.edges(spark, sf_dir))


_UP = "up AS (SELECT '{t}' AS node, 0 AS dist UNION SELECT e.src, u.dist + 1 FROM up u JOIN edges e ON e.tgt = u.node {more})"


@query(f"WITH RECURSIVE {d_edges()}, {_UP.format(t='order_7', more='')} SELECT node, min(dist) AS dist FROM up GROUP BY node")
def upstream_unbounded(spark, sf_dir):
    return g.upstream(b.edges(spark, sf_dir), "order_7")


@query(f"WITH RECURSIVE {d_edges()}, {_UP.format(t='order_7', more='WHERE u.dist < 2')} SELECT node, min(dist) AS dist FROM up GROUP BY node")
def upstream_depth(spark, sf_dir):
    return g.upstream(b.edges(spark, sf_dir), "order_7", 2)


@query(f"""WITH RECURSIVE {d_edges(EDGES_CYCLIC)}, up AS (SELECT 'customer_5' AS node UNION SELECT e.src FROM up u JOIN edges e ON e.tgt = u.node) SELECT node FROM up""")
def upstream_cyclic(spark, sf_dir):
    return g.upstream(b.edges(spark, sf_dir, EDGES_CYCLIC), "customer_5").select("node")


@query(f"""WITH RECURSIVE {d_edges()}, {_UP.format(t='order_7', more='')}, {D_CLASSES}, kept AS (SELECT DISTINCT node FROM up)
SELECT e.src, e.tgt, CASE WHEN e.tgt = 'order_7' THEN '#FFD700' ELSE (SELECT {_COLOUR} FROM classes c WHERE c.node = e.tgt) END AS tgt_colour
FROM edges e WHERE src IN (SELECT node FROM kept) AND tgt IN (SELECT node FROM kept)""")
def upstream_subgraph(spark, sf_dir):
    e = b.edges(spark, sf_dir)
    part = g.induced(e, g.upstream(e, "order_7"))
    colours = g.highlighted(g.classify(e), "order_7").select(F.col("node").alias("tgt"), F.col("colour").alias("tgt_colour"))
    return part.join(colours, "tgt").select("src", "tgt", "tgt_colour")


@query(f"""WITH RECURSIVE {d_edges()}, {D_CLASSES}, inner_ AS (SELECT node FROM classes WHERE kind = 'intermediate'),
walk AS (SELECT src, tgt FROM edges WHERE src NOT IN (SELECT node FROM inner_) UNION SELECT w.src, e.tgt FROM walk w JOIN edges e ON e.src = w.tgt WHERE w.tgt IN (SELECT node FROM inner_))
SELECT DISTINCT src, tgt FROM walk WHERE tgt NOT IN (SELECT node FROM inner_) AND src <> tgt""")
def collapse_intermediates(spark, sf_dir):
    e = b.edges(spark, sf_dir)
    return g.collapse(e, g.classify(e))


_DIST = "dist AS (SELECT src AS origin, src AS node, 0 AS d FROM edges WHERE src NOT IN (SELECT tgt FROM edges) UNION SELECT x.origin, e.tgt, x.d + 1 FROM dist x JOIN edges e ON e.src = x.node)"
_LAYERS = f"{_DIST}, short AS (SELECT origin, node, min(d) AS d FROM dist GROUP BY origin, node), layers AS (SELECT node, max(d) AS layer FROM short GROUP BY node)"


@query(f"WITH RECURSIVE {d_edges()}, {_LAYERS} SELECT * FROM layers")
def layers_full(spark, sf_dir):
    return g.layers(b.edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {d_edges()}, {_UP.format(t='customer_5', more='')} SELECT n.node, CAST(coalesce(min(u.dist), 0) AS INT) AS layer
FROM (SELECT src AS node FROM edges UNION SELECT tgt FROM edges) n LEFT JOIN up u ON u.node = n.node GROUP BY n.node""")
def layers_focus(spark, sf_dir):
    return g.layers(b.edges(spark, sf_dir), "customer_5")


@query(f"""WITH RECURSIVE {d_edges()}, {_LAYERS} SELECT node, layer, round(row_number() OVER (PARTITION BY layer ORDER BY node) / (count(*) OVER (PARTITION BY layer) + 1.0) - 0.5, 6) AS x,
round(1 - layer / CAST(max(layer) OVER () AS DOUBLE), 6) AS y FROM layers""")
def layout_coords(spark, sf_dir):
    return g.layout(g.layers(b.edges(spark, sf_dir))).select("node", "layer", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""WITH {d_edges()}, {D_CLASSES} SELECT DISTINCT CASE WHEN node = 'nation_3' THEN 'Focus Target' WHEN kind = 'source' THEN 'Source Table' WHEN kind = 'target' THEN 'Target Table' ELSE 'Intermediate Table' END AS entry,
CASE WHEN node = 'nation_3' THEN '#FFD700' ELSE {_COLOUR} END AS colour FROM classes""")
def legend(spark, sf_dir):
    return g.legend(g.classify(b.edges(spark, sf_dir)), "nation_3")


@query(f"""WITH {d_edges()}, {D_CLASSES} SELECT kind AS metric, count(*) AS value FROM classes GROUP BY kind UNION ALL SELECT 'tables', count(*) FROM classes
UNION ALL SELECT 'relationships', count(*) FROM (SELECT DISTINCT src, tgt FROM edges)""")
def graph_summary(spark, sf_dir):
    e = b.edges(spark, sf_dir)
    return g.summary(e, g.classify(e))


def _cycle(edges):
    return f"WITH RECURSIVE {d_edges(edges)}, walk AS (SELECT src AS o, tgt AS n FROM edges UNION SELECT w.o, e.tgt FROM walk w JOIN edges e ON e.src = w.n) SELECT count(*) > 0 AS has_cycle FROM walk WHERE o = n"


@query(_cycle(EDGES_CYCLIC))
def has_cycle(spark, sf_dir):
    return g.has_cycle(b.edges(spark, sf_dir, EDGES_CYCLIC))


@query(_cycle(b.EDGES))
def has_no_cycle(spark, sf_dir):
    return g.has_cycle(b.edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {d_edges(EDGES_CYCLIC)}, paths AS (SELECT ['region_0'] AS p, CAST([] AS BIGINT[]) AS s UNION ALL
SELECT list_append(x.p, e.tgt), list_append(x.s, e.seq) FROM paths x JOIN edges e ON e.src = x.p[-1] WHERE NOT list_contains(x.p, e.tgt) AND len(x.s) < 10 AND x.p[-1] <> 'customer_8'),
best AS (SELECT p, s FROM paths WHERE p[-1] = 'customer_8' AND len(s) > 0 ORDER BY s LIMIT 5)
SELECT row_number() OVER (ORDER BY s) AS path_no, array_to_string(p, '>') AS path FROM best""")
def simple_paths(spark, sf_dir):
    return g.simple_paths(b.edges(spark, sf_dir, EDGES_CYCLIC), "region_0", "customer_8").select("path_no", F.array_join("path", ">").alias("path"))


_QUOTE = "chr(34)"


@query(f"""WITH {d_edges()}, {D_CLASSES}, seen AS (SELECT node, min(s) AS node_seq FROM (SELECT src AS node, 2 * seq AS s FROM edges UNION ALL SELECT tgt, 2 * seq + 1 FROM edges) GROUP BY node),
lines AS (SELECT 0 AS part, i AS a, 0 AS b, l AS line FROM (VALUES (0, 'digraph DataLineage {{'), (1, '  rankdir=TB;'), (2, '  node [shape=box, style=filled];'), (3, '')) v(i, l)
UNION ALL SELECT 1, node_seq, 0, '  ' || {_QUOTE} || node || {_QUOTE} || ' [fillcolor=' || {_QUOTE} || {_COLOUR} || {_QUOTE} || '];' FROM classes JOIN seen USING (node)
UNION ALL SELECT 2, 0, 0, '' UNION ALL SELECT 3, node_seq, seq, '  ' || {_QUOTE} || src || {_QUOTE} || ' -> ' || {_QUOTE} || tgt || {_QUOTE} || ';' FROM edges JOIN seen ON seen.node = edges.src
UNION ALL SELECT 4, 0, 0, '}}') SELECT row_number() OVER (ORDER BY part, a, b) AS line_no, line FROM lines""")
def dot_export(spark, sf_dir):
    return g.dot_lines(b.edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {d_edges()}, {_UP.format(t='customer_5', more='')}, {D_CLASSES},
inner_ AS (SELECT node FROM classes WHERE kind = 'intermediate' AND node <> 'customer_5'), part AS (SELECT * FROM edges WHERE src IN (SELECT node FROM up) AND tgt IN (SELECT node FROM up)),
walk AS (SELECT src, tgt FROM part WHERE src NOT IN (SELECT node FROM inner_) UNION SELECT w.src, e.tgt FROM walk w JOIN part e ON e.src = w.tgt WHERE w.tgt IN (SELECT node FROM inner_)),
shown AS (SELECT DISTINCT src, tgt FROM walk WHERE tgt NOT IN (SELECT node FROM inner_)), n AS (SELECT src AS node FROM shown UNION SELECT tgt FROM shown)
SELECT n.node, CASE WHEN n.node = 'customer_5' THEN '#FFD700' ELSE {_COLOUR} END AS colour FROM n JOIN classes USING (node)""")
def lineage_view(spark, sf_dir):
    found, _ = g.lineage_view(b.edges(spark, sf_dir), "customer_5", collapsed=True)
    return found.select("node", "colour")
