"""The lineage graph: edges (seq, src, tgt), and all that is asked of it, as DataFrame programs.

Fix-points run as loops on the driver; each round is a join of the frontier with the edges, less what was seen
already, and ends lineage in a written table, so that cycles end and a lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranking import ranked
from weftline.sources.shared import stored

COLOURS = {"source": "#90EE90", "target": "#F08080", "intermediate": "#ADD8E6", "focus": "#FFD700"}


class UnknownNode(ValueError):
    """A node that the graph doesn't have."""


def nodes(edges: DataFrame) -> DataFrame:
    """node and node_seq, its place in the order of first sight: edges in order, source before target."""
    sides = edges.select(F.col("src").alias("node"), (F.col("seq") * 2).alias("s")).unionByName(edges.select(F.col("tgt").alias("node"), (F.col("seq") * 2 + 1).alias("s")))
    return sides.groupBy("node").agg(F.min("s").alias("node_seq"))


def classify(edges: DataFrame, loose_targets: DataFrame | None = None) -> DataFrame:
    """node, kind (source, target, intermediate) and colour.

    loose_targets: a column tgt of targets that may have no source; those count as targets, though not as nodes of edges.
    """
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("reads"), F.lit(0).alias("writes")).unionByName(
        edges.select(F.col("tgt").alias("node"), F.lit(0).alias("reads"), F.lit(1).alias("writes"))
    )
    if loose_targets is not None:
        ends = ends.unionByName(loose_targets.select(F.col("tgt").alias("node"), F.lit(0).alias("reads"), F.lit(1).alias("writes")))
    sides = ends.groupBy("node").agg(F.max("reads").alias("reads"), F.max("writes").alias("writes"))
    kind = F.when(F.col("writes") == 0, "source").when(F.col("reads") == 0, "target").otherwise("intermediate")
    return sides.select("node", kind.alias("kind")).withColumn("colour", _colour(F.col("kind")))


def _colour(kind):
    out = F
    for name, colour in COLOURS.items():
        out = out.when(kind == name, F.lit(colour))
    return out


def highlighted(classes: DataFrame, focus: str) -> DataFrame:
    """The classes with the focus in gold."""
    return classes.withColumn("colour", F.when(F.col("node") == focus, COLOURS["focus"]).otherwise(F.col("colour")))


#: Rounds whose rows are read from where each was written before they are written together.
ROUNDS_APART = 8


def _more(seen: DataFrame, found: DataFrame, round_: int) -> DataFrame:
    """seen and what a round found; both are stored, so that nothing is written again until several rounds have come."""
    both = seen.unionByName(found)
    return stored(both, "seen") if round_ % ROUNDS_APART == 0 else both


def distances(edges: DataFrame, seeds: DataFrame, depth: int | None = None, upstream: bool = False) -> DataFrame:
    """(origin, node, dist): the fewest edges from each seed (column node) to the nodes it reaches, itself at 0."""
    a, b = ("tgt", "src") if upstream else ("src", "tgt")
    # every round reads the links: made once, they aren't shuffled to be distinct again and again
    links = stored(edges.select(F.col(a).alias("at"), F.col(b).alias("to")).distinct(), "links")
    seen = stored(seeds.select(F.col("node").alias("origin"), "node").distinct().withColumn("dist", F.lit(0)), "seen")
    frontier, hop = seen, 0
    while depth is None or hop < depth:
        hop += 1
        step = frontier.join(links, F.col("node") == F.col("at")).select("origin", F.col("to").alias("node")).distinct()
        frontier = stored(step.join(seen, ["origin", "node"], "left_anti").withColumn("dist", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        seen = _more(seen, frontier, hop)
    return seen


def upstream(edges: DataFrame, target: str, depth: int | None = None) -> DataFrame:
    """(node, dist) of the target and all that it is made from, up to depth edges away; UnknownNode if there is none."""
    seed = edges.select(F.explode(F.array("src", "tgt")).alias("node")).filter(F.col("node") == target).limit(1)
    found = distances(edges, seed, depth, upstream=True).select("node", "dist")
    if found.isEmpty():
        raise UnknownNode(target)
    return found


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among the kept nodes (column node)."""
    names = kept.select("node").distinct()
    half = edges.join(names.withColumnRenamed("node", "src"), "src", "left_semi")
    return half.join(names.withColumnRenamed("node", "tgt"), "tgt", "left_semi").select(edges.columns)


def collapse(edges: DataFrame, classes: DataFrame, focus: str | None = None) -> DataFrame:
    """(src, tgt) between the nodes that aren't intermediate: joined where a path runs through intermediates alone.

    The focus stays too. Edges between kept nodes stay as they are; joins make no loops.
    """
    inner = classes.filter((F.col("kind") == "intermediate") & ~F.col("node").eqNullSafe(F.lit(focus))).select("node")
    inner = stored(inner.distinct(), "inner")
    links = edges.select("src", "tgt").distinct()
    into = links.join(inner, links.tgt == inner.node, "left_semi")
    out_of = stored(links.join(inner, links.src == inner.node, "left_semi").select(F.col("src").alias("via"), F.col("tgt").alias("to")), "out-of-inner")
    walks = stored(into.join(inner, F.col("src") == F.col("node"), "left_anti"), "walks")
    seen, hop = walks, 0
    while not walks.isEmpty():
        hop += 1
        step = walks.join(out_of, F.col("tgt") == F.col("via")).select("src", F.col("to").alias("tgt")).distinct()
        walks = stored(step.join(seen, ["src", "tgt"], "left_anti"), "walks")
        seen = _more(seen, walks, hop)
    joined = seen.join(inner, F.col("tgt") == F.col("node"), "left_anti").filter("src <> tgt")
    direct = links.join(inner, F.col("src") == F.col("node"), "left_anti").join(inner, F.col("tgt") == F.col("node"), "left_anti")
    return direct.unionByName(joined).distinct()


def layers(edges: DataFrame, focus: str | None = None) -> DataFrame:
    """(node, layer): distance to the focus (0 without a path), or the longest of the shortest paths from sources."""
    every = edges.select(F.explode(F.array("src", "tgt")).alias("node")).distinct()
    if focus is not None:
        near = distances(edges, every.filter(F.col("node") == focus), upstream=True).select("node", F.col("dist").alias("layer"))
    else:
        roots = every.join(edges.select(F.col("tgt").alias("node")), "node", "left_anti")
        near = distances(edges, roots).groupBy("node").agg(F.max("dist").alias("layer"))
    return every.join(near, "node", "left").select("node", F.coalesce("layer", F.lit(0)).cast("int").alias("layer"))


def layout(layered: DataFrame) -> DataFrame:
    """(node, layer, x, y): sources at the top, names in order within a layer."""
    # read four times: for the top, the sizes, the bounds of the range parts, and the ranks
    layered = stored(layered, "layered")
    top = layered.agg(F.max("layer").alias("top"))
    sizes = layered.groupBy("layer").agg(F.count("*").alias("n"))
    placed = ranked(layered, ["layer"], ["node"], "i").join(sizes, "layer").crossJoin(F.broadcast(top))  # top is one row
    y = F.when(F.col("top") > 0, 1 - F.col("layer") / F.greatest("top", F.lit(1))).otherwise(0.5)
    return placed.select("node", "layer", (F.col("i") / (F.col("n") + 1) - 0.5).alias("x"), y.alias("y"))


def legend(visible: DataFrame, focus: str | None = None, collapsed: bool = False) -> DataFrame:
    """(entry, colour) of what the visible nodes (node, kind) hold, the focus apart."""
    names = {"source": "Source Table", "target": "Target Table", "intermediate": "Intermediate Table", "focus": "Focus Target"}
    kind = F.when(F.col("node").eqNullSafe(F.lit(focus)), "focus").otherwise(F.col("kind"))
    shown = visible.select(kind.alias("kind")).distinct()
    if collapsed:
        shown = shown.filter("kind <> 'intermediate'")
    entry = F
    for k, name in names.items():
        entry = entry.when(F.col("kind") == k, F.lit(name))
    return shown.select(entry.alias("entry"), _colour(F.col("kind")).alias("colour"))


def summary(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(metric, value): counts of tables, relationships, and tables of each class."""
    kinds = classes.groupBy("kind").agg(F.count("*").alias("value")).select(F.col("kind").alias("metric"), "value")
    table_count = nodes(edges).agg(F.count("*").alias("value")).select(F.lit("tables").alias("metric"), "value")
    links = edges.select("src", "tgt").distinct().agg(F.count("*").alias("value")).select(F.lit("relationships").alias("metric"), "value")
    return table_count.unionByName(links).unionByName(kinds)


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without incoming or without outgoing edges are peeled off again and again."""
    left = stored(edges.select("src", "tgt").distinct(), "core")
    n = left.count()
    while n:
        fed = left.join(left.select(F.col("tgt").alias("src")).distinct(), "src", "left_semi")
        rest = stored(fed.join(fed.select(F.col("src").alias("tgt")).distinct(), "tgt", "left_semi").select("src", "tgt"), "core")
        now = rest.count()
        if now == n:
            break
        left, n = rest, now
    return left


def has_cycle(edges: DataFrame) -> DataFrame:
    """One row: has_cycle."""
    return cyclic_core(edges).agg((F.count("*") > 0).alias("has_cycle"))


def one_cycle(edges: DataFrame, most: int = 3) -> list[tuple[str, str]]:
    """The first edges of a cycle, most of them; none if there is none.

    From each node of the core one edge is kept, that to its least successor. As many steps as there are nodes, in
    jumps that double, lead from the least node to one on a cycle; there the listed edges begin. Jobs grow with the
    logarithm of the core's size.
    """
    step = stored(cyclic_core(edges).groupBy("src").agg(F.min("tgt").alias("tgt")), "steps")
    n = step.count()
    jump, length = step, 1
    while length < n:
        second = jump.select(F.col("src").alias("tgt"), F.col("tgt").alias("far"))
        jump, length = stored(jump.join(second, "tgt").select("src", F.col("far").alias("tgt")), "jumps"), 2 * length
    at = jump.agg(F.min_by("tgt", "src").alias("n")).first()["n"]
    out: list[tuple[str, str]] = []
    while at is not None and len(out) < most and (not out or at != out[0][0]):
        to = step.filter(F.col("src") == at).first()["tgt"]
        out.append((at, to))
        at = to
    return out


def simple_paths(edges: DataFrame, source: str, target: str, most: int | None = 5, longest: int = 10) -> DataFrame:
    """(path_no, path): the first paths from source to target without a repeated node, of at most longest edges.

    In the order of a depth-first walk that takes edges by seq. Steps that can't reach the target in the edges left
    aren't taken. Unknown nodes, or source = target, give no path.
    """
    spark = edges.sparkSession
    back = distances(edges, spark.createDataFrame([(target,)], "node string"), longest, upstream=True).select(F.col("node").alias("to"), "dist")
    links = edges.groupBy("src", "tgt").agg(F.min("seq").alias("seq"))
    links = stored(links.join(back, F.col("tgt") == F.col("to")).select(F.col("src").alias("at"), "to", "seq", "dist"), "path-links")
    paths = spark.createDataFrame([(source, [source], [])] if source != target else [], "at string, path array<string>, steps array<long>")
    done = None
    for used in range(longest):
        reach = paths.join(links, "at").filter((F.col("dist") <= longest - used - 1) & ~F.array_contains("path", F.col("to")))
        paths = reach.select(F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), F.concat("steps", F.array("seq")).alias("steps"))
        paths = stored(paths, "paths")
        if paths.isEmpty():
            break
        ended = paths.filter(F.col("at") == target)
        done = ended if done is None else done.unionByName(ended)
        paths = paths.filter(F.col("at") != target)
    if done is None:
        return spark.createDataFrame([], "path_no long, path array<string>")
    ordered = done.orderBy("steps")
    if most is not None:
        ordered = ordered.limit(most)  # the first paths are what is asked for
        from pyspark.sql import Window

        return ordered.select(F.row_number().over(Window.orderBy("steps")).cast("long").alias("path_no"), "path")
    return ranked(ordered.withColumn("one", F.lit(1)), ["one"], ["steps"], "path_no").select("path_no", "path")


def title(base: str, focus: str | None = None, depth: int | None = None, collapsed: bool = False) -> str:
    out = f"Data Lineage: {focus}" + (f" (Depth={depth})" if depth is not None else "") if focus else base
    return out + " - Intermediates Collapsed" * collapsed


def lineage_view(edges: DataFrame, focus: str | None = None, depth: int | None = None, collapsed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes with colour and coordinates, edges) of what a picture of the graph shows."""
    classes = classify(edges)
    if focus is not None:
        edges = induced(edges, upstream(edges, focus, depth))
        visible = stored(edges.select(F.explode(F.array("src", "tgt")).alias("node")).distinct().unionByName(edges.sparkSession.createDataFrame([(focus,)], "node string")).distinct(), "visible")
        classes = highlighted(classes.join(visible, "node", "left_semi"), focus)
    shown = stored(collapse(edges, classes, focus) if collapsed else edges.select("src", "tgt").distinct(), "shown")
    placed = layout(layers(shown, focus))
    return placed.join(classes, "node"), shown


def dot_lines(edges: DataFrame) -> DataFrame:
    """(line_no, line) of the graph in DOT: nodes by first sight, then edges by source, each in order."""
    spark = edges.sparkSession
    named = nodes(edges).join(classify(edges), "node")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    node_lines = named.select(F.lit(1).alias("part"), F.col("node_seq").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit("  "), quote(F.col("node")), F.lit(' [fillcolor="'), "colour", F.lit('"];')).alias("line"))
    order = nodes(edges).select(F.col("node").alias("src"), "node_seq")
    edge_lines = edges.join(order, "src").select(F.lit(3).alias("part"), F.col("node_seq").alias("a"), F.col("seq").alias("b"), F.concat(F.lit("  "), quote(F.col("src")), F.lit(" -> "), quote(F.col("tgt")), F.lit(";")).alias("line"))
    fixed = [(0, 0, "digraph DataLineage {"), (0, 1, "  rankdir=TB;"), (0, 2, "  node [shape=box, style=filled];"), (0, 3, ""), (2, 0, ""), (4, 0, "}")]
    frame = spark.createDataFrame([(p, a, 0, x) for p, a, x in fixed], "part int, a long, b long, line string")
    every = frame.unionByName(node_lines).unionByName(edge_lines).withColumn("one", F.lit(1))
    return ranked(every, ["one"], ["part", "a", "b"], "line_no").select("line_no", "line")


def write_dot(edges: DataFrame, path: str) -> str:
    """Writes the graph in DOT to a file of the driver, line by line, and returns its text.

    For graphs that one machine can hold, such as a focus and a depth; dot_lines stays distributed.
    """
    lines = [r["line"] for r in dot_lines(edges).orderBy("line_no").toLocalIterator()]
    text = "\n".join(lines) + "\n"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return text
