"""Connected components of an edge table: in one task where it is small, by alternating large and small stars otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stored

#: Edges that one task takes at most.
LOCAL_EDGES = 1_000_000


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(u), root(v)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    for k in range(0, len(nodes), 100_000):
        part = nodes[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the least node that it is connected to.

    Loops are dropped, repeated edges are one, and an empty table gives none. Up to local_edges edges are counted
    and then joined in one task. Beyond, each round joins every edge with the least neighbour of its ends, which are
    pre-aggregated, and ends lineage in a written table; rounds grow with the logarithm of the longest path.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "edges")
    if e.count() <= local_edges:
        return stored(e.coalesce(1).mapInArrow(_in_one_task, "node long, root long"), "components")
    before = None
    while True:
        sum_ = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before is not None and (sum_["n"], sum_["x"]) == before:
            break
        before = (sum_["n"], sum_["x"])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "edges")
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(under, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(under.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
