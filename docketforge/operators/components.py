"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketforge.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        down.join(low, "u")
        .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        .select("e.u", "e.v")
    )


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 40) -> DataFrame:
    """(node, component): component is the smallest node id reachable over ``edges``.

    Nodes are those named by an edge; loops, nulls and repeated edges are allowed and change nothing (a node with
    only a loop is its own component). Each round costs two aggregations and two joins whose rows are edges, so a
    node with many neighbours is never gathered in one place; rounds grow with the logarithm of the longest path.
    An empty table gives an empty result.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct()
    e = cut(e, "cc-edges")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    proper = e.where("u <> v")
    print_of = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    seen = None
    for _ in range(max_rounds):
        proper = cut(_small_star(_large_star(proper)).where("u <> v").distinct(), "cc-round")
        now = print_of(proper)
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    labels = proper.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("m", "node").alias("component"))
