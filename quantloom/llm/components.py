"""Connected components over an edge table, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of `edges`; root is the smallest node of its component.

    Each round hooks a node to its smallest neighbour, shortens the chains once and
    contracts the edges, so at least half of the nodes of every open component vanish
    and the rounds are logarithmic. Minima are pre-aggregated map-side, so a node with
    very many edges costs one row per task. Rounds are written to the shared folder.
    Self loops, repeated edges and an empty table are fine; edges with nulls are ignored.
    """
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null")
    nodes = None
    first = True
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        hook = written(hook.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "cc-hook")
        pu, pv = hook.select("u", F.col("p").alias("a")), hook.select(F.col("u").alias("v"), F.col("p").alias("b"))
        nxt = e.join(pu, "u").join(pv, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        nxt = written(nxt, "cc-edges")
        discard(e)
        if first:
            nodes = written(hook.select(F.col("u").alias("node"), F.col("p").alias("root")), "cc-nodes")
        else:
            step = hook.select(F.col("u").alias("root"), F.col("p").alias("r2"))
            before = nodes
            nodes = written(before.join(step, "root", "left").select("node", F.coalesce("r2", "root").alias("root")), "cc-nodes")
            discard(before)
        discard(hook)
        if nxt.isEmpty():
            discard(nxt)
            return nodes
        first, e = False, nxt
