"""Connected components of an edge table by alternating star rounds.

Each round rewires every node to the smallest neighbour it knows (first the
larger neighbours, then the smaller ones), so the edges become stars around the
smallest node of each component in O(log^2 n) rounds. A round is two grouped
minima joined back to the edges; its result is a written table. Nothing is
collected but one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import stage


def _larger(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _smaller(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns of one
    orderable type); component is the smallest node reachable. Loops and rows
    with a null end are no links. No edges give no rows."""
    a, b = edges.columns
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    cur = stage(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _sum(cur)
    while seen[0]:
        cur = stage(_smaller(_larger(cur).distinct()).distinct(), "edges")
        now = _sum(cur)
        if now == seen:
            break
        seen = now
    roots = cur.select(F.col("v").alias("node")).distinct()
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(roots.select("node", F.col("node").alias("component"))))
