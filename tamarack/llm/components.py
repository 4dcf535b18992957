"""Connected components over an edge table by alternating large-star and small-star rounds.

Each round links every neighbour to the smallest identifier around a node; the number of rounds
grows with the logarithm of the longest path, and the edges never become more. Minima are
aggregated before the shuffle and joined back, so a hub's neighbours needn't meet in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm._common import cut


def _to_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    linked = _to_least(edges)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


#: Edges for each task of a round; fewer edges are gathered in fewer tasks, which write fewer files.
_EDGES = 250_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of each node that has an edge to another; root is the least id of its component.

    Null ends, loops, repeated and reversed edges change nothing. No edges: no rows.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = mark(now)
    while seen[0]:
        tasks = -(-seen[0] // _EDGES)
        now = cut(_small_star(_large_star(now.coalesce(tasks)).coalesce(tasks)).coalesce(tasks))
        if (m := mark(now)) == seen:
            break
        seen = m
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
