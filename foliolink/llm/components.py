"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, release, store


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node passes its smallest neighbour to its larger neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n"))
    return join_spread(both.where("v > u"), low.drop("n"), ["u"], ["v"], low.select("u", "n"), total=n).select(F.col("low").alias("u"), "v")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node passes the smallest of its smaller neighbours to itself and to the others of them."""
    low = edges.groupBy("v").agg(F.min("u").alias("low"), F.count("*").alias("n"))
    moved = join_spread(edges, low.drop("n"), ["v"], ["u"], low.select("v", "n"), total=n).where("u <> low").select(F.col("low").alias("u"), F.col("u").alias("v"))
    return moved.unionAll(low.select(F.col("low").alias("u"), "v"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Nodes of an undirected graph with the smallest node that each can reach.

    ``edges`` has two columns of one orderable type. Loops, nulls, repeated and reversed
    edges are allowed; an edge with a null end is no edge. Returns ``(node, root)`` for
    every node that has an edge to another node; an empty table gives an empty table.
    Each round is one aggregation and one join per star, written to the shared folder, so a
    node of any degree is never gathered in one task: its edges are dealt over many. The number of rounds grows with the
    logarithm of the longest chain; ``max_rounds`` only stops a run that doesn't end.
    """
    a, b = edges.columns[:2]
    now = store(
        edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(),
        "edges",
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        stars = store(_large_star(now, mark[0]).distinct(), "edges")
        after = store(_small_star(stars, mark[0]).distinct(), "edges")
        release(stars)
        release(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("u").distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(
        roots.select(F.col("u").alias("node"), F.col("u").alias("root"))
    )


def _mark(edges: DataFrame) -> tuple:
    """Edges and a sum over their hashes: equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
