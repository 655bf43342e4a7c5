"""Joins of like names, and what order-dependent folds over them give, found in rounds of joins.

A fold that opens a group with each row that resembles no opening row before it finds the
lexicographically first independent set of the graph of like rows. Rows without an undecided
like row before them open; rows like one of these are members; the rest goes another round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import similarity as S

#: Names are alike through their letters alone up to here: 0.4 Jaro-Winkler and 0.3 letters in place. Beyond, names share words.
LETTERS = 0.7


def shared_words(threshold: float, n: Column, m: Column) -> Column:
    """How many words two different names of ``n`` and ``m`` distinct words share at least, if they are alike to ``threshold`` (``LETTERS`` or more).

    Different names score below 1 in both parts that look at letters, so the Jaccard of their
    words is above ``(threshold - LETTERS) / 0.3``.
    """
    share = (threshold - LETTERS) / 0.3
    return (F.floor((n + m) * (share / (1 + share)) + 1e-9) + 1).cast("int")


def like_names(names: DataFrame, keys: list[str], threshold: float, name: str = "name") -> DataFrame:
    """``(*keys, a, b, score)``: names ``a`` that resemble ``b`` of the same keys to ``threshold`` (0.7 or more), a name with itself included.

    ``names`` has distinct rows ``(*keys, name)``. Pairs meet by their rarest words, as many as
    a pair of these sizes must share one of: no pair is lost, and a word that many names hold
    is left out where others must match as well. Both directions are scored, as the scores
    differ. Names without a word resemble nothing but themselves.
    """
    if threshold < LETTERS:
        raise ValueError(f"the index of words needs a threshold of {LETTERS} or more")
    plain = names.select(*keys, F.col(name).alias("name"), S.token_set(F.col(name)).alias("words"))
    each = plain.select(*keys, "name", F.size("words").alias("n"), F.explode("words").alias("word"))
    common = each.groupBy(*keys, "word").agg(F.count("*").alias("held"))
    ranked = each.join(wide(common), [*keys, "word"]).groupBy(*keys, "name", "n").agg(F.array_sort(F.collect_list(F.struct("held", "word"))).alias("ranked"))
    largest = plain.agg(F.max(F.size("words"))).first()[0] or 0
    partner = F.explode(F.sequence(F.lit(1), F.lit(max(1, largest)))).alias("m")
    sized = ranked.select(*keys, "name", "n", "ranked", partner)
    need = shared_words(threshold, F.col("n"), F.col("m"))
    kept = sized.where(need <= F.least("n", "m")).select(*keys, "name", "n", "m", F.explode(F.slice("ranked", F.lit(1), F.col("n") - need + 1)).alias("r"))
    index = kept.select(*keys, "name", "n", "m", F.col("r.word").alias("word"))
    other = index.select(*[F.col(k).alias(k) for k in keys], F.col("word").alias("word"), F.col("name").alias("other"), F.col("n").alias("m"), F.col("m").alias("n"))
    met = index.join(wide(other), [*keys, "word", "n", "m"]).where("name <> other").select(*keys, F.col("name").alias("a"), F.col("other").alias("b")).distinct()
    letters, words = S.ocr_similarity(_plain("a"), _plain("b")), S.token_similarity(F.col("a"), F.col("b"))
    likely = met.where(0.4 + 0.3 * letters + 0.3 * words >= threshold - 1e-6)
    themselves = plain.select(*keys, F.col("name").alias("a"), F.col("name").alias("b"))
    return likely.unionByName(themselves).withColumn("score", S.blend_similarity(F.col("a"), F.col("b"))).where(F.col("score") >= threshold)


def wide(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is never broadcast.

    Spark goes by the bytes of kept files, in which ids and repeated names take little: sides of some million
    rows would pass for small and be built up in the driver, one for each join of each round.
    """
    return rows.hint("merge")


def _plain(name: str) -> Column:
    from ..functions import text as X

    return X.collapse(F.col(name))


def members_of_first(edges: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """Rows ``(node)`` that join a group, of a fold in which each row joins an earlier group or opens one.

    ``edges`` are ``(node, earlier)``: rows that resemble an earlier row, if that one opens a
    group. ``settled`` rows are members from the start. Rounds end when no edge is left; there
    are as many as the longest chain of rows that wait for each other.
    """
    edges = edges.select("node", "earlier")
    found = []
    if settled is not None:
        found.append(settled.select("node"))
        edges = _without(edges, settled)
    edges = scratch.keep(edges, "edges")
    while not edges.isEmpty():
        opens = edges.select("earlier").distinct().join(wide(edges.select(F.col("node").alias("earlier")).distinct()), "earlier", "left_anti")
        gone = scratch.keep(edges.join(wide(opens), "earlier", "left_semi").select("node").distinct(), "members")
        found.append(gone)
        following = scratch.keep(_without(edges, gone), "edges")
        scratch.drop(edges)
        edges = following
    if not found:
        return edges.select("node")
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    for side in ("node", "earlier"):
        edges = edges.join(wide(gone.select(F.col("node").alias(side))), side, "left_anti")
    return edges.select("node", "earlier")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node that each node of ``edges (a, b)`` reaches, by rounds of smallest neighbours and jumps to a root's root."""
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(wide(roots.select(F.col("node").alias("b"), "root")), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = roots.join(wide(near), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("low"))
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        following = scratch.keep(lower.join(wide(jump), "low").select("node", "was", F.col("lower").alias("root")), "roots")
        if following.where("root <> was").isEmpty():
            return following.select("node", "root")
        roots = following.select("node", "root")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, 1 for the first row of each key: no key's rows meet in one task.

    Rows are cut into sorted ranges; each is numbered by itself, and what the ranges before
    hold of the key is added. Equal rows of a key are numbered in any order.
    """
    cut = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    placed = scratch.keep(cut, "ranges")
    counts = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return placed.withColumn("_inside", inside).join(wide(starts), [*keys, "_range"]).withColumn(name, (F.col("_start") + F.col("_inside")).cast("int")).drop("_range", "_inside", "_start")
