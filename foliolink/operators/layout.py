"""Tables on page images: line crossings, decisions, cell grids, resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch

#: Lines and crossings that make a table, and their weights.
MIN_HORIZONTAL, MIN_VERTICAL, MIN_CROSSINGS = 3, 2, 4
WEIGHTS = (0.5, 0.3, 0.2)


def crossings(lines: DataFrame, tolerance: int = 10, bin_size: int = 200) -> DataFrame:
    """Per image ``(image_id, horizontal, vertical, intersections)`` from lines ``(image_id, orientation, x1, y1, x2, y2)``.

    A pair crosses if the vertical's x is within the horizontal's span and the horizontal's y
    within the vertical's, widened by ``tolerance``. Both bands are joined by bins of x, so
    only lines near each other meet.
    """
    h = lines.where("orientation = 'h'").select(
        "image_id", F.least("x1", "x2").alias("left"), F.greatest("x1", "x2").alias("right"), F.col("y1").alias("y")
    )
    v = lines.where("orientation = 'v'").select("image_id", F.col("x1").alias("x"), F.least("y1", "y2").alias("top"), F.greatest("y1", "y2").alias("bottom"))
    at = lambda c: F.floor(c / bin_size)
    spans = h.withColumn("bin", F.explode(F.sequence(at(F.col("left") - tolerance), at(F.col("right") + tolerance))))
    met = spans.join(v.withColumn("bin", at(F.col("x"))), ["image_id", "bin"]).where(
        F.col("x").between(F.col("left") - tolerance, F.col("right") + tolerance) & F.col("y").between(F.col("top") - tolerance, F.col("bottom") + tolerance)
    )
    hits = met.groupBy("image_id").agg(F.count("*").alias("intersections"))
    counts = lines.groupBy("image_id").agg(F.count(F.when(F.col("orientation") == "h", 1)).alias("horizontal"), F.count(F.when(F.col("orientation") == "v", 1)).alias("vertical"))
    return counts.join(hits, "image_id", "left").withColumn("intersections", F.coalesce("intersections", F.lit(0)))


def table_decision(counts: DataFrame) -> DataFrame:
    """Adds ``has_table`` and ``confidence``: each count over its minimum, at most twice, halved and weighted."""
    h, v, i = F.col("horizontal"), F.col("vertical"), F.col("intersections")
    score = lambda c, least: F.least(c / least, F.lit(2.0)) / 2
    sure = score(h, MIN_HORIZONTAL) * WEIGHTS[0] + score(v, MIN_VERTICAL) * WEIGHTS[1] + score(i, MIN_CROSSINGS) * WEIGHTS[2]
    return counts.withColumns({"has_table": (h >= MIN_HORIZONTAL) & (v >= MIN_VERTICAL) & (i >= MIN_CROSSINGS), "confidence": sure})


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Struct of centre, width and height."""
    return F.struct(((x1 + x2) / 2).alias("center_x"), ((y1 + y2) / 2).alias("center_y"), (x2 - x1).alias("width"), (y2 - y1).alias("height"))


def grid_rows(cells: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Per table the rows of cell texts, from ``(table_id, text, x, y)``.

    Cells go by y; a cell begins a row when its y is more than ``tolerance`` from the row's
    first. Cells of a row go by x, then text. Cells without y come first, each a row of its own.

    The y after which a row ends is known for each y by itself, so the rows' first ones are
    those that the least y reaches in steps, found by steps of 1, 2, 4, ... joined.
    """
    placed = cells.select("table_id", "text", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    heights = scratch.keep(_row_starts(placed.where("y is not null").select("table_id", "y").distinct(), tolerance), "heights")
    blank = placed.where("y is null").withColumn("row", F.row_number().over(Window.partitionBy("table_id").orderBy("x", "text")))
    before = blank.groupBy("table_id").agg(F.count("*").alias("n"))
    filled = placed.join(heights, ["table_id", "y"]).join(before, "table_id", "left").withColumn("row", F.col("row") + F.coalesce("n", F.lit(0)))
    every = filled.select("table_id", "row", "x", "text").unionByName(blank.select("table_id", "row", "x", "text"))
    per_row = every.groupBy("table_id", "row").agg(F.sort_array(F.collect_list(F.struct("x", "text"))).alias("r"))
    grid = F.sort_array(F.collect_list(F.struct("row", F.transform("r", lambda c: c["text"]).alias("texts"))))
    return per_row.groupBy("table_id").agg(F.transform(grid, lambda r: r["texts"]).alias("grid"))


def _row_starts(heights: DataFrame, tolerance: float) -> DataFrame:
    """``(table_id, y, row)`` of distinct ``(table_id, y)``; ``row`` from 1."""
    upward = Window.partitionBy("table_id").orderBy("y")
    beyond = f"min(struct(y, up)) OVER (PARTITION BY table_id ORDER BY y DESC RANGE BETWEEN UNBOUNDED PRECEDING AND {float(tolerance)!r}D PRECEDING)"
    following = F.when(F.col("far.y") - F.col("y") > tolerance, F.col("far.y")).otherwise(F.col("far.up"))
    ways = heights.withColumn("up", F.lead("y").over(upward)).withColumn("far", F.expr(beyond)).select("table_id", "y", following.alias("to"))
    jumps = scratch.keep(ways.where("to is not null"), "jumps")
    starts = heights.groupBy("table_id").agg(F.min("y").alias("y"))
    while not jumps.isEmpty():
        reached = starts.join(jumps, ["table_id", "y"]).select("table_id", F.col("to").alias("y"))
        starts = scratch.keep(starts.unionByName(reached), "starts")  # a jump of more steps than before reaches others
        onward = jumps.select("table_id", F.col("y").alias("to"), F.col("to").alias("further"))
        jumps = scratch.keep(jumps.join(onward, ["table_id", "to"]).select("table_id", "y", F.col("further").alias("to")), "jumps")
    marked = heights.join(starts.withColumn("begins", F.lit(1)), ["table_id", "y"], "left")
    return marked.select("table_id", "y", F.sum(F.coalesce("begins", F.lit(0))).over(upward).alias("row"))


def markdown(grid: Column) -> Column:
    """A grid as a Markdown table: the first row as its head, short rows filled up."""
    width = F.array_max(F.transform(grid, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    body = F.transform(grid, line)
    return F.when(F.size(grid) > 0, F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.size(body))), "\n")).otherwise("")


def hybrid_text(text: Column, tables: Column) -> Column:
    """Page text, then each table ``struct<table_id, grid>`` under its banner, as Markdown and as plain rows."""
    shown = F.transform(
        tables,
        lambda t: F.concat(
            F.format_string("\n--- TABLE %d ---\n", t["table_id"]), markdown(t["grid"]), F.lit("\n\n--- STRUCTURED DATA ---\n"),
            F.array_join(F.transform(t["grid"], lambda r: F.array_join(r, " | ")), "\n"),
        ),
    )
    return F.array_join(F.concat(F.filter(F.array(text), lambda x: F.coalesce(x, F.lit("")) != ""), shown), "\n")
