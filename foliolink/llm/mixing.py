"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, fresh, store

#: Seeded hashes are dealt to this many slots per source; only the slot in which a source's
#: fractional budget ends is ordered row by row.
SLOTS = 1 << 12


def cyclic_weights(sizes: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Sources in code point order, null last, with weights that repeat ``cycle``.

    ``sizes`` has a row per source, so the one ordered window is over sources, not rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle)))
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), turn + 1))


def water_fill(sources: DataFrame, total: float, max_epochs: float = 2.0) -> DataFrame:
    """Adds ``target``: shares of ``total`` by ``weight``, none above ``max_epochs * source_size``.

    Sources above their cap are clamped to it and what they leave goes to the others by
    weight, again and again until nobody is above. If all caps together are below ``total``
    every source ends at its cap. A source without weight gets nothing; an empty table stays
    empty. Each round moves two sums to the driver.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    state = store(sources.withColumn("cap", cap), "sources")
    while True:
        full = (F.col("weight") > 0) & (F.col("weight") * F.lit(level) >= F.col("cap")) if clamped >= 0 else F.lit(False)
        got = state.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if got["n"] == clamped or not got["open"]:
            break
        clamped, level = got["n"], max(0.0, total - got["held"]) / got["open"]
    if clamped >= 0 and not got["open"]:
        level = float("inf")
    target = F.when(F.col("weight") > 0, F.least(F.col("weight") * F.lit(level), F.col("cap"))).otherwise(F.lit(0.0))
    return state.withColumn("target", target).drop("cap")


def _draw(seed: int, columns: list[Column]) -> Column:
    """A seeded hash, 52 bits, the same in each run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12)


def _slot(draw: Column) -> Column:
    return F.shiftrightunsigned(draw, 52 - (SLOTS.bit_length() - 1)).cast("int")


def _plan(docs: DataFrame, epochs: float, max_epochs: float, cycle: tuple[float, ...], seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows without texts, a row per source with ``whole, budget, end_slot``, and the rows of the end slots with ``extra``."""
    rows = store(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("digest"), count_words(F.col(text_col)).alias("size"))
        .withColumn("draw", _draw(seed, [F.col("id"), F.col("digest")]))
        .withColumn("slot", _slot(F.col("draw"))),
        "sizes",
    )
    sizes = store(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes")
    total = (sizes.agg(F.sum("source_size")).first()[0] or 0) * epochs
    shares = store(
        water_fill(cyclic_weights(sizes, cycle), float(total), max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")),
        "targets",
    )
    slots = rows.groupBy("source", "slot").agg(F.sum("size").alias("held"))
    before = F.sum("held").over(Window.partitionBy("source").orderBy("slot")) - F.col("held")
    ends = (
        slots.withColumn("before", before)
        .join(shares.select(F.col("source").alias("of"), "budget"), F.col("source").eqNullSafe(F.col("of")))
        .where((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("held") > F.col("budget")))
        .select("of", F.col("slot").alias("end_slot"), F.col("before").alias("end_before"))
    )
    plan = store(
        shares.alias("s").join(ends, F.col("s.source").eqNullSafe(F.col("of")), "left").select("s.*", "end_slot", "end_before").withColumnRenamed("source", "of"),
        "plan",
    )
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("draw", "id", "digest").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("end_before") + upto - F.col("size") / 2
    at_end = rows.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("end_slot")))
    return rows, plan, at_end.withColumn("extra", ((F.col("budget") > 0) & (middle <= F.col("budget"))).cast("int"))


def _off_end(rows: DataFrame, plan: DataFrame, source: Column, slot: Column) -> DataFrame:
    """``rows`` outside the end slot of their source, with its plan and ``extra``."""
    off = rows.join(plan, source.eqNullSafe(F.col("of")) & ~slot.eqNullSafe(F.col("end_slot")))
    return off.withColumn("extra", ((F.col("budget") > 0) & F.coalesce(slot < F.col("end_slot"), F.lit(True))).cast("int"))


def mix(
    docs: DataFrame,
    epochs: float = 1.5,
    max_epochs: float = 2.0,
    cycle: tuple[float, ...] = (5.0, 2.0, 1.0),
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: ``(id, source, digest, size, source_size, target, repeats, taken)``.

    ``size`` counts words (null or empty: 0). Sources share ``epochs`` times all words by
    weight with targets capped at ``max_epochs`` times the source (see :func:`water_fill`).
    With ``f = target / source_size`` each document is taken ``floor(f)`` whole times, and
    once more if it is among the first of its source, in the order of a seeded hash, that
    together make up the fraction of ``f``: a document goes in if at least half of it fits.
    So a source misses its target by half a document at most, and no document is repeated
    more than ``max_epochs`` times, empty ones included. Null sources are one source;
    null ids and repeated rows are rows like any other, and equal rows that tie in the order
    are interchangeable. The order within a source is found from sums over hash slots, so no
    source is ever sorted whole. An empty table gives an empty table.
    """
    rows, plan, at_end = _plan(docs, epochs, max_epochs, cycle, seed, id_col, text_col, source_col)
    others = _off_end(rows, plan, F.col("source"), F.col("slot"))
    repeats = (F.col("whole") + F.when(F.col("source_size") > 0, F.col("extra")).otherwise(0)).cast("int")
    return (
        others.unionByName(at_end)
        .withColumn("repeats", repeats)
        .select(
            F.col("id").alias(id_col), F.col("source").alias(source_col), "digest", "size", "source_size", "target", "repeats",
            (F.col("repeats") * F.col("size")).alias("taken"),
        )
    )


def mixed_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    epochs: float = 1.5,
    max_epochs: float = 2.0,
    cycle: tuple[float, ...] = (5.0, 2.0, 1.0),
    seed: int = 7,
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it, numbered from 0 in ``repetition``.

    A row's number of repeats follows from its own hash and its source's plan, so texts stay
    where they are read, but for those in the slots in which budgets end. Rows there that agree
    in id, source and text take the largest of their numbers.
    """
    _, plan, at_end = _plan(docs, epochs, max_epochs, cycle, seed, id_col, text_col, source_col)
    number, own = fresh(docs, "repetition"), {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    text, source, who = F.col(own[text_col]), F.col(own[source_col]), F.col(own[id_col])
    digest = F.xxhash64(text)
    keyed = docs.toDF(*own.values()).withColumn("own_slot", _slot(_draw(seed, [who, digest])))
    off = _off_end(keyed, plan, source, F.col("own_slot")).select(*own.values(), "whole", "extra", "source_size")
    decided = at_end.groupBy(F.col("id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("digest").alias("mix_digest")).agg(
        F.max("extra").alias("extra"), F.first("whole").alias("whole"), F.first("source_size").alias("source_size")
    )
    near = keyed.join(plan.select("of", "end_slot"), source.eqNullSafe(F.col("of")) & (F.col("own_slot") == F.col("end_slot"))).select(*own.values())
    at = near.join(store(decided, "end_slots"), who.eqNullSafe(F.col("mix_id")) & source.eqNullSafe(F.col("mix_source")) & (digest == F.col("mix_digest")))
    both = off.unionByName(at.select(*own.values(), "whole", "extra", "source_size"))
    repeats = (F.col("whole") + F.when(F.col("source_size") > 0, F.col("extra")).otherwise(0)).cast("int")
    taken = both.withColumn("own_repeats", repeats).where("own_repeats > 0")
    return taken.select(*[F.col(v).alias(c) for c, v in own.items()], F.explode(F.sequence(F.lit(0), F.col("own_repeats") - 1)).alias(number))
