"""Comparing algorithms and methods that worked on the same input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consensus(runs: DataFrame, key: str = "doc_id", value: str = "total_patients") -> DataFrame:
    """Per document the most frequent value (the smallest of equals), its share in percent, smallest and largest."""
    votes = runs.groupBy(key, value).agg(F.count("*").alias("votes"))
    best = F.max(F.struct("votes", (-F.col(value)).alias("minus")))
    return votes.groupBy(key).agg(best.alias("best"), F.sum("votes").alias("n"), F.min(value).alias("min_patients"), F.max(value).alias("max_patients")).select(
        key, (-F.col("best.minus")).alias("consensus_patients"), (F.col("best.votes") / F.col("n") * 100).alias("agreement_percentage"), "min_patients", "max_patients"
    )


def comparison(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document :func:`consensus` and the means over algorithms, with the range of processing times."""
    stats = runs.groupBy(key).agg(
        F.count("*").alias("n_algorithms"),
        F.avg("total_patients").alias("average_patients"),
        F.avg("total_entries").alias("average_entries"),
        F.avg("processing_time").alias("average_processing_time"),
        F.avg("average_confidence").alias("average_confidence"),
        (F.max("processing_time") - F.min("processing_time")).alias("processing_time_range"),
    )
    return stats.join(consensus(runs, key), key)


def algorithm_map(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document a map from algorithm to its figures, for the JSON sink."""
    figures = F.struct("total_patients", "total_entries", "assigned_pages", "unassigned_pages", "average_confidence", "processing_time")
    return runs.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("algorithm", figures)))).alias("algorithm_results"))


def methods(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document with two successful methods or more: the fastest, and the one with most characters; names break ties."""
    ok = results.where("success")
    made = ok.groupBy(key).agg(
        F.count("*").alias("n_methods"),
        F.min(F.struct("processing_time", "method", "total_characters")).alias("fast"),
        F.min(F.struct((-F.col("total_characters")).alias("minus"), "method")).alias("full"),
    )
    return made.where("n_methods >= 2").select(
        key, "n_methods",
        F.col("fast.method").alias("fastest"), F.col("fast.processing_time").alias("fastest_time"),
        (F.col("fast.total_characters") / F.nullif("fast.processing_time", F.lit(0.0))).alias("chars_per_second"),
        F.col("full.method").alias("most_characters"), (-F.col("full.minus")).alias("characters"),
    )


def relative_speed(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``relative_speed``: time over the group's least time."""
    least = F.min("processing_time").over(Window.partitionBy(key))
    return results.withColumn("relative_speed", F.col("processing_time") / F.nullif(least, F.lit(0.0)))


def engines(results: DataFrame, key: str = "engine") -> DataFrame:
    """Per engine: rate of success, mean time, mean confidence other than 0."""
    return results.groupBy(key).agg(
        F.count("*").alias("n"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("processing_time").alias("average_time"),
        F.coalesce(F.avg(F.when(F.col("confidence") != 0, F.col("confidence"))), F.lit(0.0)).alias("average_confidence"),
    )


def best_engine(summary: DataFrame, key: str = "engine") -> DataFrame:
    """One row: of the engines of :func:`engines` that ever succeeded the one with the least mean time, the smaller name on a tie; no row if none did."""
    return summary.where("success_rate > 0").groupBy().agg(F.min(F.struct("average_time", key)).alias("b")).where("b is not null").select(F.col(f"b.{key}").alias("best_engine"), F.col("b.average_time").alias("best_average_time"))


def recommend(analysis_method: Column, analysis_confidence: Column, succeeded: Column) -> Column:
    """Struct ``method, confidence, alternatives``: the analysis's choice if it succeeded, else ``scanned``, else the first that did, else ``none``.

    ``succeeded`` is the array of successful methods in order.
    """
    first = F.get(succeeded, F.lit(0))
    agreed = F.coalesce(F.array_contains(succeeded, analysis_method), F.lit(False))
    method = F.when(agreed, analysis_method).when(F.array_contains(succeeded, "scanned"), "scanned").otherwise(F.coalesce(first, F.lit("none")))
    sure = F.when(agreed, analysis_confidence).when(F.array_contains(succeeded, "scanned"), 0.8).when(first.isNotNull(), 0.6).otherwise(0.0)
    return F.struct(method.alias("method"), sure.alias("confidence"), F.array_except(succeeded, F.array(method)).alias("alternatives"))


def better_reading(readings: Column) -> Column:
    """Of readings ``(text, confidence)`` in order, the one left by: a later one replaces if its text is longer or its confidence higher."""
    start = F.get(readings, F.lit(0))
    step = lambda a, x: F.when((F.length(x["text"]) > F.length(a["text"])) | (x["confidence"] > a["confidence"]), x).otherwise(a)
    return F.aggregate(readings, start, step)
