"""Routing documents to embedded text or OCR, and statistics of extraction runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def page_coverage(pages: DataFrame) -> DataFrame:
    """``doc_id, page_number`` with ``has_text, text_length, text_sample`` of the embedded text."""
    bare = X.strip(F.col("text"))
    return pages.select("doc_id", "page_number", (bare != "").alias("has_text"), F.length(bare).alias("text_length"), F.when(bare != "", X.preview(F.col("text"))).otherwise("").alias("text_sample"))


def route(coverage: DataFrame, min_text: int = 50, prefer_scanned: bool = True) -> DataFrame:
    """Per document the method and how sure it is: ``scanned`` with at least ``min_text`` characters of text, else ``ocr``."""
    per_doc = coverage.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"),
        F.count(F.when(F.col("has_text"), 1)).alias("pages_with_text"),
        F.coalesce(F.sum(F.when(F.col("has_text"), F.col("text_length"))), F.lit(0)).alias("total_text_length"),
    )
    enough = (F.col("pages_with_text") > 0) & (F.col("total_text_length") >= min_text)
    wide = F.lit(prefer_scanned) | (F.col("pages_with_text") / F.col("total_pages") > 0.5)
    return per_doc.withColumns(
        {
            "method": F.when(enough, "scanned").otherwise("ocr"),
            "confidence": F.when(enough & wide, 0.9).when(enough, 0.7).otherwise(0.8),
            "reason": F.when(enough & wide, "selectable text").when(enough, "mixed content").when(F.col("pages_with_text") > 0, "too little text").otherwise("image only"),
        }
    )


def reading_totals(pages: DataFrame) -> DataFrame:
    """Per document: characters, mean confidence and number of successful pages, rate of success; successful if there are characters."""
    ok = F.col("success")
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"),
        F.count(F.when(ok, 1)).alias("successful_pages"),
        F.coalesce(F.sum(F.when(ok, F.length("text"))), F.lit(0)).alias("total_characters"),
        F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("overall_confidence"),
        F.avg(ok.cast("double")).alias("success_rate"),
    ).withColumn("success", F.col("total_characters") > 0)


def batch_summary(results: DataFrame) -> DataFrame:
    """One row over all documents: totals, mean time, success in percent, number per method."""
    by_method = results.groupBy("method").agg(F.count("*").alias("n"), F.count(F.when(F.col("success"), 1)).alias("ok"), F.sum("processing_time").alias("s"), F.sum("total_characters").alias("chars"))
    return by_method.agg(
        F.sum("n").alias("total_documents"),
        F.sum("ok").alias("successful"),
        (F.sum("ok") / F.sum("n") * 100).alias("success_percent"),
        (F.sum("s") / F.sum("n")).alias("average_time"),
        F.sum("chars").alias("total_characters"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", "n")))).alias("methods"),
    )


def with_rates(results: DataFrame) -> DataFrame:
    """Adds ``chars_per_second`` and its bucket ``efficiency``."""
    rate = X.characters_per_second(F.col("total_characters"), F.col("processing_time"))
    return results.withColumn("chars_per_second", rate).withColumn("efficiency", X.efficiency(F.col("chars_per_second")))


def first_pages(pages: DataFrame, most: int = 1000) -> DataFrame:
    """At most ``most`` pages of each document, the first."""
    return pages.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))).where(F.col("_k") <= most).drop("_k")


def document_text(pages: DataFrame, banner: str = "--- PAGE %d ---") -> DataFrame:
    """Per document the non-blank pages in order, each under its banner, blank lines between."""
    block = F.concat(F.format_string(banner, F.col("pos") + 1), F.lit("\n"), F.col("text"))
    parts = F.sort_array(F.collect_list(F.when(~X.is_blank(F.col("text")), F.struct("pos", block.alias("b")))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["b"]), "\n\n").alias("text"))


def prompt_pages(pages: DataFrame) -> DataFrame:
    """Per document the pages as prompts show them: ``=== PAGE n (Confidence: c.cc) ===`` and the text."""
    return pages.groupBy("doc_id").agg(prompt().alias("prompt"))


def prompt() -> Column:
    """The aggregate of :func:`prompt_pages`."""
    block = F.concat(F.format_string("=== PAGE %d (Confidence: %.2f) ===\n", "page_number", "confidence"), X.text(F.col("text")))
    parts = F.sort_array(F.collect_list(F.struct("pos", block.alias("b"))))
    return F.array_join(F.transform(parts, lambda p: p["b"]), "\n\n")


def joined_text(pages: DataFrame) -> DataFrame:
    """Per document the stripped non-blank pages in order, blank lines between; empty without any."""
    bare = X.strip(F.col("text"))
    parts = F.sort_array(F.collect_list(F.when(bare != "", F.struct("pos", bare.alias("b")))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["b"]), "\n\n").alias("text"))


def distinct_fonts(spans: DataFrame) -> DataFrame:
    """Fonts of each page ``(doc_id, page_number, pos, font, size, flags, color)``: the first span of each font, size and flags."""
    first = F.min_by("color", "pos").alias("color")
    return spans.groupBy("doc_id", "page_number", "font", "size", "flags").agg(first, F.min("pos").alias("first_pos"))


def summary_line(result: DataFrame) -> DataFrame:
    """One line of text per run ``(file_name, success, total_pages, total_characters, processing_time, method)``."""
    good = F.format_string("%s: %d pages, %s characters, %.2f s, %s", "file_name", "total_pages", F.format_number("total_characters", 0), "processing_time", "method")
    return result.select("file_name", F.when(F.col("success"), good).otherwise(F.concat(F.col("file_name"), F.lit(": failed"))).alias("line"))
