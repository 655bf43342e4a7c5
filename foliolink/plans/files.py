"""Text of documents: embedded or read from images, as each document needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text as X
from ..operators import compare, layout, route

#: Reads pages ``(doc_id, page_number, ...)`` as ``(doc_id, page_number, text, confidence, success, processing_time)``.
Reader = Callable[[DataFrame], DataFrame]
READING = ("doc_id", "page_number", "text", "confidence", "success", "processing_time")
METHODS = ("scanned", "ocr")


def embedded(pages: DataFrame) -> DataFrame:
    """Embedded text as a reading: sure, and as fast as ``processing_time`` says where ``pages`` has it."""
    took = F.coalesce(F.col("processing_time").cast("double"), F.lit(0.0)) if "processing_time" in pages.columns else F.lit(0.0)
    return pages.select("doc_id", "page_number", X.text(F.col("text")).alias("text"), F.lit(1.0).alias("confidence"), F.lit(True).alias("success"), took.alias("processing_time"))


def process(
    pages: DataFrame, read: Reader | None = None, method: str | None = None, min_text: int = 50, prefer_scanned: bool = True, lines: DataFrame | None = None, cells: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The run over many documents: ``decisions, pages, documents, summary``.

    ``pages`` has ``doc_id, page_number, text`` (embedded, may be null) and what ``read`` needs.
    Each document goes by its own decision, or all by ``method``. Both branches get only their
    documents' pages: what one method doesn't need is never read. Pages that a reader leaves out
    are there without success, and without a reader so are all of its documents' pages.

    ``lines`` and ``cells`` of pages (as in :mod:`layout`, with ``doc_id, page_number`` for the
    image) add tables to the text of read pages, but only where the lines make a table.
    """
    if method is not None and method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    analysis = route.route(route.page_coverage(pages), min_text, prefer_scanned)
    decisions = scratch.keep(analysis.withColumn("method", F.lit(method)) if method else analysis, "decisions")
    of = lambda name: decisions.where(F.col("method") == name).select("doc_id")

    own = embedded(pages.join(of("scanned"), "doc_id", "left_semi"))
    wanted = pages.join(of("ocr"), "doc_id", "left_semi")
    blank = [F.lit("").alias("text"), F.lit(0.0).alias("confidence"), F.lit(False).alias("success"), F.lit(0.0).alias("processing_time")]
    if read is None:
        seen = wanted.select("doc_id", "page_number", *blank)
    else:
        seen = read(wanted).select(*READING)
        if lines is not None and cells is not None:
            seen = with_tables(seen, lines, cells)
        seen = scratch.keep(seen, "readings")  # the reader runs once
        seen = seen.unionByName(wanted.select("doc_id", "page_number").join(seen, ["doc_id", "page_number"], "left_anti").select("doc_id", "page_number", *blank))
    united = own.withColumn("method", F.lit("scanned")).unionByName(seen.withColumn("method", F.lit("ocr")))

    took = united.groupBy("doc_id").agg(F.first("method").alias("method"), F.sum("processing_time").alias("processing_time"))
    error = F.when(~F.col("success"), F.lit("no text" if read else "no reader or no text"))
    documents = route.with_rates(route.reading_totals(united).join(took, "doc_id")).withColumn("error", error)
    return {"decisions": decisions, "pages": united, "documents": documents, "summary": route.batch_summary(documents)}


def with_tables(readings: DataFrame, lines: DataFrame, cells: DataFrame) -> DataFrame:
    """``readings`` whose text has the page's tables under it, on pages whose lines make a table; cells of other pages are never put into rows."""
    image = F.struct("doc_id", "page_number")
    decided = layout.table_decision(layout.crossings(lines.withColumn("image_id", image).drop("doc_id", "page_number")))
    gate = scratch.keep(decided.where("has_table").select("image_id.doc_id", "image_id.page_number"), "gate")
    gated = cells.join(gate, ["doc_id", "page_number"], "left_semi").withColumn("table_id", F.struct("doc_id", "page_number", F.col("table_id").cast("int").alias("table_id")))
    grids = layout.grid_rows(gated.select("table_id", "text", "x", "y"))
    tables = grids.groupBy("table_id.doc_id", "table_id.page_number").agg(F.sort_array(F.collect_list(F.struct(F.col("table_id.table_id").alias("table_id"), "grid"))).alias("tables"))
    found = readings.join(tables, ["doc_id", "page_number"], "left")
    whole = F.when(F.col("tables").isNotNull() & F.col("success"), layout.hybrid_text(F.col("text"), F.col("tables"))).otherwise(F.col("text"))
    return found.withColumn("text", whole).select(*READING)


def both_methods(pages: DataFrame, read: Reader, min_text: int = 50) -> DataFrame:
    """Each document by both methods: the fastest, the one with most text, and the method to use.

    Documents with one successful method or none have nulls for what compares two.
    """
    runs = {m: process(pages, read, m, min_text) for m in METHODS}
    results = scratch.keep(runs["scanned"]["documents"].unionByName(runs["ocr"]["documents"]), "methods")
    ok = results.groupBy("doc_id").agg(F.reverse(F.sort_array(F.collect_list(F.when(F.col("success"), F.col("method"))))).alias("ok"))
    analysis = route.route(route.page_coverage(pages), min_text).select("doc_id", F.col("method").alias("analysed"), F.col("confidence").alias("sure"))
    told = ok.join(analysis, "doc_id").withColumn("r", compare.recommend(F.col("analysed"), F.col("sure"), F.col("ok")))
    return told.join(compare.methods(results), "doc_id", "left").select("doc_id", "analysed", "r.*", "n_methods", "fastest", "fastest_time", "most_characters", "characters")
