"""Reading extracted pages, keeping them, and writing results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import EXTRACTED_FILE


def extracted_files(spark: SparkSession, path: str) -> DataFrame:
    """Extracted-page JSON files, one row each with ``file_name``; files that don't parse are left out."""
    rows = spark.read.schema(EXTRACTED_FILE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null and pages is not null").drop("_corrupt_record").withColumn("file_name", F.col("_metadata.file_name"))


def pages_of(files: DataFrame) -> DataFrame:
    """One row per page: ``doc_id`` (the file name), ``pos`` and the page's fields, with defaults for what is missing."""
    each = files.select(F.col("file_name").alias("doc_id"), F.posexplode("pages").alias("pos", "p")).select("doc_id", "pos", "p.*")
    return each.select(
        "doc_id",
        "pos",
        F.coalesce("page_number", F.col("pos") + 1).alias("page_number"),
        X.text(F.col("text")).alias("text"),
        F.coalesce("text_length", F.length(X.text(F.col("text")))).alias("text_length"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("processing_time", F.lit(0.0)).alias("processing_time"),
        X.text(F.col("image_path")).alias("image_path"),
        F.coalesce("success", F.lit(False)).alias("success"),
    )


def cached_files(files: DataFrame) -> DataFrame:
    """The list of kept files, newest first (the timestamps are compared as text)."""
    info = F.col("extraction_info")
    return files.select(
        "file_name", info["pdf_name"].alias("pdf_name"), info["extraction_timestamp"].alias("extraction_timestamp"),
        info["extraction_method"].alias("extraction_method"), info["total_pages"].alias("total_pages"),
    ).orderBy(F.desc_nulls_last("extraction_timestamp"), "file_name")


def binary_documents(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Documents as files: ``path, stem, modified, length, content``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return files.select("path", stem.alias("stem"), F.unix_seconds("modificationTime").alias("modified"), "length", "content")


def parse_documents(documents: DataFrame, parser: Callable[[bytes], list[dict]], page_range: tuple[int, int] | None = None) -> DataFrame:
    """Pages by a ``parser`` that maps a file's bytes to page dicts; a failed file is one row with its ``error``."""
    schema = "doc_id string, page_number int, text string, confidence double, success boolean, error string"

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, body in zip(part["path"], part["content"]):
                try:
                    for k, page in enumerate(parser(body), 1):
                        rows.append((path, page.get("page_number", k), page.get("text", ""), float(page.get("confidence", 0.0)), bool(page.get("success", True)), None))
                except Exception as e:  # noqa: BLE001  a failed file is a row
                    rows.append((path, None, "", 0.0, False, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "text", "confidence", "success", "error"])

    pages = documents.select("path", "content").mapInPandas(parse, schema)
    return pages if page_range is None else pages.where(F.col("page_number").between(*page_range) | F.col("error").isNotNull())


def to_extract(documents: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Documents ``(stem, modified)`` that the cache doesn't have in this version; all with ``force``."""
    return documents if force else documents.join(cache.select("stem", "modified").distinct(), ["stem", "modified"], "left_anti")


def cache_hits(documents: DataFrame, cache: DataFrame) -> DataFrame:
    return documents.join(cache.select("stem", "modified").distinct(), ["stem", "modified"], "left_semi")


def write_cache(pages: DataFrame, path: str) -> None:
    """Appends pages with ``stem, modified``, partitioned by both, so that a version replaces only itself."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stem", "modified").parquet(path)


def write_json(rows: DataFrame, path: str, append: bool = True) -> None:
    """Results as JSON lines; ``append`` adds to a run's earlier results."""
    rows.write.mode("append" if append else "overwrite").json(path)


def write_text(rows: DataFrame, path: str, column: str = "text") -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def page_images(pages: DataFrame, images: DataFrame, extensions: tuple[str, ...] = ("png", "jpg", "jpeg")) -> DataFrame:
    """``pages`` with ``image_path`` from ``images (doc_id, path)``: ``page_7``, ``page_007`` or ``page-7``, the first extension that there is."""
    number = F.regexp_extract("path", r"page[_-]0*(\d+)\.[^.]+$", 1)
    extension = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    rank = F.array_position(F.array(*map(F.lit, extensions)), extension)
    found = images.withColumns({"n": number, "rank": rank}).where("n <> '' and rank > 0")
    best = found.groupBy("doc_id", F.col("n").cast("int").alias("page_number")).agg(F.min(F.struct("rank", "path"))["path"].alias("image_path"))
    return pages.drop("image_path").join(best, ["doc_id", "page_number"], "left")


def clean_path(path: Column) -> Column:
    """Without quotes and white space at both ends, slashes forward."""
    return F.regexp_replace(F.regexp_replace(X.strip(path), r"^[\"']+|[\"']+$", ""), r"\\", "/")


def is_pdf(path: Column) -> Column:
    return F.lower(clean_path(path)).endswith(".pdf")


def selected_pages(pages: DataFrame, selection: str) -> DataFrame:
    """Pages of a selection such as ``1,3-5``."""
    spark = pages.sparkSession
    spans = spark.range(1).select(F.explode(F.split(F.lit(selection), ",")).alias("s")).select(F.regexp_extract_all("s", F.lit(r"(\d+)"), F.lit(1)).alias("n")).where("size(n) > 0")
    wanted = spans.select(F.explode(F.sequence(F.col("n")[0].cast("int"), F.element_at("n", -1).cast("int"))).alias("page_number")).distinct()
    return pages.join(wanted, "page_number", "left_semi")


def clear_cache(spark: SparkSession, path: str, prefix: str | None = None) -> int:
    """Deletes kept documents, all or those whose stem begins with ``prefix``; returns how many stems went."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name = status.getPath().getName()
        if name.startswith("stem=" + (prefix or "")) and fs.delete(status.getPath(), True):
            gone += 1
    return gone


def image_base64(images: DataFrame) -> DataFrame:
    """``path`` and the file's bytes as base64, for models that read images."""
    return images.select("path", F.base64("content").alias("image"))
