"""One record per document from a model that reads a page at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text as X
from ..operators import consolidate, models
from ..schemas import INSURANCE_FIELDS, PATIENT_FIELDS


def page_records(pages: DataFrame, make: Callable[[], models.Model], simple: bool = False, in_flight: int = 4, deadline: float | None = 60.0) -> DataFrame:
    """A row per page ``(doc_id, pos, page_number)``: ``status`` (``ok``, ``blank`` or the kind of failure), ``parse_ok``, the fixed ``record`` and its confidence.

    A blank page is never sent to the model. A page that fails has an empty record and confidence
    0. What replies say is kept in the shared folder, so that no call is made and no reply read twice.
    """
    blank = X.is_blank(F.col("text"))
    asked = models.prompts(pages.where(~blank).select("doc_id", "pos", "page_number", "text"))
    replies = models.run_model(asked.drop("text"), make, in_flight=in_flight, deadline=deadline).drop("prompt")
    told = models.parse_replies(replies, simple).select("doc_id", "pos", "page_number", F.coalesce("error", F.lit("ok")).alias("status"), "parse_ok", "record", "seconds")
    told = scratch.keep(told, "pages")
    rest = pages.where(blank).select("doc_id", "pos", "page_number", F.lit("blank").alias("status"), F.lit(False).alias("parse_ok"), F.lit(None).cast(told.schema["record"].dataType).alias("record"), F.lit(0.0).alias("seconds"))
    every = told.unionByName(rest)
    r = F.col("record")
    flat = {f: r["patient"][f] for f in PATIENT_FIELDS} | {f: r["insurance"][f] for f in INSURANCE_FIELDS} | {"npi": r["doctor"]["npi"], "dme_id": r["dme"]["dme_id"], "postal_code": r["patient"]["postal_code"]}
    sure = consolidate.record_confidence(flat, F.size(r["dme"]["items"]))
    good = F.col("status") == "ok"
    return every.withColumns({"success": good, "confidence": F.when(good, F.struct(*[c.alias(n) for n, c in sure.items()]))})


def document_records(pages: DataFrame, make: Callable[[], models.Model], simple: bool = False, in_flight: int = 4, deadline: float | None = 60.0) -> dict[str, DataFrame]:
    """``pages`` of :func:`page_records`, and ``documents``: one whole record for each document, whatever its pages came to.

    ``patient`` is the page with most fields filled, ``npi`` the earliest page's (``n_npis`` says
    how many differ), each insurance field and ``dme_id`` the first that is filled, ``items`` each once in order
    of pages. ``failed_pages`` tells number and kind of each failed page. A document whose pages
    all fail or are blank has empty values and confidence 0.
    """
    found = page_records(pages, make, simple, in_flight, deadline)
    good, r = F.col("success"), F.col("record")
    listed = found.where("success").select("doc_id", "pos", F.posexplode("record.dme.items").alias("item_pos", "i")).select("doc_id", "pos", "item_pos", "i.item_name", "i.item_quantity")
    one = consolidate.distinct_items(listed)
    items = one.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("item_no", "item_name", "item_quantity"))), lambda i: F.struct(i["item_name"].alias("item_name"), i["item_quantity"].alias("item_quantity"))).alias("items"))
    failed = ~good & (F.col("status") != "blank")
    of = lambda c: F.when(good, c)
    # all in one aggregate: every page's record moves once
    counts = found.groupBy("doc_id").agg(
        consolidate.fullest_of({f: r["patient"][f] for f in PATIENT_FIELDS}, counts=good).alias("patient"), consolidate.npi_of(of(r["doctor"]["npi"])).alias("npi"),
        F.size(F.collect_set(of(F.when(~X.is_blank(r["doctor"]["npi"]), r["doctor"]["npi"])))).cast("long").alias("n_npis"),
        F.struct(*[consolidate.first_of(of(r["insurance"][f])).alias(f) for f in INSURANCE_FIELDS]).alias("insurance"), consolidate.first_of(of(r["dme"]["dme_id"])).alias("dme_id"),
        consolidate.mean_confidence(good, F.col("confidence.overall")).alias("extraction_confidence"),
        F.count("*").alias("total_pages"), F.count(F.when(good, 1)).alias("successful_pages"), F.count(F.when(F.col("status") == "blank", 1)).alias("blank_pages"),
        F.sort_array(F.collect_list(F.when(failed, F.struct("page_number", "status")))).alias("failed_pages"), F.sum("seconds").alias("seconds"),
    )
    nobody = F.struct(*[F.lit("").alias(f) for f in PATIENT_FIELDS])
    documents = counts.join(items, "doc_id", "left").select(
        "doc_id", F.coalesce("patient", nobody).alias("patient"), "npi", "n_npis", "insurance", "dme_id",
        F.coalesce("items", F.array().cast("array<struct<item_name:string,item_quantity:string>>")).alias("items"),
        "extraction_confidence", "total_pages", "successful_pages", "blank_pages", "failed_pages", "seconds",
    )
    return {"pages": found, "documents": documents}
