"""One record per document from the records of its pages, and confidence of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: The fields that count for a patient.
COUNTED_FIELDS = ("full_name", "first_name", "last_name", "dob", "address_full", "city", "state", "postal_code", "phone")


def filled(values: list[Column]) -> Column:
    """Number of values that aren't blank."""
    return sum((F.when(X.is_blank(v), 0).otherwise(1) for v in values), F.lit(0))


def fullest(rows: DataFrame, fields: list[str], key: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Per document the row with most filled fields, the earliest of equals."""
    return rows.groupBy(key).agg(fullest_of({f: F.col(f) for f in fields}, pos).alias("best")).select(key, "best.*")


def fullest_of(values: dict[str, Column], pos: str = "pos", counts: Column | None = None) -> Column:
    """The aggregate of :func:`fullest`: a struct of the values, of the rows that count."""
    place = F.struct(filled(list(values.values())), -F.col(pos))
    return F.max_by(F.struct(*[v.alias(f) for f, v in values.items()]), place if counts is None else F.when(counts, place))


def first_filled(rows: DataFrame, fields: list[str], key: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Per document and field the first value that isn't empty; empty where there is none."""
    return rows.groupBy(key).agg(*[first_of(F.col(f), pos).alias(f) for f in fields])


def first_of(value: Column, pos: str = "pos") -> Column:
    """The aggregate of :func:`first_filled`."""
    return F.coalesce(F.min(F.when(X.text(value) != "", F.struct(F.col(pos), value.alias("v"))))["v"], F.lit(""))


def one_npi(rows: DataFrame, key: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Per document the NPI of the earliest page that has one, the smallest of equals, and how many there are."""
    return rows.groupBy(key).agg(npi_of(F.col("npi"), pos).alias("npi"), F.count_distinct(F.when(~X.is_blank(F.col("npi")), F.col("npi"))).alias("n_npis"))


def npi_of(npi: Column, pos: str = "pos") -> Column:
    """The aggregate of :func:`one_npi`."""
    return F.coalesce(F.min(F.when(~X.is_blank(npi), F.struct(F.col(pos), npi.alias("v"))))["v"], F.lit(""))


def distinct_items(items: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("pos", "item_pos")) -> DataFrame:
    """A document's items ``(item_name, item_quantity)`` each once, numbered in order of first appearance."""
    first = F.min(F.struct(*order)).alias("first")
    one = items.groupBy(key, X.text(F.col("item_name")).alias("item_name"), X.text(F.col("item_quantity")).alias("item_quantity")).agg(first)
    return one.withColumn("item_no", F.row_number().over(Window.partitionBy(key).orderBy("first", "item_name", "item_quantity"))).select(key, "item_no", "item_name", "item_quantity")


def record_confidence(record: dict[str, Column], n_items: Column) -> dict[str, Column]:
    """``patient, doctor, insurance, dme`` and their mean ``overall``.

    Patient and insurance: part of the counted fields that are filled. NPI: 1 for ten
    digits, 0.5 for anything else. Items: 1 with an id and items, 0.5 with either.
    """
    patient = filled([record[f] for f in COUNTED_FIELDS if f in record]) / len(COUNTED_FIELDS)
    npi = X.strip(record["npi"])
    doctor = F.when(npi.rlike(r"^\d{10}$"), 1.0).when(npi != "", 0.5).otherwise(0.0)
    ids = [record[f"{rank}_insurance{part}"] for rank in ("primary", "secondary", "tertiary") for part in ("", "_id") if f"{rank}_insurance{part}" in record]
    insurance = filled(ids) / 6
    has_id, has_items = ~X.is_blank(record["dme_id"]), n_items > 0
    dme = F.when(has_id & has_items, 1.0).when(has_id | has_items, 0.5).otherwise(0.0)
    return {"patient": patient, "doctor": doctor, "insurance": insurance, "dme": dme, "overall": (patient + doctor + insurance + dme) / 4}


def merge_reply(reply: Column, schema: str) -> Column:
    """A JSON reply as the fixed record: unknown keys go, values are stripped text, missing ones empty."""
    return F.from_json(reply, schema, {"mode": "PERMISSIVE"})


def extraction_confidence(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document the mean overall confidence of its successful pages to two places, 0 without any."""
    return pages.groupBy(key).agg(mean_confidence(F.col("success"), F.col("overall")).alias("extraction_confidence"))


def mean_confidence(success: Column, overall: Column) -> Column:
    """The aggregate of :func:`extraction_confidence`."""
    return F.round(F.coalesce(F.avg(F.when(success, overall)), F.lit(0.0)), 2)


def first_items(items: Column, most: int = 3) -> Column:
    """The first ``most`` items of a record as ``name (Qty: n)``, with ``Unknown`` and ``N/A`` for what is missing; none for null."""
    told = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    shown = lambda i: F.concat(told(i["item_name"], "Unknown"), F.lit(" (Qty: "), told(i["item_quantity"], "N/A"), F.lit(")"))
    return F.transform(F.slice(F.coalesce(items, F.array().cast("array<struct<item_name:string,item_quantity:string>>")), 1, most), shown)
