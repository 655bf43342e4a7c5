"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = "page_number int, text string, text_length int, confidence double, processing_time double, image_path string, success boolean"

EXTRACTED_FILE = (
    "extraction_info struct<pdf_path:string, pdf_name:string, extraction_timestamp:string, extraction_method:string, "
    "total_pages:int, total_characters:int, overall_confidence:double, processing_time:double, successful_pages:int, "
    "extraction_success_rate:double>, "
    "pages array<struct<page_number:int, text:string, text_length:int, confidence:double, processing_time:double, "
    "image_path:string, success:boolean>>, _corrupt_record string"
)

PATIENT_FIELDS = (
    "full_name", "first_name", "middle_name", "last_name", "dob", "address_full", "city", "state", "country", "postal_code",
    "state_code", "phone", "mobile_landline", "email", "fax", "account_number",
)
INSURANCE_FIELDS = tuple(f"{rank}_insurance{part}" for rank in ("primary", "secondary", "tertiary") for part in ("", "_id"))

RECORD = (
    f"patient struct<{', '.join(f'{f}:string' for f in PATIENT_FIELDS)}>, doctor struct<npi:string>, "
    f"insurance struct<{', '.join(f'{f}:string' for f in INSURANCE_FIELDS)}>, "
    "dme struct<dme_id:string, items:array<struct<item_name:string, item_quantity:string>>>"
)

REQUIRED_PAGE_FIELDS = ("page_number", "text", "confidence", "success")


def require_pages(pages: DataFrame) -> DataFrame:
    """``pages`` if it has the required columns; rows in which one of them is null are rejected."""
    missing = [c for c in REQUIRED_PAGE_FIELDS if c not in pages.columns]
    if missing:
        raise ValueError(f"pages lack {', '.join(missing)}")
    return pages.where(" and ".join(f"`{c}` is not null" for c in REQUIRED_PAGE_FIELDS))


def page_problems(pages: DataFrame) -> DataFrame:
    """Number of nulls per required field, as one row."""
    return pages.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in REQUIRED_PAGE_FIELDS])
