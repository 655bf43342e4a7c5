"""Names and dates of birth in page text: candidates, scores, best ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: What introduces a name, tried in this order. Matching ignores case, so
#: ``[A-Z]`` is any letter, and ``^`` and ``$`` are those of lines.
NAME_PATTERNS = (
    r"Patient Name[:\s]*([A-Za-z\-\,\.\s]+?)(?:\n|$|[A-Z])",
    r"Name[:\s]*([A-Za-z\-\,\.\s]+?)(?:\n|$|[A-Z])",
    r"(?:Patient|Name)[:\s]*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?:\s+[A-Z]\.?)?(?:\s+[A-Z][a-z]+)*)",
    r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?:\s+[A-Z]\.?)?(?:\s+[A-Z][a-z]+)*)",
    r"(?:[Pp]atient|Name|Name of Patient)[:\s]*([A-Za-z\s\,\.\-]+?)(?:\n|Sex|DOB|Age|$)",
)
_DATE = r"\d{1,2}[\/\-\.\s]\d{1,2}[\/\-\.\s]\d{2,4}"
#: What introduces a date of birth, with the number of the group that holds it.
DOB_PATTERNS = (
    (rf"DOB[:\s]*({_DATE})", 1),
    (rf"Date of Birth[:\s]*({_DATE})", 1),
    (rf"Birth(?:\s+Date)?[:\s]*({_DATE})", 1),
    (rf"(?:(?:Sex|Gender)[:\s]*[MFmf][,\s]*)?DOB[:\s]*({_DATE})", 1),
    (rf"Age[:\s]*(\d{{1,2}})\s*yo(?:\s*\(DOB:\s*({_DATE})\))?", 2),
)
#: Label words that are no names; the scores of best_name and best_dob are fixed values too.
KEYWORDS = ("patient", "name", "mr", "mrs", "dr")


def has_date_shape(c: Column) -> Column:
    return c.rlike(rf"(?U)^{_DATE}$") | c.rlike(r"^\d{8}$") | c.rlike(r"^\d{6}$")


def name_candidates(c: Column) -> Column:
    """All captures of more than two characters, pattern by pattern."""
    found = F.concat(*[F.regexp_extract_all(X.text(c), F.lit("(?imUd)" + p), F.lit(1)) for p in NAME_PATTERNS])
    return F.filter(F.transform(found, X.strip), lambda n: F.length(n) > 2)


def dob_candidates(c: Column) -> Column:
    found = F.concat(*[F.regexp_extract_all(X.text(c), F.lit("(?iU)" + p), F.lit(group)) for p, group in DOB_PATTERNS])
    return F.transform(F.filter(found, has_date_shape), X.strip)


def _best(candidates: Column, score) -> Column:
    """Highest score, the earliest of equals; empty without candidates."""
    ranked = F.transform(candidates, lambda x, i: F.struct(score(x).alias("score"), (-i).alias("first"), x.alias("value")))
    return F.coalesce(F.array_max(ranked)["value"], F.lit(""))


def best_name(candidates: Column, page_text: Column) -> Column:
    """Capitals +3 (all caps +2), a blank +2, a label word -1, 5 to 50 characters +1, ``dob``, ``birth`` or ``age`` within 200 characters +2."""

    def score(name: Column) -> Column:
        caps = F.when(name.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$"), 3).when(name.rlike(r"^[A-Z]+\s+[A-Z]+$"), 2).otherwise(0)
        label = F.when(F.lower(name).rlike("|".join(KEYWORDS)), -1).otherwise(0)
        near = F.substring(page_text, F.call_function("locate", name, page_text), F.lit(200))
        return (
            caps
            + F.when(F.contains(name, F.lit(" ")), 2).otherwise(0)
            + label
            + F.when(F.length(name).between(5, 50), 1).otherwise(0)
            + F.when(near.rlike("(?i)dob|birth|age"), 2).otherwise(0)
        )

    return _best(candidates, score)


def best_dob(candidates: Column) -> Column:
    """A separator +2, eight digits +1, a year from 1900 to 2024 +2."""

    def score(dob: Column) -> Column:
        year = F.regexp_extract(dob, r"((?:19|20)\d{2})", 1)
        return (
            F.when(dob.rlike(r"[/\-.\s]"), 2).otherwise(0)
            + F.when(F.length(X.digits(dob)) == 8, 1).otherwise(0)
            + F.when((year != "") & (year <= "2024"), 2).otherwise(0)
        )

    return _best(candidates, score)


def with_person(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """``pages`` with ``extracted_name, extracted_dob, full_name, first_name, middle_name, last_name, dob, sig_name, sig_dob``.

    All are empty where nothing is found; ``sig_name`` and ``sig_dob`` are the parts of the signature.
    """
    return _with(
        _with(
            _with(
                _with(pages, _names=name_candidates(F.col(text_col)), _dobs=dob_candidates(F.col(text_col))),
                extracted_name=best_name(F.col("_names"), F.col(text_col)),
                extracted_dob=best_dob(F.col("_dobs")),
            ).drop("_names", "_dobs"),
            full_name=F.col("extracted_name"),
            dob=F.when(F.col("extracted_dob") != "", X.normalize_dob(F.col("extracted_dob"))).otherwise(""),
            **{part: X.name_parts(F.col("extracted_name"))[part] for part in ("first_name", "middle_name", "last_name")},
        ),
        sig_name=X.normalize_name(F.col("full_name")),
        sig_dob=X.normalize_dob(F.col("dob")),
    )


def _with(pages: DataFrame, **made: Column) -> DataFrame:
    """``pages`` with more columns, each computed once: nothing that reads them is merged with their expressions."""
    return pages.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))
