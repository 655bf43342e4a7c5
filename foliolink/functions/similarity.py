"""String and record similarities between 0 and 1.

What Spark's functions can express stays with them; Jaro-Winkler and the matching-blocks
ratio have no built-in and are Arrow UDFs over small per-pair helpers. Everywhere two blank
values are alike (1.0) and a blank and a value are not (0.0).
"""

from __future__ import annotations

import difflib
from collections.abc import Callable
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

#: Characters that are read as each other, from the first to the second only.
CONFUSIONS = {
    "0": ["o", "O"],
    "1": ["l", "i", "I", "|"],
    "2": ["z", "Z"],
    "5": ["s", "S"],
    "8": ["b"],
    "o": ["0"],
    "l": ["1", "i", "I"],
    "i": ["1", "l", "|"],
    "z": ["2"],
    "s": ["5"],
}
CONFUSED = frozenset((a, b) for a, others in CONFUSIONS.items() for b in others)

#: Weight of each field of a record.
FIELD_WEIGHTS = {
    "full_name": 40,
    "first_name": 20,
    "last_name": 20,
    "dob": 30,
    "address_full": 20,
    "city": 5,
    "state": 3,
    "postal_code": 5,
    "phone": 10,
    "mobile_landline": 5,
    "email": 8,
    "account_number": 15,
    "ssn": 25,
}
NAME_FIELDS = ("full_name", "first_name", "last_name")
ADDRESS_FIELDS = ("address_full", "city", "state", "postal_code")
PHONE_FIELDS = ("phone", "mobile_landline")


def _blanks(a: Column, b: Column, score: Column) -> Column:
    none_a, none_b = X.text(a) == "", X.text(b) == ""
    return F.when(none_a & none_b, 1.0).when(none_a | none_b, 0.0).otherwise(score)


# ---- per-pair helpers, for UDFs and ordered folds --------------------------------------


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro-Winkler, case-blind, with the prefix bonus always applied and halves of transpositions kept.

    The window is half the longer length less one, so equal one-letter strings have an empty
    window and score 0.
    """
    if not a or not b:
        return float(a == b)
    a, b = a.lower(), b.lower()
    reach = max(len(a), len(b)) // 2 - 1
    used: set[int] = set()
    left = []
    for i, ch in enumerate(a):
        hit = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if b[j] == ch and j not in used), None)
        if hit is not None:
            used.add(hit)
            left.append(ch)
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(x != b[j] for x, j in zip(left, sorted(used))) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    return jaro + 0.1 * len(commonprefix([a[:4], b[:4]])) * (1 - jaro)


def ocr_of(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    n = max(len(a), len(b))
    pairs = zip(a.ljust(n).lower(), b.ljust(n).lower())
    return sum(1.0 if x == y else 0.8 if (x, y) in CONFUSED else 0.0 for x, y in pairs) / n


def token_of(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x | y else 1.0


def blend_of(a: str, b: str) -> float:
    """0.4 Jaro-Winkler, 0.3 OCR-aware, 0.3 tokens: the score of names and of addresses."""
    if not a or not b:
        return float(a == b)
    a, b = " ".join(a.lower().split()), " ".join(b.lower().split())
    return 0.4 * jaro_winkler_of(a, b) + 0.3 * ocr_of(a, b) + 0.3 * token_of(a, b)


# ---- columns -----------------------------------------------------------------------------


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return _blanks(a, b, 1.0 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the distinct lower-cased words."""
    return _blanks(a, b, token_set_similarity(token_set(a), token_set(b)))


def token_set(c: Column) -> Column:
    """The distinct lower-cased words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(X.text(c)), F.lit(r"(?U)\S+"), F.lit(0)))


def token_set_similarity(x: Column, y: Column) -> Column:
    """Jaccard of two sets; two empty ones are alike. The union's size follows from that of the intersection."""
    common = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(common / (F.size(x) + F.size(y) - common))


def common_words(a: Column, b: Column) -> Column:
    """As :func:`token_similarity`, but 0 as soon as either has no word."""
    return F.when((X.collapse(a) == "") | (X.collapse(b) == ""), 0.0).otherwise(token_similarity(a, b))


def ocr_similarity(a: Column, b: Column) -> Column:
    """Share of equal places; a pair of characters that are read as each other counts 0.8."""
    n = F.greatest(F.length(a), F.length(b))
    chars = lambda c: F.split(F.lower(F.rpad(c, n, " ")), "")
    confused = F.array(*[F.lit(x + y) for x, y in sorted(CONFUSED)])
    each = F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, 1.0).when(F.array_contains(confused, F.concat(x, y)), 0.8).otherwise(0.0))
    return _blanks(a, b, F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / n)


def date_similarity(a: Column, b: Column) -> Column:
    return _blanks(a, b, (X.normalize_date(a) == X.normalize_date(b)).cast("double"))


def phone_similarity(a: Column, b: Column) -> Column:
    return _blanks(a, b, (bare_phone(a) == bare_phone(b)).cast("double"))


def bare_phone(c: Column) -> Column:
    """Digits, without a leading 1 before ten others."""
    return F.regexp_replace(X.digits(c), r"^1(?=\d{10}$)", "")


def _jaro_winkler(a: Column, b: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict[tuple[str, str], float] = {}
        for pair in zip(a.fillna(""), b.fillna("")):
            if pair not in memo:
                memo[pair] = jaro_winkler_of(*pair)
        return pd.Series([memo[pair] for pair in zip(a.fillna(""), b.fillna(""))], dtype=float)

    return score(a, b)


def blend_similarity(a: Column, b: Column) -> Column:
    """:func:`blend_of` for columns, the same to the last bit."""

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([blend_of(x, y) for x, y in zip(a.fillna(""), b.fillna(""))], dtype=float)

    return score(a, b)


def _blocks_ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a.fillna(""), b.fillna(""))], dtype=float)

    return score(a, b)


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    return _jaro_winkler(a, b)


def fuzzy_similarity(a: Column, b: Column, algorithm: str = "jaro_winkler") -> Column:
    """``jaro_winkler``, ``levenshtein`` or ``difflib``."""
    known = {"jaro_winkler": _jaro_winkler, "levenshtein": levenshtein_similarity, "difflib": _blocks_ratio}
    if algorithm not in known:
        raise ValueError(f"unknown algorithm: {algorithm}")
    return known[algorithm](a, b)


def name_similarity(a: Column, b: Column) -> Column:
    x, y = X.collapse(a), X.collapse(b)
    return _blanks(a, b, 0.4 * _jaro_winkler(x, y) + 0.3 * ocr_similarity(x, y) + 0.3 * token_similarity(x, y))


def address_similarity(a: Column, b: Column) -> Column:
    return name_similarity(a, b)


def record_similarity(a: Column, b: Column, fields: list[str], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean over the struct fields that at least one of two records fills; 0 if there is none."""
    return _record(a, b, fields, weights, name_similarity)


def record_bound(a: Column, b: Column, fields: list[str], weights: dict[str, float] | None = None) -> Column:
    """At least :func:`record_similarity`, without Python: of Jaro-Winkler only what the lengths allow."""
    return _record(a, b, fields, weights, _name_bound)


def _name_bound(a: Column, b: Column) -> Column:
    x, y = X.collapse(a), X.collapse(b)
    n, m = F.length(x), F.length(y)
    jaro = (F.least(n, m) * (1 / n + 1 / m) + 1) / 3
    return _blanks(x, y, 0.4 * (jaro + 0.4 * (1 - jaro)) + 0.3 * ocr_similarity(x, y) + 0.3 * token_similarity(x, y) + 1e-9)


def _record(a: Column, b: Column, fields: list[str], weights: dict[str, float] | None, of_name: Callable[[Column, Column], Column]) -> Column:
    total, weight = F.lit(0.0), F.lit(0.0)
    for field, w in (weights or FIELD_WEIGHTS).items():
        if field not in fields:
            continue
        x, y = X.text(a[field]), X.text(b[field])
        if field in NAME_FIELDS or field in ADDRESS_FIELDS:
            score = of_name(x, y)
        elif field == "dob":
            score = date_similarity(x, y)
        elif field in PHONE_FIELDS:
            score = phone_similarity(x, y)
        else:
            score = ocr_similarity(x, y)
        used = (x != "") | (y != "")
        total = total + F.when(used, score * w).otherwise(0.0)
        weight = weight + F.when(used, F.lit(float(w))).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(0.0)


def exact_key(field: str, value: Column) -> Column | None:
    """What two values of a date or phone field have in common exactly when they score 1, else 0; null for a blank one. No column for other fields."""
    made = X.normalize_date(value) if field == "dob" else bare_phone(value) if field in PHONE_FIELDS else None
    return None if made is None else F.when(X.text(value) != "", made)
