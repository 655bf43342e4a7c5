"""Scalar text functions: normalisers, name parts, token estimates, page text, JSON in text.

All are column expressions of built-in functions. Blank input gives the empty string
throughout; a null is a blank. Patterns carry ``(?U)``, so letters, digits and white space
are those of Unicode.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles before a name and endings after it.
NAME_PREFIXES = ("mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam")
BASIC_PREFIXES = ("mr", "mrs", "ms", "dr")
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")

#: Short forms of first names.
NICKNAMES = {
    "william": ("bill", "will", "willie"),
    "robert": ("bob", "rob", "bobby"),
    "richard": ("dick", "rick", "ricky"),
    "james": ("jim", "jimmy"),
    "john": ("jon", "johnny"),
    "michael": ("mike", "mikey"),
    "david": ("dave",),
    "joseph": ("joe", "joey"),
    "thomas": ("tom", "tommy"),
    "charles": ("charlie", "chuck"),
    "elizabeth": ("beth", "liz", "lizzie", "betty"),
    "jennifer": ("jen", "jenny"),
    "patricia": ("pat", "patty", "tricia"),
    "susan": ("sue", "suzie"),
    "margaret": ("maggie", "peggy", "meg"),
    "sarah": ("sally",),
}

#: Words of addresses and their short forms, and the short forms spelled out again.
ADDRESS_WORDS = {
    "street": "st",
    "avenue": "ave",
    "boulevard": "blvd",
    "lane": "ln",
    "drive": "dr",
    "road": "rd",
    "court": "ct",
    "place": "pl",
    "square": "sq",
    "terrace": "terr",
    "highway": "hwy",
    "suite": "ste",
    "apartment": "apt",
    "department": "dept",
    "building": "bldg",
    "floor": "fl",
}
ADDRESS_SPELLED = {"st": "street", "ave": "avenue", "rd": "road", "ln": "lane", "dr": "drive", "ct": "court"}
BASIC_ADDRESS_WORDS = ("street", "avenue", "boulevard", "lane", "drive", "road", "court", "suite", "apartment")

#: Names of states, in alphabetical order, and their codes.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR",
    "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID",
    "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS",
    "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY",
    "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT",
    "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV",
    "wisconsin": "WI", "wyoming": "WY",
}
#: The states for which a record's missing code is filled in.
RECORD_STATES = ("georgia", "california", "texas", "florida", "new york", "pennsylvania")

#: Tokens per character by kind of text.
TOKEN_RATIOS = {"standard_text": 0.25, "medical_text": 0.30, "ocr_text": 0.28, "mixed_content": 0.27}


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once however often ``f`` reads it; Spark would put the whole expression in each place."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends; null becomes empty."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def collapse(c: Column) -> Column:
    """Lower case, each run of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"(?U)\s+", " "))


def digits(c: Column) -> Column:
    return F.regexp_replace(text(c), r"(?U)\D", "")


def normalize_name(name: Column) -> Column:
    """Lower-cased name without title, punctuation but hyphens; an ending such as ``jr.`` stays last, as written."""
    whole = F.regexp_replace(collapse(name), rf"^(?:{'|'.join(NAME_PREFIXES)})\.? ", "")
    ending = rf"[ ,]((?:{'|'.join(NAME_SUFFIXES)})\.?)$"
    suffix = F.regexp_extract(whole, ending, 1)
    body = F.regexp_replace(F.regexp_replace(whole, ending, ""), r"(?U)[^\w\s\-]", " ")
    body = F.trim(F.regexp_replace(body, r"(?U)\s+", " "))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\s*-\s*", "-"), "-$", ""), "^-", "")
    return F.when(suffix != "", F.concat(body, F.lit(" "), suffix)).otherwise(body)


def normalize_name_basic(name: Column) -> Column:
    """Lower-cased name without a short title."""
    return F.trim(F.regexp_replace(collapse(name), rf"^(?:{'|'.join(BASIC_PREFIXES)})\.? ", ""))


def _iso(year: Column, month: Column, day: Column) -> Column:
    """``yyyy-mm-dd`` for months 1 to 12 and days 1 to 31 (no calendar check), else null."""
    fits = lambda v: v["m"].between(1, 12) & v["d"].between(1, 31)
    return once(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), lambda v: F.when(fits(v), F.format_string("%04d-%02d-%02d", v["y"], v["m"], v["d"])))


def _int(c: Column) -> Column:
    return once(c, lambda v: F.when(v.rlike(r"^\d{1,9}$"), v).cast("int"))


def normalize_dob(dob: Column) -> Column:
    """ISO form of month-first dates of 8 or 6 digits; anything else comes back lower-cased.

    Eight digits in three parts are month, day, year; without three parts the digits are
    taken as MMDDYYYY. Six digits are MMDDYY, 50 to 99 in the 1900s. So ``1/1/1980``, six
    digits, gives ``1980-11-19``.
    """
    century = lambda y: once(y, lambda y: F.when(y < 100, y + 1900).otherwise(y))
    recent = lambda y: once(y, lambda y: F.when(y >= 50, y + 1900).otherwise(y + 2000))

    def split_form(parts: Column) -> Column:
        part = lambda k: _int(digits(F.get(parts, F.lit(k))))
        return F.when(F.size(parts) == 3, _iso(century(part(2)), part(0), part(1)))

    def by_length(d: Column) -> Column:
        at = lambda a, n: _int(F.substring(d, a, n))
        eight = F.coalesce(once(F.split(text(dob), r"[/\-.]"), split_form), _iso(century(at(5, 4)), at(1, 2), at(3, 2)))
        return F.when(F.length(d) == 8, eight).when(F.length(d) == 6, _iso(recent(at(5, 2)), at(1, 2), at(3, 2)))

    return F.coalesce(once(digits(dob), by_length), F.lower(strip(dob)))


def normalize_dob_basic(dob: Column) -> Column:
    """ISO form of MMDDYYYY, any separators; else lower-cased."""
    d = digits(dob)
    at = lambda a, n: _int(F.substring(d, a, n))
    return F.coalesce(F.when(F.length(d) == 8, _iso(at(5, 4), at(1, 2), at(3, 2))), F.lower(strip(dob)))


def normalize_date(date: Column) -> Column:
    """As :func:`normalize_dob_basic`, with years below 100 moved to 1950-2049."""
    d = digits(date)
    at = lambda a, n: _int(F.substring(d, a, n))
    y = at(5, 4)
    year = F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)
    return F.coalesce(F.when(F.length(d) == 8, _iso(year, at(1, 2), at(3, 2))), F.lower(strip(date)))


def normalize_dob_strict(dob: Column) -> Column:
    """The normalised date if it is one of the calendar, else null."""
    iso = normalize_dob(dob)
    return F.date_format(F.try_to_timestamp(F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")


def chunk_dob(dob: Column) -> Column:
    """Date as chunks compare it: ``-`` between parts; MM-DD-YY and YYYY-MM-DD become ISO."""
    dashed = F.translate(text(dob), "/. ", "---")
    parts = F.filter(F.transform(F.split(dashed, "-"), strip), lambda p: p != "")
    p = lambda k: F.get(parts, F.lit(k))
    two = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    century = F.when(_int(p(2)) < 50, F.concat(F.lit("20"), p(2))).otherwise(F.concat(F.lit("19"), p(2)))
    return (
        F.when((F.size(parts) == 3) & (F.length(p(2)) == 2) & p(2).rlike(r"^\d+$"), F.concat_ws("-", century, two(p(0)), two(p(1))))
        .when((F.size(parts) == 3) & (F.length(p(0)) == 4) & (F.length(p(2)) != 2), F.concat_ws("-", p(0), two(p(1)), two(p(2))))
        .otherwise(dashed)
    )


def _replace_words(c: Column, words: dict[str, str]) -> Column:
    return reduce(lambda at, kv: F.regexp_replace(at, rf"(?U)\b{kv[0]}\b", kv[1]), words.items(), c)


def normalize_address(address: Column) -> Column:
    """Words shortened, six short forms spelled out again, states as codes, in the tables' order.

    Because ``virginia`` is replaced first, ``west virginia`` becomes ``west VA``.
    """
    c = _replace_words(_replace_words(_replace_words(collapse(address), ADDRESS_WORDS), ADDRESS_SPELLED), STATES)
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s#\-,.]", " "), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*,\s*", ", "), r"\s*#\s*", " #"))


def normalize_address_basic(address: Column) -> Column:
    """Words shortened wherever they stand, also inside other words."""
    return F.trim(reduce(lambda at, w: F.replace(at, F.lit(w), F.lit(ADDRESS_WORDS[w])), BASIC_ADDRESS_WORDS, collapse(address)))


def normalize_phone(phone: Column) -> Column:
    """``ddd-ddd-dddd`` for 10 digits or 11 with a leading 1, ``ddd-dddd`` for 7; else stripped."""
    d = digits(phone)
    ten = F.when(F.length(d) == 10, d).when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10))
    dashed = F.concat(F.substring(ten, 1, 3), F.lit("-"), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4))
    seven = F.when(F.length(d) == 7, F.concat(F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 4)))
    return F.coalesce(dashed, seven, strip(phone))


def normalize_mrn(mrn: Column) -> Column:
    """Record number without its label, upper-cased."""
    bare = F.regexp_replace(text(mrn), r"(?iU)(mrn|medical record|patient id|account)\s*[:#]?\s*", "")
    return F.upper(F.regexp_replace(bare, r"(?U)[^\w\-]", ""))


def name_variants(name: Column) -> Column:
    """The name as given, then its normal form with each nickname or full first name put in, each once."""
    other = {full: list(short) for full, short in NICKNAMES.items()} | {s: [full] for full, short in NICKNAMES.items() for s in short}
    table = F.create_map(*[x for k, v in other.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    base = normalize_name(name)
    bare = lambda part: F.regexp_replace(part, r"^[.,\-_]+|[.,\-_]+$", "")
    made = F.transform(
        F.filter(F.split(base, " "), lambda p: F.element_at(table, bare(p)).isNotNull()),
        lambda p: F.transform(F.element_at(table, bare(p)), lambda v: F.replace(base, bare(p), v)),
    )
    return F.array_distinct(F.concat(F.array(text(name)), F.flatten(made)))


def name_signature(name: Column) -> Column:
    """First initial and the rest of the name, then the sorted variants, joined by ``|``; a one-word name is its own signature."""
    base = normalize_name(name)
    parts = F.split(base, " ")
    rest = F.array_join(F.slice(parts, 2, F.size(parts)), " ")
    full = F.concat(F.substring(base, 1, 1), rest, F.lit("|"), F.array_join(F.sort_array(name_variants(name)), "|"))
    return F.when(F.size(parts) < 2, base).otherwise(full)


def name_parts(full_name: Column) -> Column:
    """Struct ``first_name, middle_name, last_name``: the last word is the last name, what is between is the middle."""
    p = F.filter(F.split(F.regexp_replace(text(full_name), r"(?U)\s+", " "), " "), lambda x: x != "")
    n, empty = F.size(p), F.lit("")
    return F.struct(
        F.when(n > 0, F.get(p, F.lit(0))).otherwise(empty).alias("first_name"),
        F.when(n > 2, F.array_join(F.slice(p, F.lit(2), F.greatest(n - 2, F.lit(0))), " ")).otherwise(empty).alias("middle_name"),
        F.when(n > 1, F.element_at(p, -1)).otherwise(empty).alias("last_name"),
    )


def signature(name: Column, dob: Column) -> Column:
    """``name|dob`` in normal form; empty without a name."""
    n = normalize_name(name)
    return F.when(n == "", F.lit("")).otherwise(F.concat(n, F.lit("|"), normalize_dob(dob)))


def signature_with_address(name: Column, dob: Column, address: Column) -> Column:
    return F.concat_ws("|", normalize_name_basic(name), normalize_dob_basic(dob), normalize_address_basic(address))


def chunk_signature(name: Column, dob: Column) -> Column:
    return F.concat(collapse(name), F.lit("|"), chunk_dob(dob))


#: A written date.
_DATE = r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}"
#: What introduces a date of birth, tried in this order.
BIRTH_LABELS = (rf"\bDOB[:\s]*({_DATE})\b", rf"\bDate of Birth[:\s]*({_DATE})\b", rf"\bBorn[:\s]*({_DATE})\b", r"\bAge[:\s]*(\d{1,2})[yo]\b", rf"\b({_DATE})\b")


def dates_of_birth(c: Column) -> Column:
    """Dates after ``DOB``, ``Date of Birth``, ``Born``, ages after ``Age``, then any date; each once."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text(c), F.lit("(?iU)" + p), F.lit(1)) for p in BIRTH_LABELS]))


def clean_for_tokens(c: Column) -> Column:
    one = F.regexp_replace(text(c), r"(?U)\s+", " ")
    return strip(F.regexp_replace(one, r"""(?U)[^\w\s\-.,;:!@#$%^&*()\[\]{}"'/?<>|\\`~]""", " "))


def estimate_tokens(c: Column, kind: str = "ocr_text") -> Column:
    """Characters of the cleaned text times the kind's ratio, rounded down."""
    return F.floor(F.length(clean_for_tokens(c)) * F.lit(TOKEN_RATIOS.get(kind, TOKEN_RATIOS["ocr_text"]))).cast("long")


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(text(c))


def fenced_json(c: Column) -> Column:
    """JSON of a reply: what a ``json`` fence holds, else the balanced braces of a reply that begins with one; else null."""
    body = text(c)
    fence = F.regexp_extract(body, r"(?s)```json(.*?)```", 1)
    has_fence = F.contains(body, F.lit("```json")) & body.rlike(r"(?s)```json.*?```")
    opened = body.rlike(r"(?U)^\s*\{")
    return F.when(has_fence, strip(fence)).when(opened, once(F.regexp_extract(body, r"(?s)\{.*", 0), _balanced))


def _balanced(tail: Column) -> Column:
    """The balanced braces with which a text begins, else null."""
    closed = F.split(tail, r"\}")  # what stands before each closing brace, and the rest
    end = F.aggregate(
        once(closed, lambda c: F.slice(c, F.lit(1), F.size(c) - 1)),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end")),
        lambda a, part: F.when(a["end"] > 0, a).otherwise(_brace_step(a, part)),
        lambda a: a["end"],
    )
    return once(end, lambda n: F.when(n > 0, F.substring(tail, F.lit(1), n)))


def _brace_step(a: Column, part: Column) -> Column:
    at = a["at"] + F.length(part) + 1
    depth = a["depth"] + F.length(part) - F.length(F.replace(part, F.lit("{"), F.lit(""))) - 1
    return F.struct(at.alias("at"), depth.alias("depth"), F.when(depth == 0, at).otherwise(0).alias("end"))


def greedy_json(c: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty if there is none."""
    return F.regexp_extract(text(c), r"(?s)\{.*\}", 0)


def text_fallback(c: Column) -> Column:
    """Struct ``phone, mobile_landline, npi, dob`` found in plain text, empty where nothing fits."""
    body = text(c)
    phones = F.regexp_extract_all(body, F.lit(r"(?U)\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"), F.lit(0))
    dashed = lambda k: F.translate(text(F.get(phones, F.lit(k))), ". ", "--")
    npis = F.filter(F.regexp_extract_all(body, F.lit(r"(?U)\b(\d{10})\b"), F.lit(1)), lambda x: x.rlike("^[12]"))
    us = F.regexp_extract(body, r"(?U)\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b", 1)
    iso = F.regexp_extract(body, r"(?U)\b(\d{4}[/-]\d{1,2}[/-]\d{1,2})\b", 1)
    return F.struct(
        dashed(0).alias("phone"),
        dashed(1).alias("mobile_landline"),
        text(F.get(npis, F.lit(0))).alias("npi"),
        F.when(us != "", us).otherwise(iso).alias("dob"),
    )


def title(c: Column) -> Column:
    """First letter of each run of letters upper-cased, the others lower-cased, also after ``-`` and ``'``."""
    runs = F.regexp_extract_all(text(c), F.lit(r"(?U)\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def record_phone(c: Column) -> Column:
    bare = F.regexp_replace(text(c), r"(?U)[^\d\-]", "")
    return F.when(bare.rlike(r"^\d{10}$"), F.regexp_replace(bare, r"^(\d{3})(\d{3})(\d{4})$", "$1-$2-$3")).otherwise(bare)


def record_state_code(code: Column, state: Column) -> Column:
    known = reduce(lambda at, s: F.when(F.lower(text(state)) == s, F.lit(STATES[s])).otherwise(at), RECORD_STATES, F.lit(""))
    return F.when(text(code) != "", strip(F.upper(text(code)))).otherwise(known)


def record_npi(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 10, d).otherwise(F.lit(""))


def record_full_name(full: Column, first: Column, middle: Column, last: Column) -> Column:
    given = F.filter(F.array(text(first), text(middle), text(last)), lambda x: strip(x) != "")
    return F.when(text(full) != "", full).otherwise(F.array_join(given, " "))


def characters_per_second(chars: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, chars / seconds).otherwise(F.lit(0.0))


def efficiency(rate: Column) -> Column:
    return F.when(rate > 1000, "high").when(rate > 500, "medium").otherwise("low")
