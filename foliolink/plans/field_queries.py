"""Registered queries of dates, addresses, signatures, candidates, people and results, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..operators import chunk, compare, consolidate, extract, layout, models, resolve
from . import matcher
from .queries import _COLLAPSE, _ISO, DATES, PARTIAL, PEOPLE, PLAN, dates, partial_records, people, query, source_pages, table
from .queries import ORACLES as _ORACLES

# ---- dates, addresses, signatures --------------------------------------------------------

_DIGITS = rf"{DATES}, w AS (SELECT *, regexp_replace(raw, '\D', '', 'g') AS g FROM q), v AS (SELECT *, TRY_CAST(substr(g, 1, 2) AS INTEGER) AS m, TRY_CAST(substr(g, 3, 2) AS INTEGER) AS d, TRY_CAST(substr(g, 5, 4) AS INTEGER) AS y FROM w)"


@query(
    rf"""WITH {_DIGITS} SELECT o_orderkey, coalesce(CASE WHEN length(g) = 8 THEN
{_ISO.format(m="m", d="d", y="(CASE WHEN y < 50 THEN y + 2000 WHEN y < 100 THEN y + 1900 ELSE y END)")} END, lower(trim(raw))) AS date FROM v"""
)
def norm_date(spark, sf_dir):
    return dates(spark, sf_dir).select("o_orderkey", X.normalize_date(F.col("raw")).alias("date"))


_CHUNK_DATE = """CASE WHEN len(p) = 3 AND length(p[3]) = 2 THEN CASE WHEN CAST(p[3] AS INTEGER) < 50 THEN '20' ELSE '19' END || p[3] || '-' || lpad(p[1], 2, '0') || '-' || lpad(p[2], 2, '0')
WHEN len(p) = 3 AND length(p[1]) = 4 AND length(p[3]) <> 2 THEN p[1] || '-' || lpad(p[2], 2, '0') || '-' || lpad(p[3], 2, '0') ELSE x END"""


@query(f"WITH {DATES}, w AS (SELECT o_orderkey, translate(raw, '/. ', '---') AS x, string_split(translate(raw, '/. ', '---'), '-') AS p FROM q) SELECT o_orderkey, {_CHUNK_DATE} AS date FROM w")
def chunk_date(spark, sf_dir):
    return dates(spark, sf_dir).select("o_orderkey", X.chunk_dob(F.col("raw")).alias("date"))


def _replaced(expression: str) -> str:
    for word in X.BASIC_ADDRESS_WORDS:
        expression = f"replace({expression}, '{word}', '{X.ADDRESS_WORDS[word]}')"
    return expression


@query(f"WITH {PEOPLE} SELECT c_custkey, trim({_replaced(_COLLAPSE.format('address'))}) AS address FROM q")
def norm_address_basic(spark, sf_dir):
    return people(spark, sf_dir).select("c_custkey", X.normalize_address_basic(F.col("address")).alias("address"))


@query(rf"SELECT o_orderkey, regexp_matches(raw, '^{extract._DATE}$') OR regexp_matches(raw, '^\d{{8}}$') OR regexp_matches(raw, '^\d{{6}}$') AS is_date FROM ({DATES[6:-1]})")
def date_shape(spark, sf_dir):
    return dates(spark, sf_dir).select("o_orderkey", extract.has_date_shape(F.col("raw")).alias("is_date"))


_NORMAL = _ORACLES["norm_name"].split("SELECT c_custkey, CASE", 1)[0]
_NAME = "CASE WHEN e <> '' THEN z || ' ' || e ELSE z END"


@query(f"{_NORMAL} SELECT c_custkey, {_NAME} || '|1980-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS signature FROM t")
def person_signature(spark, sf_dir):
    """Name and date as pages are grouped by them, from eight digits without separators."""
    dob = F.concat(F.lit("01"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"), F.lit("1980"))
    return people(spark, sf_dir).select("c_custkey", X.signature(F.col("name"), dob).alias("signature"))


@query(
    f"""WITH {PEOPLE} SELECT c_custkey, trim(regexp_replace({_COLLAPSE.format("name")}, '^(mr|mrs|ms|dr)\\.? ', '')) || '|1980-02-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0')
|| '|' || trim({_replaced(_COLLAPSE.format("address"))}) AS signature FROM q"""
)
def address_signature(spark, sf_dir):
    dob = F.concat(F.lit("02/"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"), F.lit("/1980"))
    return people(spark, sf_dir).select("c_custkey", X.signature_with_address(F.col("name"), dob, F.col("address")).alias("signature"))


@query(
    f"""WITH {PEOPLE}, w AS (SELECT c_custkey, {_COLLAPSE.format("name")} AS n, ['1', '3'][c_custkey % 2 + 1] || '-' || c_custkey % 9 AS a, lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS y FROM q)
SELECT c_custkey, n || '|' || CASE WHEN CAST(y AS INTEGER) < 50 THEN '20' ELSE '19' END || y || '-0' || replace(a, '-', '-0') AS signature FROM w"""
)
def chunk_signature(spark, sf_dir):
    n = F.col("c_custkey")
    dob = F.concat(F.element_at(F.array(F.lit("1"), F.lit("3")), (n % 2 + 1).cast("int")), F.lit("/"), n % 9, F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return people(spark, sf_dir).select("c_custkey", X.chunk_signature(F.col("name"), dob).alias("signature"))


GIVEN = ("Robert", "bill", "Jonathan", "Liz", "Mary-Ann", "Dr. Thomas", "Zoe")
_TABLE = {full: list(short) for full, short in X.NICKNAMES.items()} | {s: [full] for full, short in X.NICKNAMES.items() for s in short}
_MAP = "map {" + ", ".join(f"'{k}': {v}" for k, v in _TABLE.items()) + "}"
_GIVEN = f"g AS (SELECT c_custkey, {list(GIVEN)}[c_custkey % {len(GIVEN)} + 1] || ' Ray' || c_nationkey AS name FROM customer)"
_VARIANTS = f"""{_GIVEN}, b AS (SELECT *, trim(regexp_replace(lower(name), '^dr\\. ', '')) AS base FROM g),
p AS (SELECT *, flatten(list_transform(string_split(base, ' '), lambda w: list_transform(coalesce({_MAP}[w], []), lambda v: replace(base, w, v)))) AS made FROM b),
v AS (SELECT *, list_sort(list_distinct(list_concat([name], made))) AS variants FROM p)"""


def given_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    first = F.element_at(F.array(*map(F.lit, GIVEN)), (F.col("c_custkey") % len(GIVEN) + 1).cast("int"))
    return c.select("c_custkey", F.concat(first, F.lit(" Ray"), F.col("c_nationkey")).alias("name"))


@query(f"WITH {_VARIANTS} SELECT c_custkey, array_to_string(variants, '|') AS variants FROM v")
def name_variants(spark, sf_dir):
    return given_names(spark, sf_dir).select("c_custkey", F.array_join(F.sort_array(X.name_variants(F.col("name"))), "|").alias("variants"))


@query(f"WITH {_VARIANTS} SELECT c_custkey, base[1] || substr(base, strpos(base, ' ') + 1) || '|' || array_to_string(variants, '|') AS signature FROM v")
def name_signature(spark, sf_dir):
    return given_names(spark, sf_dir).select("c_custkey", X.name_signature(F.col("name")).alias("signature"))


# ---- candidates in page text -------------------------------------------------------------

FORMS = ("Patient Name: Ann Lee{}\nDOB: 01/02/19{}\nSex F", "Form 7\nName: BO RAY{}\nDate of Birth: 3-4-20{} and 5.6.1977", "Age: 41 yo (DOB: 7/8/19{1})\nMary Jane Poe\nseen", "Nothing {0} here {1}")
_PAGE = "f AS (SELECT c_custkey, [" + ", ".join("'" + f.replace("{0}", "{}").replace("{1}", "{}").replace("\n", "' || chr(10) || '").format("' || CASE c_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' Junior' ELSE ' of Rome' END || '", "' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '") + "'" if f.count("{") == 2 else "'" + f.replace("{1}", "' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '").replace("\n", "' || chr(10) || '") + "'" for f in FORMS) + "][c_custkey % 4 + 1] AS t FROM customer)"


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages of filled forms."""
    c = table(spark, sf_dir, "customer")
    n = F.col("c_nationkey")
    ending = F.when(n % 3 == 0, "").when(n % 3 == 1, " Junior").otherwise(" of Rome")
    year = F.lpad(n.cast("string"), 2, "0")
    parts = []
    for form in FORMS:
        made = F.lit(form)
        if form.count("{") == 2:
            left, middle, right = form.replace("{0}", "{}").replace("{1}", "{}").split("{}")
            made = F.concat(F.lit(left), ending, F.lit(middle), year, F.lit(right))
        else:
            left, right = form.split("{1}")
            made = F.concat(F.lit(left), year, F.lit(right))
        parts.append(made)
    return c.select("c_custkey", F.element_at(F.array(*parts), (F.col("c_custkey") % 4 + 1).cast("int")).alias("text"))


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_NAMES = "list_filter(list_transform(list_concat(" + ", ".join(f"regexp_extract_all(t, '(?im){_quoted(p)}', 1)" for p in extract.NAME_PATTERNS) + r"), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 2)"
_DOBS = (
    r"list_filter(list_concat("
    + ", ".join(f"regexp_extract_all(t, '(?i){_quoted(p)}', {g})" for p, g in extract.DOB_PATTERNS)
    + rf"), lambda x: regexp_matches(x, '^{extract._DATE}$') OR regexp_matches(x, '^\d{{8}}$') OR regexp_matches(x, '^\d{{6}}$'))"
)
_CANDIDATES = f"{_PAGE}, k AS (SELECT c_custkey, t, {_NAMES} AS names, {_DOBS} AS dobs FROM f)"


@query(f"WITH {_CANDIDATES} SELECT c_custkey, array_to_string(names, '/') AS names, array_to_string(dobs, '/') AS dobs FROM k")
def page_candidates(spark, sf_dir):
    found = form_pages(spark, sf_dir)
    return found.select("c_custkey", F.array_join(extract.name_candidates(F.col("text")), "/").alias("names"), F.array_join(extract.dob_candidates(F.col("text")), "/").alias("dobs"))


_NAME_SCORE = f"""CASE WHEN regexp_matches(x, '^[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*$') THEN 3 WHEN regexp_matches(x, '^[A-Z]+\\s+[A-Z]+$') THEN 2 ELSE 0 END
+ CASE WHEN contains(x, ' ') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(lower(x), '{"|".join(extract.KEYWORDS)}') THEN 1 ELSE 0 END
+ CASE WHEN length(x) BETWEEN 5 AND 50 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(substr(t, strpos(t, x), 200), '(?i)dob|birth|age') THEN 2 ELSE 0 END"""
_DOB_SCORE = r"""CASE WHEN regexp_matches(x, '[/\-.\s]') THEN 2 ELSE 0 END + CASE WHEN length(regexp_replace(x, '\D', '', 'g')) = 8 THEN 1 ELSE 0 END
+ CASE WHEN regexp_extract(x, '((?:19|20)\d{2})', 1) BETWEEN '1' AND '2024' THEN 2 ELSE 0 END"""


def _top(values: str, score: str) -> str:
    return f"SELECT c_custkey, arg_max(x, score * 1000 - i) AS best FROM (SELECT *, {score} AS score FROM (SELECT c_custkey, t, unnest({values}) AS x, generate_subscripts({values}, 1) AS i FROM k)) GROUP BY c_custkey"


@query(
    f"""WITH {_CANDIDATES}, n AS ({_top("names", _NAME_SCORE)}), d AS ({_top("dobs", _DOB_SCORE)})
SELECT k.c_custkey, coalesce(n.best, '') AS name, coalesce(d.best, '') AS dob FROM k LEFT JOIN n ON n.c_custkey = k.c_custkey LEFT JOIN d ON d.c_custkey = k.c_custkey"""
)
def best_candidates(spark, sf_dir):
    found = form_pages(spark, sf_dir).withColumns({"names": extract.name_candidates(F.col("text")), "dobs": extract.dob_candidates(F.col("text"))})
    return found.select("c_custkey", extract.best_name(F.col("names"), F.col("text")).alias("name"), extract.best_dob(F.col("dobs")).alias("dob"))


_LABELLED = ", ".join(f"regexp_extract_all(t, '(?i){_quoted(p)}', 1)" for p in X.BIRTH_LABELS)


@query(f"WITH {_PAGE}, u AS (SELECT c_custkey, list_concat({_LABELLED}) AS d FROM f) SELECT c_custkey, array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), '/') AS dates FROM u")
def labelled_dates(spark, sf_dir):
    return form_pages(spark, sf_dir).select("c_custkey", F.array_join(X.dates_of_birth(F.col("text")), "/").alias("dates"))


# ---- the rule matcher --------------------------------------------------------------------

#: People as far apart as names can be, so that SQL can tell the matcher's groups by equality.
CAST = ("Quentin Abbott", "Zoe Winterbottom", "Marcus Fitzgerald", "Li Yu")
BORN = ("04/12/1961", "11/30/1987", "07/07/1975", "01/23/1999")
#: The same with longer names, and one that a letter sets apart: the matcher takes the first and the last for one person.
ALIKE = ("Quentin James Abbott", "Zoe Winterbottom", "Marcus Fitzgerald", "Li Yu", "Quentin James Abbot")
ALIKE_BORN = (*BORN, BORN[0])


def matcher_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pages of an order that name one of five people, two of them alike; every seventh part's page names nobody."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page_number")).agg(F.min("l_partkey").alias("k"), F.max("l_discount").alias("c"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("k") % 5 + 1).cast("int"))
    filled = F.concat(F.lit("Patient Name: "), pick(ALIKE), F.lit("\nDOB: "), pick(ALIKE_BORN), F.lit("\nseen today"))
    return lines.select("doc_id", F.col("page_number").alias("pos"), "page_number", F.when(F.col("k") % 7 == 0, "7 / 12").otherwise(filled).alias("text"), (F.col("c") * 1000).alias("confidence"), F.lit(True).alias("success"))


_MATCHED = """p AS (
  SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS page_number, min(l_partkey) AS k, max(l_discount) * 10 AS c FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, k % 5 % 4 AS who FROM p WHERE k % 7 <> 0),
g AS (SELECT doc_id, who, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(page_number)) AS INTEGER) AS group_no FROM n GROUP BY doc_id, who),
b AS (
  SELECT n.doc_id, page_number, c, group_no, CASE WHEN page_number = lag(page_number) OVER (PARTITION BY n.doc_id, group_no ORDER BY page_number) + 1 THEN 0 ELSE 1 END AS begins
  FROM n JOIN g ON g.doc_id = n.doc_id AND g.who = n.who),
i AS (SELECT *, CAST(sum(begins) OVER (PARTITION BY doc_id, group_no ORDER BY page_number) AS INTEGER) AS entry_no FROM b)"""


@query(f"WITH {_MATCHED} SELECT doc_id, page_number, group_no, entry_no FROM i")
def identify_pages(spark, sf_dir):
    """The rule matcher: candidates, best name and date, signature, greedy groups, page runs."""
    return matcher.identify(matcher_pages(spark, sf_dir), confidence_scale=100)["pages"].select("doc_id", "page_number", "group_no", "entry_no")


@query(
    f"""WITH {_MATCHED}, e AS (SELECT doc_id, group_no, entry_no, count(*) AS n, avg(c) AS c FROM i GROUP BY ALL),
t AS (SELECT doc_id, group_no, count(*) AS entries, sum(n) AS pages, least(1.0, avg(c) + least(0.1, (count(*) - 1) * 0.05)) AS c FROM e GROUP BY ALL),
s AS (SELECT doc_id, count(*) AS k, CAST(sum(entries) AS BIGINT) AS e, CAST(sum(pages) AS BIGINT) AS a, avg(c) AS c FROM t GROUP BY doc_id),
d AS (SELECT doc_id, count(*) AS total_pages FROM p GROUP BY doc_id)
SELECT d.doc_id, total_pages, coalesce(k, 0) AS total_patients, coalesce(e, 0) AS total_entries, coalesce(a, 0) AS assigned_pages,
  round(coalesce(c, 0.0), 6) AS average_confidence, total_pages - coalesce(a, 0) AS unassigned_pages FROM d LEFT JOIN s ON s.doc_id = d.doc_id"""
)
def identify_summary(spark, sf_dir):
    found = matcher.identify(matcher_pages(spark, sf_dir), confidence_scale=100)["summary"]
    return found.withColumn("average_confidence", F.round("average_confidence", 6))


# ---- similarities of fields --------------------------------------------------------------


@query(
    rf"""WITH {_DIGITS}, n AS (SELECT o_orderkey, coalesce(CASE WHEN length(g) = 8 THEN {_ISO.format(m="m", d="d", y="y")} END, raw) AS date FROM v)
SELECT n.o_orderkey, CAST(n.o_orderkey % 7 <> 0 AND date = strftime(o_orderdate, '%Y-%m-%d') AS DOUBLE) AS similarity FROM n JOIN orders AS o ON o.o_orderkey = n.o_orderkey"""
)
def date_similarity(spark, sf_dir):
    """Dates in six forms against MM-DD-YYYY or a blank; forms of eight digits read as month, day and year."""
    other = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.date_format("o_orderdate", "MM-dd-yyyy")).alias("other"))
    return dates(spark, sf_dir).join(other, "o_orderkey").select("o_orderkey", S.date_similarity(F.col("raw"), F.col("other")).alias("similarity"))


@query(
    rf"""WITH {PEOPLE}, w AS (SELECT c_custkey, regexp_replace(regexp_replace(phone, '\D', '', 'g'), '^1(\d{{10}})$', '\1') AS a,
  CASE WHEN c_custkey % 3 = 0 THEN '555' ELSE '' END || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || lpad(CAST(c_custkey % 9973 AS VARCHAR), 4, '0') AS b FROM q)
SELECT c_custkey, CAST(a = b AS DOUBLE) AS similarity FROM w"""
)
def phone_similarity(spark, sf_dir):
    n = F.col("c_custkey")
    other = F.concat(F.when(n % 3 == 0, "555").otherwise(""), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit("."), F.lpad((n % 9973).cast("string"), 4, "0"))
    return people(spark, sf_dir).select("c_custkey", S.phone_similarity(F.col("phone"), other).alias("similarity"))


# ---- chunks of models, entries, results --------------------------------------------------

_MODELS = ", ".join(f"('{m}', {chunk.ChunkConfig.of(m).trigger}, {chunk.ChunkConfig.of(m).tokens_per_chunk})" for m in chunk.CONTEXT_LIMITS)


@query(
    f"""WITH {PLAN}, m(model, trigger_tokens, chunk_tokens) AS (VALUES {_MODELS})
SELECT doc_id, model, estimated_tokens > trigger_tokens AS needs_chunking, CAST(chunk_tokens AS INTEGER) AS chunk_tokens FROM d, m"""
)
def model_limits(spark, sf_dir):
    """Every known model's limit against batches of documents, by the tokens of their texts."""
    sizes = chunk.document_sizes(source_pages(spark, sf_dir))
    known = [(m, chunk.ChunkConfig.of(m)) for m in chunk.CONTEXT_LIMITS]
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c.trigger).alias("t"), F.lit(c.tokens_per_chunk).alias("chunk_tokens")) for m, c in known])
    return sizes.select("doc_id", "estimated_tokens", F.inline(rows)).select("doc_id", "model", (F.col("estimated_tokens") > F.col("t")).alias("needs_chunking"), "chunk_tokens")


def line_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as entries of chunks: the pages from the line's number on, up to three."""
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k"))
    first = (F.col("k") % 5).cast("int")
    return i.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("merged_no"), F.col("l_linenumber").cast("int").alias("chunk_id"), F.lit(1).alias("entry_no"), F.sequence(first, first + (F.col("l_linenumber") % 3).cast("int")).alias("pages"))


_ENTRIES = "i AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS chunk_id, CAST(min(l_partkey) % 5 AS INTEGER) AS a, CAST(l_linenumber % 3 AS INTEGER) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query(
    f"""WITH {_ENTRIES}, u AS (SELECT doc_id, a, n, min(chunk_id) AS chunk_id FROM i GROUP BY doc_id, a, n)
SELECT doc_id, chunk_id, array_to_string(range(a, a + n + 1), ',') AS pages, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, chunk_id) AS INTEGER) AS entry_no FROM u"""
)
def distinct_entries(spark, sf_dir):
    return chunk.distinct_entries(line_entries(spark, sf_dir)).select("doc_id", "chunk_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "entry_no")


@query(
    f"""WITH {_ENTRIES}, u AS (SELECT DISTINCT doc_id, unnest(range(a, a + n + 1)) AS page FROM i)
SELECT doc_id, string_agg(page, ',' ORDER BY page) AS all_pages, CAST(count(*) AS INTEGER) AS total_pages FROM u GROUP BY doc_id"""
)
def all_pages(spark, sf_dir):
    return chunk.all_pages(line_entries(spark, sf_dir)).select("doc_id", F.array_join(F.col("all_pages").cast("array<string>"), ",").alias("all_pages"), "total_pages")


@query(
    f"""WITH {PARTIAL} SELECT doc_id, round(coalesce(avg(CASE WHEN dob <> '' THEN 1.0 ELSE 0.5 END) FILTER (full_name <> ''), 0), 2) AS extraction_confidence FROM r GROUP BY doc_id"""
)
def extraction_confidence(spark, sf_dir):
    rows = partial_records(spark, sf_dir).withColumns({"success": F.col("full_name") != "", "overall": F.when(F.col("dob") != "", 1.0).otherwise(0.5)})
    return consolidate.extraction_confidence(rows)


@query(f"WITH {PARTIAL} SELECT doc_id, pos, round(least(1.0, 0.7 * ((full_name <> '')::INT + (dob <> '')::INT + (phone <> '')::INT) / 3 + 0.3 * (pos % 10) / 10), 6) AS confidence FROM r")
def person_confidence(spark, sf_dir):
    rows = partial_records(spark, sf_dir)
    filled = sum(((F.col(c) != "").cast("int") for c in ("full_name", "dob", "phone")), F.lit(0))
    return rows.select("doc_id", "pos", F.round(resolve.patient_confidence(filled, 3, F.col("pos") % 10 / 10), 6).alias("confidence"))


@query(
    """WITH s AS (SELECT user_id AS doc_id, list({'t': event_type, 'c': value} ORDER BY event_id) AS l FROM events GROUP BY user_id)
SELECT doc_id, w.t AS text, w.c AS confidence FROM (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN length(x.t) > length(a.t) OR x.c > a.c THEN x ELSE a END) AS w FROM s)"""
)
def better_reading(spark, sf_dir):
    """Events of a user as readings of one page, in order: the one left by the fold."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("event_id", F.col("event_type").alias("text"), F.col("value").alias("confidence")))).alias("l"))
    readings = F.transform("l", lambda r: F.struct(r["text"].alias("text"), r["confidence"].alias("confidence")))
    return rows.select("doc_id", compare.better_reading(readings).alias("w")).select("doc_id", "w.*")


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN '  ' ELSE '' END AS content, event_id % 3 = 0 AS has_content FROM events"""
)
def reply_content(spark, sf_dir):
    """Replies with text, with blanks, and with no choice at all."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 3
    made = F.when(n == 0, F.concat(F.lit('{"choices": [{"message": {"content": "'), F.col("event_type"), F.lit('"}}]}'))).when(n == 1, F.lit('{"choices": [{"message": {"content": "  "}}]}')).otherwise(F.lit('{"choices": []}'))
    reply = e.select("event_id", F.from_json(made, "choices array<struct<message:struct<content:string>>>").alias("r"))
    return reply.select("event_id", models.content(F.col("r")).alias("content"), models.has_content(F.col("r")).alias("has_content"))


@query("SELECT p_partkey, (p_size + p_partkey) / 2 AS center_x, (p_size * 2 + p_partkey * 3) / 2 AS center_y, CAST(p_partkey - p_size AS BIGINT) AS width, CAST(p_partkey * 3 - p_size * 2 AS BIGINT) AS height FROM part")
def cell_boxes(spark, sf_dir):
    x, y = F.col("p_size").cast("long"), F.col("p_partkey").cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", layout.box(x, x * 2, y, y * 3).alias("b")).select("p_partkey", "b.*")


@query(
    """WITH h AS (SELECT conv_id, turn, role, text, turn % 2 = 0 AS has FROM conversations)
SELECT conv_id, turn, md5(concat_ws(chr(10), nullif(text, ''), CASE WHEN has THEN chr(10) || '--- TABLE ' || turn || ' ---' || chr(10) || '| ' || role || ' | x |' || chr(10) || '| --- | --- |' || chr(10) || '| 7 |  |'
  || chr(10) || chr(10) || '--- STRUCTURED DATA ---' || chr(10) || role || ' | x' || chr(10) || '7' END)) AS text_md5 FROM h"""
)
def hybrid_text(spark, sf_dir):
    """Every other turn's text has a table of a full and a short row under it."""
    turns = table(spark, sf_dir, "conversations")
    grid = F.array(F.array(F.col("role"), F.lit("x")), F.array(F.lit("7")))
    tables = F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.col("turn").alias("table_id"), grid.alias("grid")))).otherwise(F.array().cast("array<struct<table_id:bigint,grid:array<array<string>>>>"))
    return turns.select("conv_id", "turn", F.md5(layout.hybrid_text(F.col("text"), tables)).alias("text_md5"))
