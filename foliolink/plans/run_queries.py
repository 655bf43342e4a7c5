"""Registered queries of whole runs: chunked model runs, routed extraction, runs over algorithms."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunk, models
from ..operators.statistics import RunningStatistics
from . import algorithms, chunked, files, records
from .field_queries import BORN, CAST
from .queries import _SQL, query, table, turn_pages

# ---- a model's run over chunks -----------------------------------------------------------

#: Every page text is this long, so that a chunk has three pages and moves on by two.
PAGE_CHARS = 90


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pages of an order that name one of four people; some pages make the model fail, every fifth part's names nobody."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("line")).agg(F.min("l_partkey").alias("k"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("k") % 4 + 1).cast("int"))
    trouble = F.when(F.col("k") % 13 == 0, "#429# ").when(F.col("k") % 17 == 0, "#000# ").otherwise("")
    filled = F.concat(F.lit("Patient Name: "), pick(CAST), F.lit("\nDOB: "), pick(BORN), F.lit("\n"), trouble)
    text = F.rpad(F.when(F.col("k") % 5 == 0, trouble).otherwise(filled), PAGE_CHARS, "7")
    w = F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    return lines.withColumn("page_number", w).select("doc_id", (F.col("page_number") - 1).alias("pos"), "page_number", text.alias("text"), F.lit(0.9).alias("confidence"))


class TroubledIdentifier(models.OfflineIdentifier):
    """Fails on pages that say so, each in its way."""

    def call(self, prompt: str) -> str:
        if "#429#" in prompt:
            raise models.ModelError.of_status(429)
        return "I can't tell." if "#000#" in prompt else super().call(prompt)


def three_page_chunks(spark: SparkSession) -> chunk.ChunkConfig:
    tokens = spark.range(1).select(X.estimate_tokens(F.lit("7" * PAGE_CHARS))).first()[0]
    return chunk.ChunkConfig(limit=int(3 * tokens / 0.8) + 2, usable=0.8, overlap=0.1)


_CHUNKED = f"""l AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, min(l_partkey) AS k FROM lineitem GROUP BY 1, 2),
p AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS page, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
m AS (SELECT *, unnest(CASE WHEN n <= 3 THEN [0] ELSE range(0, (n - 2) // 2 + 1) END) AS chunk_id FROM p),
c AS (SELECT doc_id, chunk_id, k, page FROM m WHERE n <= 3 OR page - 1 BETWEEN 2 * chunk_id AND 2 * chunk_id + 2),
f AS (
  SELECT doc_id, chunk_id, count(*) AS n_pages, array_to_string(list(page ORDER BY page), ',') AS pages,
    CASE WHEN bool_or(k % 13 = 0) THEN 'rate' WHEN bool_or(k % 17 = 0) THEN 'shape' END AS error FROM c GROUP BY doc_id, chunk_id),
g AS (SELECT c.doc_id, c.chunk_id, page, {_SQL(CAST)}[k % 4 + 1] AS name FROM c JOIN f ON f.doc_id = c.doc_id AND f.chunk_id = c.chunk_id WHERE error IS NULL AND k % 5 <> 0),
o AS (SELECT doc_id, name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(chunk_id * 1000 + page)) AS INTEGER) AS merged_no FROM g GROUP BY doc_id, name),
u AS (SELECT DISTINCT g.doc_id, merged_no, g.name, page FROM g JOIN o ON o.doc_id = g.doc_id AND o.name = g.name),
b AS (SELECT *, CASE WHEN page - lag(page) OVER (PARTITION BY doc_id, merged_no ORDER BY page) <= 2 THEN 0 ELSE 1 END AS begins FROM u),
s AS (
  SELECT doc_id, merged_no, any_value(name) AS full_name, array_to_string(list(page ORDER BY page), ',') AS all_pages, CAST(count(*) AS INTEGER) AS total_pages, CAST(sum(begins) AS BIGINT) AS total_entries
  FROM b GROUP BY doc_id, merged_no)"""


def _run(spark, sf_dir):
    return chunked.identify_in_chunks(chunk_pages(spark, sf_dir), TroubledIdentifier, three_page_chunks(spark))


@query(f"WITH {_CHUNKED} SELECT * FROM f")
def chunked_run_chunks(spark, sf_dir):
    """Each chunk with what became of it: some calls are refused, some replies have no structure."""
    return _run(spark, sf_dir)["chunks"].select("doc_id", "chunk_id", "n_pages", F.array_join(F.col("page_numbers").cast("array<string>"), ",").alias("pages"), "error")


@query(f"WITH {_CHUNKED} SELECT doc_id, merged_no, full_name, all_pages, total_pages, total_entries FROM s")
def chunked_run_persons(spark, sf_dir):
    found = _run(spark, sf_dir)["persons"]
    return found.select("doc_id", "merged_no", "full_name", F.array_join(F.col("all_pages").cast("array<string>"), ",").alias("all_pages"), "total_pages", "total_entries")


@query(
    f"""WITH {_CHUNKED}, a AS (SELECT doc_id, count(*) AS total_patients, CAST(sum(total_entries) AS BIGINT) AS total_entries FROM s GROUP BY doc_id),
d AS (SELECT doc_id, count(*) AS total_pages FROM p GROUP BY doc_id), v AS (SELECT doc_id, count(DISTINCT page) AS assigned FROM u GROUP BY doc_id),
w AS (SELECT doc_id, count(*) AS total_chunks, count(*) FILTER (error IS NULL) AS successful_chunks, coalesce(string_agg(chunk_id, ',' ORDER BY chunk_id) FILTER (error IS NOT NULL), '') AS failed_chunks FROM f GROUP BY doc_id)
SELECT d.doc_id, total_pages, coalesce(total_patients, 0) AS total_patients, coalesce(total_entries, 0) AS total_entries, coalesce(assigned, 0) AS assigned_pages, total_pages - coalesce(assigned, 0) AS unassigned_pages,
  CASE WHEN total_patients IS NULL THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS average_confidence, total_chunks > 1 AS processed_in_chunks, total_chunks, successful_chunks, failed_chunks
FROM d JOIN w ON w.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN v ON v.doc_id = d.doc_id"""
)
def chunked_run_summary(spark, sf_dir):
    """Documents whose chunks all fail are there with zeros."""
    found = _run(spark, sf_dir)["summary"].drop("seconds", "estimated_tokens")
    return found.withColumns({"average_confidence": F.round("average_confidence", 6), "failed_chunks": F.array_join(F.col("failed_chunks").cast("array<string>"), ",")})


# ---- text by both methods ----------------------------------------------------------------

#: A document with less embedded text than this is read from its images.
MIN_TEXT = 300


def read_turns(pages: DataFrame) -> DataFrame:
    """A stand-in for text recognition: what it reads follows from the page alone; every third page fails, every seventh is left out."""
    ok = F.col("pos") % 3 != 0
    seen = F.concat(F.lit("read "), F.col("role"), F.lit(" "), F.col("pos"))
    return pages.where("pos % 7 <> 6").select("doc_id", "page_number", F.when(ok, seen).otherwise("").alias("text"), F.when(ok, 0.75).otherwise(0.0).alias("confidence"), ok.alias("success"), F.lit(0.5).alias("processing_time"))


_TURNS = r"""t AS (
  SELECT conv_id AS doc_id, turn AS pos, coalesce(text, '') AS text, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) AS bare,
    turn % 3 <> 0 AND turn % 7 <> 6 AS ok, 'read ' || role || ' ' || turn AS seen, CASE WHEN turn % 7 <> 6 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS took FROM conversations),
d AS (SELECT doc_id, CASE WHEN count(*) FILTER (bare <> '') > 0 AND coalesce(sum(length(bare)) FILTER (bare <> ''), 0) >= {least} THEN 'scanned' ELSE 'ocr' END AS method FROM t GROUP BY doc_id),
s AS (SELECT doc_id, 'scanned' AS method, count(*) AS total_pages, count(*) AS successful_pages, CAST(sum(length(text)) AS BIGINT) AS total_characters, 1.0::DOUBLE AS overall_confidence, 0.001::DOUBLE * count(*) AS processing_time FROM t GROUP BY doc_id),
o AS (
  SELECT doc_id, 'ocr' AS method, count(*) AS total_pages, count(*) FILTER (ok) AS successful_pages, CAST(coalesce(sum(length(seen)) FILTER (ok), 0) AS BIGINT) AS total_characters,
    CASE WHEN count(*) FILTER (ok) > 0 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS overall_confidence, sum(took) AS processing_time FROM t GROUP BY doc_id),
b AS (SELECT * FROM s UNION ALL SELECT * FROM o)""".replace("{least}", str(MIN_TEXT))


def timed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pages(spark, sf_dir).withColumn("processing_time", F.lit(0.001))


@query(
    f"""WITH {_TURNS}, r AS (SELECT b.*, CASE WHEN processing_time > 0 THEN total_characters / processing_time ELSE 0 END AS rate FROM b JOIN d ON d.doc_id = b.doc_id AND d.method = b.method)
SELECT doc_id, method, total_pages, successful_pages, total_characters, overall_confidence, total_characters > 0 AS success, round(processing_time, 6) AS processing_time,
  CASE WHEN rate > 1000 THEN 'high' WHEN rate > 500 THEN 'medium' ELSE 'low' END AS efficiency FROM r"""
)
def routed_extraction(spark, sf_dir):
    """Conversations as documents: embedded text where there is enough, else read pages, of which some fail and some are missing."""
    found = files.process(timed_turns(spark, sf_dir), read_turns, min_text=MIN_TEXT)["documents"]
    return found.select("doc_id", "method", "total_pages", "successful_pages", "total_characters", "overall_confidence", "success", F.round("processing_time", 6).alias("processing_time"), "efficiency")


@query(
    f"""WITH {_TURNS}, k AS (SELECT * FROM b WHERE total_characters > 0),
m AS (
  SELECT doc_id, count(*) AS n_methods, arg_min(method, processing_time) AS fastest, min(processing_time) AS fastest_time,
    CASE WHEN max(total_characters) FILTER (method = 'ocr') >= max(total_characters) FILTER (method = 'scanned') THEN 'ocr' ELSE 'scanned' END AS most_characters, max(total_characters) AS characters
  FROM k GROUP BY doc_id HAVING count(*) = 2),
w AS (SELECT doc_id, bool_or(method = 'scanned') AS has_scanned, bool_or(method = 'ocr') AS has_ocr FROM k GROUP BY doc_id),
u AS (
  SELECT d.doc_id, d.method AS analysed, coalesce(CASE WHEN d.method = 'scanned' THEN has_scanned ELSE has_ocr END, false) AS agreed, coalesce(has_scanned, false) AS hs, coalesce(has_ocr, false) AS ho FROM d LEFT JOIN w ON w.doc_id = d.doc_id)
SELECT u.doc_id, analysed, CASE WHEN agreed THEN analysed WHEN hs THEN 'scanned' WHEN ho THEN 'ocr' ELSE 'none' END AS method,
  CAST(CASE WHEN agreed THEN CASE analysed WHEN 'scanned' THEN 0.9 ELSE 0.8 END WHEN hs THEN 0.8 WHEN ho THEN 0.6 ELSE 0.0 END AS DOUBLE) AS confidence,
  CASE WHEN hs AND ho THEN CASE WHEN agreed AND analysed = 'ocr' THEN 'scanned' ELSE 'ocr' END ELSE '' END AS alternatives, n_methods, fastest, round(fastest_time, 6) AS fastest_time, most_characters, characters
FROM u LEFT JOIN m ON m.doc_id = u.doc_id"""
)
def both_methods(spark, sf_dir):
    found = files.both_methods(timed_turns(spark, sf_dir), read_turns, MIN_TEXT)
    return found.withColumns({"confidence": F.col("confidence").cast("double"), "alternatives": F.array_join("alternatives", ","), "fastest_time": F.round("fastest_time", 6)})


@query(
    f"""WITH {_TURNS}, r AS (SELECT b.*, total_characters > 0 AS success FROM b)
SELECT count(*) AS total_documents, count(*) FILTER (success) AS successful_extractions, count(*) FILTER (NOT success) AS failed_extractions, round(sum(processing_time), 4) AS total_processing_time,
  round(count(*) FILTER (success) / count(*) * 100, 6) AS success_rate FROM r"""
)
def running_statistics(spark, sf_dir):
    """Totals over two runs, one for each method, observed while their results are written."""
    totals = RunningStatistics()
    for method in files.METHODS:
        made = files.process(timed_turns(spark, sf_dir), read_turns, method, MIN_TEXT)["documents"]
        totals.follow(made, lambda df: df.write.format("noop").mode("overwrite").save())
    t = totals.get()
    row = (t["total_documents"], t["successful_extractions"], t["failed_extractions"], round(t["total_processing_time"], 4), round(t["success_rate"], 6))
    return spark.createDataFrame([row], "total_documents long, successful_extractions long, failed_extractions long, total_processing_time double, success_rate double")


# ---- algorithms side by side -------------------------------------------------------------


class Unavailable:
    """An algorithm whose model can't be loaded."""

    name = "unavailable"

    def identify(self, pages: DataFrame) -> DataFrame:
        raise ConnectionError("no such model")


def _compared(spark, sf_dir):
    pages = chunk_pages(spark, sf_dir).withColumn("success", F.lit(True))
    model = algorithms.ChunkedModel("offline", models.OfflineIdentifier, three_page_chunks(spark))
    return algorithms.comparison(pages, [algorithms.RuleMatcher(), Unavailable(), model])


_COMPARED = f"""l AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, min(l_partkey) AS k FROM lineitem GROUP BY 1, 2),
p AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS page FROM l),
n AS (SELECT doc_id, page, k % 4 AS who FROM p WHERE k % 5 <> 0),
g AS (SELECT *, page - lag(page) OVER (PARTITION BY doc_id, who ORDER BY page) AS step FROM n),
r AS (SELECT doc_id, who, count(*) AS pages, count(*) FILTER (step IS NULL OR step > 1) AS runs, count(*) FILTER (step IS NULL OR step > 2) AS joined FROM g GROUP BY doc_id, who),
a AS (
  SELECT doc_id, 'rule_matcher' AS algorithm, count(*) AS total_patients, CAST(sum(runs) AS BIGINT) AS total_entries, CAST(sum(pages) AS BIGINT) AS assigned_pages, avg(least(1.0, 0.9 + least(0.1, (runs - 1) * 0.05))) AS average_confidence FROM r GROUP BY doc_id
  UNION ALL SELECT doc_id, 'offline', count(*), CAST(sum(joined) AS BIGINT), CAST(sum(pages) AS BIGINT), 0.9 FROM r GROUP BY doc_id),
w AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id), v AS (SELECT unnest(['rule_matcher', 'offline']) AS algorithm),
f AS (
  SELECT w.doc_id, v.algorithm, coalesce(total_patients, 0) AS total_patients, coalesce(total_entries, 0) AS total_entries, coalesce(assigned_pages, 0) AS assigned_pages, n - coalesce(assigned_pages, 0) AS unassigned_pages,
    coalesce(average_confidence, 0)::DOUBLE AS average_confidence
  FROM w CROSS JOIN v LEFT JOIN a ON a.doc_id = w.doc_id AND a.algorithm = v.algorithm)"""


@query(f"WITH {_COMPARED} SELECT doc_id, algorithm, total_patients, total_entries, assigned_pages, unassigned_pages, round(average_confidence, 6) AS average_confidence FROM f")
def algorithm_results(spark, sf_dir):
    """The rule matcher and a chunked model on the same documents; a third algorithm fails and is left out."""
    return _compared(spark, sf_dir)["results"].drop("processing_time").withColumn("average_confidence", F.round("average_confidence", 6))


@query(
    f"""WITH {_COMPARED} SELECT doc_id, count(*) AS n_algorithms, avg(total_patients) AS average_patients, avg(total_entries) AS average_entries, round(avg(average_confidence), 6) AS average_confidence,
min(total_patients) AS consensus_patients, 100.0::DOUBLE AS agreement_percentage, min(total_patients) AS min_patients, max(total_patients) AS max_patients FROM f GROUP BY doc_id"""
)
def algorithm_comparison(spark, sf_dir):
    """Both find the same persons, so they agree on their number everywhere."""
    return _compared(spark, sf_dir)["analysis"].drop("average_processing_time", "processing_time_range").withColumn("average_confidence", F.round("average_confidence", 6))


# ---- whole records -----------------------------------------------------------------------


class LabelModel(models.OfflineModel):
    """Reads insurance and an item beside a person; some pages make it fail."""

    def call(self, prompt: str) -> str:
        if "#429#" in prompt:
            raise models.ModelError.of_status(429)
        record = json.loads(super().call(prompt).strip("`").removeprefix("json"))
        plan, item = re.search(r"Insurance: (\w+)", prompt), re.search(r"Item: (\w+) x (\d+)", prompt)
        record["insurance"] = {"primary_insurance": plan[1]} if plan else {}
        record["dme"]["items"] = [{"item_name": item[1], "item_quantity": item[2]}] if item else []
        return json.dumps(record)


def record_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pages with some of a record's parts; every seventh part's page is blank."""
    k = F.col("k")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("pos")).agg(F.min("l_partkey").alias("k"))
    some = lambda n, *parts: F.when(k % n == 0, F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])).otherwise("")
    names = F.element_at(F.array(*map(F.lit, CAST)), (k % 4 + 1).cast("int"))
    text = F.concat(
        F.lit("Visit\n"), some(2, "Patient Name: ", names, "\n"), some(3, "DOB: 01/02/19", (k % 80 + 10).cast("string"), "\n"), some(5, "NPI: ", (1_000_000_000 + k % 3).cast("string"), "\n"),
        some(4, "Insurance: plan", (k % 9).cast("string"), "\n"), F.when(k % 3 == 1, F.concat(F.lit("Item: kit"), (k % 2).cast("string"), F.lit(" x "), (k % 4).cast("string"))).otherwise(""), some(13, "\n#429#"),
    )
    return lines.select("doc_id", "pos", (F.col("pos") + 1).alias("page_number"), F.when(k % 7 == 0, " \n").otherwise(text).alias("text"))


@query(
    f"""WITH p AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS pos, min(l_partkey) AS k FROM lineitem GROUP BY 1, 2),
g AS (
  SELECT *, CASE WHEN k % 2 = 0 THEN {_SQL(CAST)}[k % 4 + 1] ELSE '' END AS full_name, CASE WHEN k % 3 = 0 THEN '01/02/19' || (k % 80 + 10) ELSE '' END AS dob,
    CASE WHEN k % 5 = 0 THEN CAST(1000000000 + k % 3 AS VARCHAR) ELSE '' END AS npi, CASE WHEN k % 4 = 0 THEN 'plan' || k % 9 ELSE '' END AS plan,
    CASE WHEN k % 3 = 1 THEN 'kit' || k % 2 || ' x ' || k % 4 END AS item
  FROM p WHERE k % 7 <> 0 AND k % 13 <> 0),
b AS (SELECT doc_id, full_name, dob FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (full_name <> '')::INT + (dob <> '')::INT DESC, pos) = 1),
f AS (SELECT doc_id, coalesce(arg_min(npi, pos) FILTER (npi <> ''), '') AS npi, count(DISTINCT nullif(npi, '')) AS n_npis, coalesce(arg_min(plan, pos) FILTER (plan <> ''), '') AS plan FROM g GROUP BY doc_id),
i AS (SELECT doc_id, string_agg(item, ',' ORDER BY pos) AS items FROM (SELECT doc_id, item, min(pos) AS pos FROM g WHERE item IS NOT NULL GROUP BY doc_id, item) GROUP BY doc_id),
c AS (
  SELECT doc_id, count(*) AS total_pages, count(*) FILTER (k % 7 <> 0 AND k % 13 <> 0) AS successful_pages, count(*) FILTER (k % 7 = 0) AS blank_pages,
    coalesce(string_agg((pos + 1) || ':rate', ',' ORDER BY pos) FILTER (k % 7 <> 0 AND k % 13 = 0), '') AS failed_pages FROM p GROUP BY doc_id)
SELECT c.doc_id, coalesce(full_name, '') AS full_name, coalesce(dob, '') AS dob, coalesce(npi, '') AS npi, coalesce(n_npis, 0) AS n_npis, coalesce(plan, '') AS primary_insurance, coalesce(items, '') AS items,
  total_pages, successful_pages, blank_pages, failed_pages FROM c LEFT JOIN b ON b.doc_id = c.doc_id LEFT JOIN f ON f.doc_id = c.doc_id LEFT JOIN i ON i.doc_id = c.doc_id"""
)
def document_records(spark, sf_dir):
    """One whole record per order; orders whose pages all fail or are blank are there, empty."""
    found = records.document_records(record_pages(spark, sf_dir), LabelModel)["documents"]
    items = F.array_join(F.transform("items", lambda i: F.concat(i["item_name"], F.lit(" x "), i["item_quantity"])), ",")
    failed = F.array_join(F.transform("failed_pages", lambda p: F.concat(p["page_number"], F.lit(":"), p["status"])), ",")
    return found.select(
        "doc_id", "patient.full_name", "patient.dob", "npi", "n_npis", F.col("insurance.primary_insurance").alias("primary_insurance"), items.alias("items"), "total_pages", "successful_pages", "blank_pages",
        failed.alias("failed_pages"),
    )
