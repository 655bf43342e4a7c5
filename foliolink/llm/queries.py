"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_text, language, lines, mixing, negatives, periods, pieces, quality, simhash, toxicity, urls
from .common import split_words


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages; the text model learns from the labelled documents."""
    model = language.train(_table(spark, sf_dir, "documents"))
    return language.page_languages(_table(spark, sf_dir, "pages"), model)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts hold control strings; digests are read back from the output."""
    planted = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), planted.alias("text")
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_conversations(rows).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss_text", chat.read_loss(F.col("segments")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "state",
    )


#: The rules of the contract.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: A page with less markup than this is thin; a host with more than this percentage of thin pages is listed.
THIN_CHARS, THIN_PERCENT = 2000, 45


def listed_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs ``(url_key)`` of the thin pages of hosts on which thin pages are the rule, from the pages' markup."""
    seen = pages.select(urls.host_of(F.col("url")).alias("host"), urls.canonical(F.col("url")).alias("url_key"), (F.coalesce(F.length("html"), F.lit(0)) < THIN_CHARS).alias("thin"))
    hosts = seen.groupBy("host").agg(F.count("*").alias("n"), F.count(F.when(F.col("thin"), 1)).alias("k")).where(100 * F.col("k") > THIN_PERCENT * F.col("n"))
    return seen.where("thin and url_key is not null").join(hosts, "host", "left_semi").select("url_key").distinct()


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.judge(pages.select("page_id", "url"), listed_urls(pages), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ruled = quality.apply_rules(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return ruled.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(F.col("rejected_by").isNull()).alias("kept"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the test items that it contains."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.overlaps(docs, _table(spark, sf_dir, "benchmark"))
    per_doc = found.groupBy("doc_id").agg(
        F.array_sort(F.collect_list("item_id")).alias("items"), F.max(F.col("n_covered") / F.col("n_words")).alias("coverage")
    )
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages; ``n_repeated`` counts the tokens that runs of the host's suffix array cover."""
    return html_text.main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Ids and decoded text of all documents, as digests; ``model`` is the vocabulary file, by default the 32k one."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = pieces.load_vocabulary(model)
    done = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary), vocabulary)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def labelled_vectors(embeddings: DataFrame) -> DataFrame:
    """``id, label, vector`` in whole numbers; every seventh row's label moves on by one."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").alias("id"), moved.alias("label"), whole.alias("vector"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors."""
    return negatives.hard_negatives(labelled_vectors(_table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)


def repeating_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in which the words of every tenth document by hash come again with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def again(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))), " ")

    # The words are a variable of the outer transform, so that they are split once.
    made = F.get(F.transform(F.array(split_words(F.col("text"))), lambda w: F.when(F.size(w) > 0, again(w))), F.lit(0))
    text = F.when(h % 10 == 0, made).otherwise(F.col("text"))
    return docs.select("doc_id", F.explode(F.array(text)).alias("text"))  # a column of its own: Python functions can't take nested lambdas


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, of which every tenth is made periodic first."""
    found = periods.find_runs(repeating_texts(_table(spark, sf_dir, "documents")))
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    best = found.withColumn("_best", longest)
    length, start, period = F.col("_best.length"), -F.col("_best.start"), -F.col("_best.period")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(told, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_mix_sources,
        op3_language_id,
        op4_chat_format,
        op5_url_filter,
        op6_toxicity,
        op7_quality_rules,
        op8_decontaminate,
        op9_line_dedup,
        op10_html_text,
        op11_sentencepiece,
        op12_hard_negatives,
        op13_periodic_runs,
    )
}

#: White space and words of the contracts, for DuckDB.
_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_MARKS = r"<s>|</s>|\[SYS\]|\[/SYS\]|\[INST\]|\[/INST\]|\[ANS\]|\[ROLE\]|\[/ROLE\]|\[/TURN\]"

_CHAT = rf"""WITH r AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '{_MARKS}'))
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 ELSE 9 END AS n FROM r),
g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss, CAST(3 + sum(n) AS BIGINT) AS formatted_chars,
    string_agg(role[1], '' ORDER BY turn) AS way, arg_max(role, turn) AS last FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  regexp_full_match(way, 's?(ua)+') AS valid, CASE WHEN regexp_full_match(way, 's?(ua)*u?') THEN last ELSE 'error' END AS state FROM g"""

_URLS = rf"""WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_UPPER}) AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(length(html), 0) < {THIN_CHARS} AS thin FROM pages),
c AS (
  SELECT *, CASE WHEN host <> '' THEN CASE WHEN regexp_matches(host, '^(www|m)\.[^.]+\.') THEN regexp_replace(host, '^(www|m)\.', '') ELSE host END
    || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '') END AS k FROM u),
h AS (SELECT host FROM c GROUP BY host HAVING 100 * count(*) FILTER (thin) > {THIN_PERCENT} * count(*)),
l AS (SELECT DISTINCT k FROM c WHERE k IS NOT NULL AND thin AND host IN (SELECT host FROM h)),
r AS (SELECT unnest([{", ".join(f"'{r}'" for r in URL_RULES)}]) AS rule, unnest([{", ".join(f"'{v}'" for v in URL_RULES.values())}]) AS verdict),
f AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM c JOIN r ON (host = split_part(rule, '/', 1) OR suffix(host, '.' || split_part(rule, '/', 1))) AND prefix(path, rule[instr(rule, '/'):])
  GROUP BY page_id)
SELECT c.page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN k IN (SELECT k FROM l) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN f ON c.page_id = f.page_id"""

_QUALITY = rf"""WITH d AS (
  SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS f
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
k AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM k),
y AS (SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS n FROM x WHERE n > 1),
z AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_repeat_words FROM y GROUP BY doc_id),
m AS (
  SELECT d.doc_id, t, len(w) AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(f) - len(list_distinct(f)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(string_split(t, chr(10))) AS n_lines
  FROM d LEFT JOIN z ON d.doc_id = z.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_symbols > 0.3 * n_words OR n_dup_lines > 0.5 * n_lines
    OR length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) < 0.5 * word_chars OR length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) > 0.6 * word_chars) AS kept FROM b"""

_LINES = rf"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), {_UPPER}) AS key FROM l),
h AS (SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, holder IS NOT NULL AND holder <> doc_id AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""

_NEGATIVES = """WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), false)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other_id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)
QUALIFY rank <= 10"""

_PERIODS = rf"""WITH RECURSIVE k(n, c, i) AS (
  SELECT n, n, 0 FROM range(256) x(n) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM k WHERE i < 8),
t AS (SELECT list(c ORDER BY n) AS t FROM k WHERE i = 8),
d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM documents, t),
f AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS e FROM d),
s AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // e) + 1] END) ELSE w END AS w FROM f),
e AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM s),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
o AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS b FROM m),
c AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM o GROUP BY doc_id, q, b HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (
  SELECT 1 FROM c z WHERE z.doc_id = c.doc_id AND z.q < c.q AND z.start <= c.start AND z.start + z.length >= c.start + c.length)),
g AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
v AS (
  SELECT e.doc_id, sha256(coalesce(string_agg(word, ' ' ORDER BY e.i) FILTER (g.i IS NULL), '')) AS collapsed_sha256
  FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id),
b AS (
  SELECT doc_id, count(*) AS n_runs, max(struct_pack(l := length, s := -start, q := -q)) AS best,
    sha256(string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q)) AS runs_sha256 FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.l AS length, -best.q AS period, 1000 * best.l // -best.q AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN v ON d.doc_id = v.doc_id"""

#: The others rest on 64-bit hashes, trained weights or page structure, which SQL can't express.
ORACLES: dict[str, str] = {
    "op4_chat_format": _CHAT,
    "op5_url_filter": _URLS,
    "op7_quality_rules": _QUALITY,
    "op9_line_dedup": _LINES,
    "op12_hard_negatives": _NEGATIVES,
    "op13_periodic_runs": _PERIODS,
}
