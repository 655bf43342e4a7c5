"""Language identification by Bayesian evidence fusion."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_spread, store
from .markup import text_of

BUCKETS = 1 << 16
#: Labels that a model takes, at most: there are fewer codes in ISO 639-1 and 639-2 together.
MOST_LANGUAGES = 1024
#: Standard errors by which a text's mean may be below the bound of the open-set test.
ALLOWANCE = 2.0
_GAP = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> np.ndarray:
    """Buckets of the letter trigrams of a text, with a blank between words."""
    letters = _GAP.sub(" ", (text or "").lower()).strip()
    if not letters:
        return np.zeros(0, np.uint32)
    c = np.frombuffer(f" {letters} ".encode("utf-32-le", "replace"), np.uint32)
    mixed = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)


@dataclass(frozen=True)
class TextModel:
    """Trigram log-likelihoods: a row per bucket, a column per language; ``bound`` of the open-set test: ``(lowest mean, spread of a trigram)``."""

    languages: tuple[str, ...]
    table: np.ndarray
    bound: tuple[float, float] | None = None

    def score(self, text: str | None, effective: int) -> tuple[np.ndarray, int]:
        """Log-likelihood per language, as if from ``effective`` trigrams at most (they aren't independent), and the number there are."""
        return self.judge(text, effective)[:2]

    def judge(self, text: str | None, effective: int) -> tuple[np.ndarray, int, bool]:
        """:meth:`score`, and the open-set test: whether the trigrams, each in its best language, are as likely as those of labelled texts. A text that mixes trained languages passes."""
        found = grams(text)
        if not len(found):
            return np.zeros(len(self.languages)), 0, True
        logs = self.table[found]
        lowest, spread = self.bound or (-np.inf, 0.0)
        fits = logs.max(1).mean(dtype=np.float64) >= lowest - ALLOWANCE * spread / np.sqrt(len(found))
        return logs.sum(0, dtype=np.float64) * (min(len(found), effective) / len(found)), len(found), bool(fits)


def _fit_bound(sample: DataFrame, languages: tuple[str, ...], counts: np.ndarray) -> tuple[float, float]:
    """The lowest mean log-likelihood a trigram of labelled texts, each scored without its own counts, and the spread of a trigram.

    A short text may be ``ALLOWANCE`` standard errors lower, and any a quarter of the way from
    the mean to a text of unseen trigrams only, so that a uniform sample doesn't shut out
    other texts. Labelled rows beyond the middle of that way are no examples, so garbage among
    them can't lower the bound further.
    """
    shared = sample.sparkSession.sparkContext.broadcast((counts, counts.sum(0)))

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted, sums = shared.value
        for part in parts:
            rows = []
            for label, text in zip(part["label"], part["text"]):
                found = grams(text)
                if not len(found):
                    continue
                own = languages.index(label)
                kinds, times = np.unique(found, return_counts=True)
                rest, total = counted[kinds].astype(np.float64), sums.copy()
                rest[:, own] -= times
                total[own] -= len(found)
                logs = np.log((rest + 0.5) / (total + 0.5 * BUCKETS)).max(1)
                mean = (logs * times).sum() / len(found)
                rows.append((len(found), mean, ((logs - mean) ** 2 * times).sum() / len(found)))
            yield pd.DataFrame(rows, columns=["n", "mean", "spread"])

    got = sample.select("label", "text").mapInPandas(measure, "n int, mean double, spread double").toPandas()  # at most a row per sampled row
    if not len(got):
        return -np.inf, 0.0
    spread = float(np.sqrt(np.average(got["spread"], weights=got["n"])))
    mean, unseen = np.average(got["mean"], weights=got["n"]), float(np.log(0.5 / (counts.sum(0).min() + 0.5 * BUCKETS)))
    eased = got["mean"] + ALLOWANCE * spread / np.sqrt(got["n"])
    return float(min(mean + (unseen - mean) / 4, *eased[eased >= (mean + unseen) / 2])) - 1e-3, spread  # less the table's rounding


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", max_rows: int = 20_000, max_languages: int | None = None) -> TextModel:
    """Counts trigrams per language over a bounded sample of labelled rows.

    About ``max_rows`` labelled rows at most are drawn by a hash of id and text, evenly over languages; rows
    with a null or blank label or a null text are no examples; without any example the only
    language is ``und``. Every label is a language, with a fixed number of buckets each (512 KB),
    so more than ``MOST_LANGUAGES`` labels, too many for codes of languages, are an error. ``max_languages``
    bounds them to the most frequent (ties by name); the rows of all
    other labels are then one more, ``und``, so that texts like them are identified as that. There is one bound of the open-set test.
    """
    labelled = docs.select(F.lower(F.trim(F.col(label_col))).alias("label"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where("label <> '' and text is not null")
    sizes = labelled.groupBy("label").count().orderBy(F.desc("count"), "label").limit((max_languages or MOST_LANGUAGES) + 1).collect()
    if not sizes:
        return TextModel(("und",), np.zeros((BUCKETS, 1), np.float32))
    if max_languages is None and len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{label_col} has more than {MOST_LANGUAGES} labels; set max_languages")
    if max_languages is not None and len(sizes) > max_languages:
        labelled = labelled.withColumn("label", F.when(F.col("label").isin(*[r["label"] for r in sizes[:-1]]), F.col("label")).otherwise(F.lit("und")))
        sizes = labelled.groupBy("label").count().orderBy("label").collect()
    languages = tuple(sorted(r["label"] for r in sizes))
    share = {r["label"]: min(1.0, max_rows / len(sizes) / r["count"]) for r in sizes}
    draw = F.pmod(F.xxhash64(F.lit(3), F.col("id"), F.col("text")), F.lit(1_000_000)) / 1e6
    part_of = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("label"))
    sample = labelled.where(F.col("label").isin(*languages)).where(draw < part_of)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(languages), BUCKETS), np.int64)
        for part in parts:
            for label, text in zip(part["label"], part["text"]):
                totals[languages.index(label)] += np.bincount(grams(text), minlength=BUCKETS)
        of, bucket = np.nonzero(totals)
        yield pd.DataFrame({"of": of, "bucket": bucket, "n": totals[of, bucket]})

    counts = sample.select("label", "text").mapInPandas(count, "of int, bucket int, n long").groupBy("of", "bucket").agg(F.sum("n").alias("n"))
    counted = np.zeros((BUCKETS, len(languages)), np.int32)
    got = counts.toPandas()  # at most BUCKETS rows a language
    counted[got["bucket"].to_numpy(int), got["of"].to_numpy(int)] = got["n"].to_numpy(int)
    table = counted + 0.5
    return TextModel(languages, np.log(table / table.sum(0)).astype(np.float32), _fit_bound(sample, languages, counted))


def identify(
    rows: DataFrame,
    model: TextModel,
    id_col: str,
    text_col: str,
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    markup: bool = False,
    effective: int = 150,
    smoothing: float = 20.0,
    min_confidence: float = 0.5,
) -> DataFrame:
    """One row per row of ``rows``: ``(id, lang, confidence, text_lang, n_grams, declared, suffix, host)``.

    The posterior of a language is proportional to P(text | language) * P(declared | language)
    * P(language | host). All but the text model come from grouped sums of the text's own
    posteriors over all rows: the declared language's confusion table; the prior of a host,
    smoothed with ``smoothing`` rows of its suffix's prior, which is smoothed the same way
    with the overall prior. A row's own part is taken out of its host's and suffix's sums, so a text is not
    counted twice. Missing evidence (null or blank declared language, suffix or host, text
    without letters) leaves the other evidence; a row without any is ``und``, and so is one
    whose best posterior is below ``min_confidence``. The posterior is among the trained
    languages; a text that fails the model's open-set test is in none of them, so its row is
    ``und`` with confidence 0 and no ``text_lang``, and it counts in no sum. Repeated rows and null ids give a row
    each; an empty table gives an empty table.
    """
    langs, n = model.languages, len(model.languages)
    blank = F.lit(None).cast("string")
    clean = lambda c: F.when(F.trim(c) != "", F.lower(F.trim(c)))
    shared = rows.sparkSession.sparkContext.broadcast((model.languages, model.table, model.bound))
    named = rows.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        (clean(F.regexp_extract(F.coalesce(declared, F.lit("")), r"^\s*([A-Za-z]+)", 1)) if declared is not None else blank).alias("declared"),
        (clean(suffix) if suffix is not None else blank).alias("suffix"),
        (clean(host) if host is not None else blank).alias("host"),
    )
    kept = [f.simpleString().split(":", 1) for f in named.schema if f.name != "text"]
    schema = ", ".join(f"{c} {kind}" for c, kind in kept) + ", n_grams int, fits boolean, score array<double>"

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = TextModel(*shared.value)
        for part in parts:
            got = [known.judge(text_of(t) if markup else t, effective) for t in part["text"]]
            yield part.drop(columns="text").assign(n_grams=[k for _, k, _ in got], fits=[fits for _, _, fits in got], score=[s for s, _, _ in got])

    scored = named.mapInPandas(read, schema)
    top = F.array_max("score")
    soft = F.transform("score", lambda s: F.exp(s - top))
    mass = F.aggregate(soft, F.lit(0.0), lambda a, x: a + x)
    seen = F.when((F.col("n_grams") > 0) & F.col("fits"), F.lit(1.0)).otherwise(F.lit(0.0))
    part = store(scored.withColumn("post", F.transform(soft, lambda x: x / mass * seen)), "text_scores")

    sums = lambda: F.array(*[F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)) for i in range(n)])
    overall = part.agg(*[F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)).alias(f"n{i}") for i in range(n)]).first()
    weight = sum(overall) or 1.0
    base = F.array(*[F.lit((overall[i] + 1.0) / (weight + n)) for i in range(n)])
    by_suffix = part.where("suffix is not null").groupBy("suffix").agg(sums().alias("s_sum"), F.count("*").alias("n"))
    by_host = part.where("host is not null").groupBy("host", F.coalesce("suffix", F.lit("")).alias("site")).agg(sums().alias("h_sum"), F.count("*").alias("n"))
    by_declared = part.where("declared is not null").groupBy("declared").agg(sums().alias("d_sum"), F.count("*").alias("n"))
    total_declared = part.where("declared is not null").agg(*[F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)).alias(f"n{i}") for i in range(n)], F.count_distinct("declared").alias("kinds")).first()

    def smooth(counts: Column, own: Column, prior: Column) -> Column:
        left = F.zip_with(counts, own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
        size = F.aggregate(left, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(left, prior, lambda c, p: (c + F.lit(smoothing) * p) / (size + F.lit(smoothing)))

    none = F.array(*[F.lit(0.0)] * n)
    joined = part.withColumn("row_key", F.xxhash64("id", "n_grams", "score"))
    for sums_of, keys in ((by_suffix, ["suffix"]), (by_host, ["host", "site"]), (by_declared, ["declared"])):
        if keys[-1] == "site":
            joined = joined.withColumn("site", F.coalesce("suffix", F.lit("")))
        sums_of = store(sums_of, "evidence")
        joined = join_spread(joined, sums_of.drop("n"), keys, ["row_key"], sums_of.select(*keys, "n"), "left")
    has_host, has_suffix, has_declared = F.col("h_sum").isNotNull(), F.col("s_sum").isNotNull(), F.col("d_sum").isNotNull()
    joined = joined.withColumn("suffix_prior", F.when(~has_suffix, base).otherwise(smooth(F.coalesce("s_sum", none), F.col("post"), base)))
    joined = joined.withColumn("prior", F.when(~has_host, F.col("suffix_prior")).otherwise(smooth(F.coalesce("h_sum", none), F.col("post"), F.col("suffix_prior"))))
    likely = F.array(*[(F.col("d_sum")[i] + 0.5) / F.lit(total_declared[i] + 0.5 * (total_declared["kinds"] + 1)) for i in range(n)])
    declared_part = F.when(~has_declared, none).otherwise(F.transform(likely, lambda x: F.log(x)))
    joined = joined.withColumn("logs", F.zip_with(F.zip_with("score", declared_part, lambda a, b: a + b), "prior", lambda a, p: a + F.log(p)))
    final = F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))
    joined = joined.withColumn("final", final).withColumn("confidence", F.lit(1.0) / F.aggregate("final", F.lit(0.0), lambda a, x: a + x))
    names = F.array(*[F.lit(x) for x in langs])
    best = F.element_at(names, F.array_position("logs", F.array_max("logs")).cast("int"))
    known = (F.col("n_grams") > 0) | has_declared | has_host | has_suffix
    text_best = F.when((F.col("n_grams") > 0) & F.col("fits"), F.element_at(names, F.array_position("score", F.array_max("score")).cast("int")))
    return joined.select(
        F.col("id").alias(id_col),
        F.when((F.col("confidence") >= min_confidence) & known & F.col("fits"), best).otherwise(F.lit("und")).alias("lang"),
        F.when(F.col("fits"), F.round("confidence", 6)).otherwise(F.lit(0.0)).alias("confidence"),
        text_best.alias("text_lang"),
        "n_grams",
        "declared",
        "suffix",
        "host",
    )


def page_languages(pages: DataFrame, model: TextModel, **options) -> DataFrame:
    """:func:`identify` for raw pages ``(page_id, url, html)``: declared language from the ``lang`` attribute of ``html``, host and suffix from the address."""
    address = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[^:/?#]*://([^/?#:]*)", 1))
    opening = F.substring_index(F.substr(F.col("html"), F.nullif(F.regexp_instr(F.col("html"), F.lit(r"(?i)<html\b")), F.lit(0))), ">", 1)  # scanned once, however broken
    declared = F.regexp_extract(F.coalesce(opening, F.lit("")), r"(?i)\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    suffix = F.regexp_extract(address, r"([^.]+)$", 1)
    return identify(pages, model, "page_id", "html", declared, suffix, address, markup=True, **options)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` in which a language can be told, with the declared one as evidence and the source as host.

    Rejected: rows without letters, rows whose best posterior is below ``min_confidence``, and
    rows that fail the open-set test.
    Rows with a null id stay, as nothing tells their results apart; rows that repeat an id
    go with it if one of them is rejected. Spark broadcasts the rejected ids where their table is small.
    """
    model = train(docs, text_col, lang_col, id_col)
    found = identify(docs, model, id_col, text_col, F.col(lang_col), None, F.col(source_col), **options)
    mark = fresh(docs, "unknown")
    bad = store(found.where((F.col("lang") == "und") | (F.col("n_grams") == 0)).select(F.col(id_col).alias(mark)).distinct(), "unknown")
    return docs.join(bad, docs[id_col] == bad[mark], "left_anti")
