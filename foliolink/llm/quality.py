"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import statistics
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, release, split_words, store

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Seconds that a rule costs at least, so that noise doesn't order rules that cost nothing.
LEAST_COST = 1e-2


def word_chars(words: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(words, "")).cast("long")


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long")


def duplicate_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line; texts without equal lines need no look at words."""
    full = F.filter(lines, lambda line: line.rlike(WORD))
    return F.when(F.size(F.array_distinct(lines)) < F.size(lines), F.size(full) - F.size(F.array_distinct(full))).otherwise(0).cast("long")


def _windows(words: Column) -> Column:
    """Hashes of all 3-word windows, in order. ``words`` must be a plain column."""
    places = F.when(F.size(words) >= 3, F.sequence(F.lit(1), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(windows: Column) -> Column:
    """Words in windows found twice or more: equal hashes are neighbours once ``(hash, place)`` is sorted."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(ordered: Column) -> Column:
        moved = F.slice(ordered, 2, F.size(ordered))
        twins = F.filter(F.arrays_zip(ordered.alias("a"), moved.alias("b")), lambda x: x["a"]["h"] == x["b"]["h"])
        return F.sort_array(F.array_distinct(F.flatten(F.transform(twins, lambda x: F.array(x["a"]["i"], x["b"]["i"])))))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(
        _let(pairs, repeated),
        start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure_names(docs: DataFrame) -> dict[str, str]:
    """Each measure's column name beside the columns of ``docs``."""
    return {n: fresh(docs, n) for n in MEASURES}


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` (long; names made free).

    Words are runs of anything but ASCII white space; a null text has none and one line.
    Everything is counted within the row by built-in functions, over the whole text.
    """
    names = measure_names(docs)
    words, windows, twice, lines = (fresh(docs, f"{n}_here") for n in ("words", "windows", "twice", "lines"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.withColumn(words, split_words(text)).withColumn(windows, _windows(F.col(words))).withColumn(lines, F.split(text, "\n"))
    found = split.withColumn(twice, F.size(F.array_distinct(windows)) < F.size(windows))
    return found.select(
        *docs.columns,
        F.size(words).cast("long").alias(names["n_words"]),
        word_chars(F.col(words)).alias(names["word_chars"]),
        symbols(text).alias(names["n_symbols"]),
        duplicate_lines(F.col(lines)).alias(names["n_dup_lines"]),
        F.when(F.col(twice), _covered(F.col(windows))).otherwise(0).cast("long").alias(names["n_repeat_words"]),
        F.size(lines).cast("long").alias(names["n_lines"]),
    )


@dataclass(frozen=True)
class Rule:
    """A named condition that rejects a row; null counts as not rejected."""

    name: str
    rejects: Column


def default_rules(text_col: str = "text", names: dict[str, str] | None = None) -> list[Rule]:
    """Rules on words, symbols, letters and lines, loose enough that ordinary prose passes.

    They read the columns of :func:`measures`, under ``names`` (:func:`measure_names`) if
    those were made free; only letters and capitals read the text itself.
    """
    m = {n: F.col((names or {}).get(n, n)) for n in MEASURES}
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.greatest(m["n_words"], F.lit(1))
    return [
        Rule("word_length", (m["word_chars"] < 2 * n) | (m["word_chars"] > 15 * n)),
        Rule("symbols", m["n_symbols"] > F.lit(0.3) * n),
        Rule("letters", F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) < F.lit(0.5) * m["word_chars"]),
        Rule("duplicate_lines", m["n_dup_lines"] > F.lit(0.5) * m["n_lines"]),
        Rule("capitals", F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) > F.lit(0.6) * m["word_chars"]),
    ]


@dataclass(frozen=True)
class Cascade:
    """Rules in the order in which they run, with cost (seconds) and rejected share on the sample."""

    rules: tuple[Rule, ...]
    cost: dict[str, float]
    rejected: dict[str, float]

    def verdict(self) -> Column:
        """Name of the first rule that rejects, else null: later rules aren't evaluated."""
        found = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            found = F.when(rule.rejects, F.lit(rule.name)).otherwise(found)
        return found


def plan_cascade(measured: DataFrame, rules: list[Rule], copies: int = 16, runs: int = 3) -> Cascade:
    """Times each rule over a measured sample and orders the rules by rejections per second.

    A rule's cost is the median of ``runs`` timed jobs over ``copies`` copies of the sample,
    after one that isn't timed, less the same for no rule at all, so that start-up and the
    scan don't count. The sample only orders the rules; which rows they reject doesn't depend
    on it. On an empty sample the order is as given.
    """
    repeated = measured.withColumn(fresh(measured, "copy_here"), F.explode(F.sequence(F.lit(1), F.lit(copies))))
    cost, rejected = {}, {}

    def timed(condition: Column) -> tuple[float, float]:
        job, took = repeated.agg(F.count("*").alias("n"), F.count(F.when(condition, 1)).alias("hits")), []
        for _ in range(runs + 1):
            began = time.perf_counter()
            got = job.first()
            took.append(time.perf_counter() - began)
        return statistics.median(took[1:]), got["hits"] / max(got["n"], 1)

    idle, _ = timed(F.lit(False))
    for rule in rules:
        seconds, rejected[rule.name] = timed(rule.rejects)
        cost[rule.name] = max(seconds - idle, LEAST_COST)
    order = sorted(range(len(rules)), key=lambda k: (-rejected[rules[k].name] / cost[rules[k].name], k))
    return Cascade(tuple(rules[k] for k in order), cost, rejected)


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = 1000, **options) -> DataFrame:
    """``docs`` with the columns of :func:`measures` and ``rejected_by`` (names made free).

    ``rejected_by`` is the first rule of the cascade that rejects, else null. About
    ``sample_rows`` rows are drawn from ``docs`` itself, so that only they are measured for
    the plan. Rules may use any column of ``docs`` and the measures. A null text is the empty
    text. Repeated rows stay and agree. An empty table stays empty.
    """
    rules = rules if rules is not None else default_rules(text_col, measure_names(docs))
    part = min(1.0, sample_rows / max(docs.count(), 1))
    sample = store(docs.sample(part, seed=11), "rule_sample")
    measured = store(measures(sample, text_col), "rule_measures")
    cascade = plan_cascade(measured, rules, **options)
    release(sample)
    release(measured)
    done = measures(docs, text_col)
    return done.withColumn(fresh(done, "rejected_by"), cascade.verdict())
