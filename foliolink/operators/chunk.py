"""Overlapping chunks of pages for size-limited models, and the merge of their results."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text as X
from . import linkage

#: Context limits in tokens; any other model has DEFAULT_LIMIT.
CONTEXT_LIMITS = {
    "qwen_2_5_7b_instruct_patient": 32000,
    "gpt-oss-20b_patient": 128000,
    "qwen3_vl_8b_instruct_patient": 128000,
    "gemma_3_4b_it_patient": 70000,
    "mistral_7b_instruct_patient": 32000,
    "claude_3_5_sonnet": 200000,
    "gpt_4_turbo": 128000,
    "gpt_35_turbo": 16385,
}
DEFAULT_LIMIT = 32000
#: Usable part of the limit and overlap between chunks, by model.
CHUNK_SHARES = {
    "qwen_2_5_7b_instruct_patient": (0.75, 0.15),
    "gpt-oss-20b_patient": (0.8, 0.1),
    "qwen3_vl_8b_instruct_patient": (0.7, 0.2),
    "gemma_3_4b_it_patient": (0.85, 0.05),
    "mistral_7b_instruct_patient": (0.75, 0.15),
}
DEFAULT_SHARES = (0.8, 0.1)
#: Part of the limit beyond which a document is cut.
TRIGGER = 0.8


@dataclass(frozen=True)
class ChunkConfig:
    """How a model's documents are cut."""

    limit: int
    usable: float
    overlap: float

    @classmethod
    def of(cls, model: str) -> ChunkConfig:
        return cls(CONTEXT_LIMITS.get(model, DEFAULT_LIMIT), *CHUNK_SHARES.get(model, DEFAULT_SHARES))

    @property
    def tokens_per_chunk(self) -> int:
        return int(self.limit * self.usable)

    @property
    def trigger(self) -> int:
        return int(self.limit * TRIGGER)


def document_sizes(pages: DataFrame, text_col: str = "text", kind: str = "ocr_text") -> DataFrame:
    """Per document: ``total_pages, total_characters, estimated_tokens, average_tokens_per_page``."""
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"),
        F.sum(F.length(X.text(F.col(text_col)))).alias("total_characters"),
        F.sum(X.estimate_tokens(F.col(text_col), kind)).alias("estimated_tokens"),
        F.avg(X.estimate_tokens(F.col(text_col), kind)).alias("average_tokens_per_page"),
    )


def optimal_chunk_tokens(tokens: Column, limit: int, safety: float = 0.2) -> Column:
    """The document's tokens if they fit in the limit less its safety part, else that."""
    return F.least(tokens, F.lit(int(limit * (1 - safety))))


def pages_per_chunk(tokens: Column, n_pages: Column, max_tokens: Column | int) -> Column:
    """Pages of average size that fit, at least one; all pages where there are no tokens."""
    most = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    return F.when(tokens > 0, F.greatest(F.lit(1), F.floor(most / (tokens / n_pages)))).otherwise(F.greatest(n_pages, F.lit(1))).cast("long")


def plan(sizes: DataFrame, config: ChunkConfig) -> DataFrame:
    """Adds ``needs_chunking, pages_per_chunk, overlap_pages, step, n_chunks`` to documents ``(total_pages, estimated_tokens)``.

    Chunk k holds the pages from ``k * step``; a one-page chunk moves on by one page.
    """
    n, tokens = F.col("total_pages"), F.col("estimated_tokens")
    p = pages_per_chunk(tokens, n, config.tokens_per_chunk)
    overlap = F.greatest(F.lit(1), F.floor(F.col("pages_per_chunk") * F.lit(config.overlap)).cast("long"))
    more = F.ceil((n - F.col("pages_per_chunk")) / F.col("step")).cast("long")
    return (
        sizes.withColumn("needs_chunking", tokens > config.trigger)
        .withColumn("pages_per_chunk", F.when(F.col("needs_chunking"), p).otherwise(F.greatest(n, F.lit(1)).cast("long")))
        .withColumn("overlap_pages", overlap)
        .withColumn("step", F.greatest(F.lit(1).cast("long"), F.col("pages_per_chunk") - F.col("overlap_pages")))
        .withColumn("n_chunks", F.when(n <= F.col("pages_per_chunk"), F.lit(1).cast("long")).otherwise(more + 1))
    )


def members(pages: DataFrame, plans: DataFrame) -> DataFrame:
    """One row per page and chunk that holds it (``chunk_id`` from 0), by arithmetic on ``pos``: no range join."""
    i, s, p = F.col("pos"), F.col("step"), F.col("pages_per_chunk")
    first = F.greatest(F.lit(0), F.ceil((i - p + 1) / s)).cast("long")
    last = F.least(F.col("n_chunks") - 1, F.floor(i / s)).cast("long")
    sized = pages.join(plans.select("doc_id", "pages_per_chunk", "step", "n_chunks"), "doc_id")
    return sized.withColumn("chunk_id", F.explode(F.sequence(first, last))).drop("pages_per_chunk", "step", "n_chunks")


def chunk_list(plans: DataFrame, legacy: bool = False) -> DataFrame:
    """One row per chunk: ``doc_id, chunk_id, first_pos, n_pages``.

    ``legacy`` plans end with one chunk more, the last overlap once again, as documents that are cut
    at all were planned before; one-page chunks have no overlap to repeat.
    """
    n, p, s = F.col("total_pages"), F.col("pages_per_chunk"), F.col("step")
    tail = F.when(F.lit(legacy) & (n > p) & (p > 1), 1).otherwise(0)
    each = plans.withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1 + tail)))
    start = F.when(F.col("chunk_id") < F.col("n_chunks"), F.col("chunk_id") * s).otherwise(n - F.col("overlap_pages"))
    return each.withColumn("first_pos", start).select("doc_id", "chunk_id", "first_pos", F.least(p, n - F.col("first_pos")).alias("n_pages"))


def stitch(entries: DataFrame, keys: tuple[str, ...] = ("doc_id", "group_no"), gap: int = 2) -> DataFrame:
    """Joins entries (``first_page, last_page, confidence``) of which one begins at most ``gap`` pages after the furthest end so far.

    Entries go by first page. The confidence of a joined entry is folded from the left, each
    step the mean of what there is and the next.
    """
    w = Window.partitionBy(*keys).orderBy("first_page", "last_page")
    furthest = F.max("last_page").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("first_page") - furthest <= gap, 0).otherwise(1)
    numbered = entries.withColumn("_begins", begins).withColumn("session", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    ordered = F.sort_array(F.collect_list(F.struct("first_page", "last_page", "confidence")))
    made = numbered.groupBy(*keys, "session").agg(
        F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"), F.count("*").alias("n_entries"), ordered.alias("_parts")
    )
    rest = F.slice(F.col("_parts"), F.lit(2), F.size("_parts"))
    folded = F.aggregate(rest, F.col("_parts")[0]["confidence"], lambda a, x: (a + x["confidence"]) / 2)
    same = F.col("first_page") == F.col("last_page")
    text = F.when((F.col("n_entries") == 1) & same, F.col("first_page").cast("string")).otherwise(F.format_string("%d-%d", "first_page", "last_page"))
    return made.withColumns({"confidence": folded, "page_range": text}).drop("_parts")


#: Signatures of a document that are folded in one task, at most; beyond, the same numbers are found by joins.
FOLDED = 256


def merge_chunks(groups: DataFrame, strict: bool = False, folded: int = FOLDED) -> DataFrame:
    """Numbers the people of all chunks of a document: adds ``merged_no`` to ``(doc_id, chunk_id, person_no, full_name, dob)``.

    In order of chunk and person each takes the number of the first person before it with
    the same signature, else of the first that shares ``min(2, words - 1)`` words and has the
    same date or none on either side; else a new one. ``strict`` wants one common word at
    least. A null name or date is an empty one.

    Only distinct signatures (name and date) matter, in order of first appearance. Those of
    documents of up to ``folded`` are folded, many documents in a task; those of larger ones are
    settled in rounds of joins, in which no document is one task. Both give the same numbers.
    """
    signed = groups.withColumns({"_name": X.collapse(F.col("full_name")), "_date": X.text(X.chunk_dob(F.col("dob")))})
    seen = signed.groupBy("doc_id", "_name", "_date").agg(F.min(F.struct("chunk_id", "person_no")).alias("place"))
    seen = scratch.keep(seen.select("doc_id", F.col("_name").alias("name"), F.col("_date").alias("date"), "place"), "people")
    large = linkage.wide(seen.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > folded).select("doc_id"))
    if large.isEmpty():
        numbers = _folded(seen, strict)
    else:
        numbers = _folded(seen.join(large, "doc_id", "left_anti"), strict).unionByName(_joined(seen.join(large, "doc_id", "left_semi"), strict))
    told = numbers.select("doc_id", F.col("name").alias("_name"), F.col("date").alias("_date"), "merged_no")
    return signed.join(told, ["doc_id", "_name", "_date"]).select(*groups.columns, "merged_no")


def _folded(seen: DataFrame, strict: bool) -> DataFrame:
    """``doc_id, name, date, merged_no``: rows stream through sorted; a task holds one document's people at a time."""
    columns = ["doc_id", "name", "date", "merged_no"]

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: list[tuple[str, set]] = []
        now = object()
        for part in parts:
            out = []
            for key, name, date in zip(part["doc_id"], part["name"], part["date"]):
                if key != now:
                    now, known = key, []
                words = set(name.split())
                need = min(2, len(name.split()) - 1)
                need = max(1, need) if strict else need
                alike = (k for k, (d, w) in enumerate(known) if len(words & w) >= need and (not date or not d or date == d))
                at = next(alike, None)
                if at is None:
                    at = len(known)
                    known.append((date, words))
                out.append(at + 1)
            yield part[["doc_id", "name", "date"]].assign(merged_no=out)

    doc = dict(seen.dtypes)["doc_id"]
    ordered = seen.repartition("doc_id").sortWithinPartitions("doc_id", "place")
    return ordered.mapInPandas(fold, f"doc_id {doc}, name string, date string, merged_no int").select(*columns)


def _joined(seen: DataFrame, strict: bool) -> DataFrame:
    """What :func:`_folded` gives, in rounds.

    A person shows its words, its pairs of words and the empty set, and looks for the sets of as
    many words as it must share; so people meet by sets, and never in pairs. Of those that show a
    set only the first matters, the first of a date and the first undated one: running minima over
    the set's people in order. A person joins the first one who stays and shows a set that it looks
    for, once nobody who may stay comes before that one; it stays once nobody at all does.

    Rounds end when all is settled. Each is one shuffle of the sets of documents with unsettled
    people, and of what those found; what a round wrote goes when the next has read it.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.col("name"), " "), lambda w: w != "")))
    need = F.least(F.lit(2), F.size(F.filter(F.split(F.col("name"), " "), lambda w: w != "")) - 1)
    need = F.greatest(F.lit(1), need) if strict else F.greatest(F.lit(0), need)
    rest = lambda k: F.slice("words", k + 2, F.size("words"))
    pairs = F.flatten(F.transform("words", lambda w, k: F.transform(rest(k), lambda v: F.concat(F.lit("2 "), w, F.lit(" "), v))))
    by_size = (F.array(F.lit("0")), F.transform("words", lambda w: F.concat(F.lit("1 "), w)), pairs)
    # only sets of a size that somebody looks for
    wanted = sorted(r[0] for r in seen.select(need.alias("need")).distinct().collect())  # three at most
    shows = lambda n: F.transform(by_size[n], lambda x: F.struct(x.alias("words"), (F.col("need") == n).alias("looks")))
    sets = F.concat(*map(shows, wanted)) if wanted else None
    # OPEN people may stay; PENDING ones join somebody, but whom isn't known; the home of those who stay is themselves
    nodes = seen.select("doc_id", "name", "date", "place", words.alias("words"), need.alias("need"), F.lit("open").alias("state"))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("home", F.lit(None).cast("long"))
    state = scratch.keep(nodes.select("doc_id", "name", "date", "place", "words", "need", "node", "state", "home"), "nodes")
    settled: list[DataFrame] = []
    columns = state.columns
    while not state.where("state in ('open', 'pending')").isEmpty():
        shown = state.where("state <> 'joined'").select("doc_id", "node", "place", "date", "state", F.explode(sets).alias("s")).select("doc_id", "node", "place", "date", "state", "s.words", "s.looks")
        before = Window.partitionBy("doc_id", "words").orderBy("place", "node").rowsBetween(Window.unboundedPreceding, -1)
        of_date = Window.partitionBy("doc_id", "words", "date").orderBy("place", "node").rowsBetween(Window.unboundedPreceding, -1)
        me = F.struct("place", "node")

        def first(which: str) -> Column:
            is_ = F.when(F.col("state") == which, me)
            undated = F.min(F.when(F.col("date") == "", is_)).over(before)
            return F.when(F.col("date") == "", F.min(is_).over(before)).otherwise(F.least(undated, F.min(is_).over(of_date)))

        met = shown.withColumns({"waiting": first("open"), "stays": first("stays")})
        met = met.where("looks and state in ('open', 'pending') and (waiting is not null or stays is not null)")
        found = met.groupBy("node").agg(F.min("waiting").alias("waiting"), F.min("stays").alias("stays"))
        open_ = F.col("state").isin("open", "pending")
        sure = F.col("stays").isNotNull() & (F.col("waiting").isNull() | (F.col("stays") < F.col("waiting")))
        now = (
            F.when(~open_, F.col("state")).when(sure, "joined").when(F.col("stays").isNotNull(), "pending").when(F.col("waiting").isNotNull(), F.col("state")).otherwise("stays")
        )
        home = F.when(~open_, F.col("home")).when(sure, F.col("stays.node")).when(now == "stays", F.col("node"))
        told = state.join(found.hint("merge"), "node", "left").withColumns({"state": now, "home": home}).select(*columns)
        following = scratch.keep(told, "nodes")
        scratch.drop(state)
        # documents of which all people are settled leave
        left = following.where("state in ('open', 'pending')").select("doc_id").distinct().hint("merge")
        settled.append(scratch.keep(following.join(left, "doc_id", "left_anti").select("doc_id", "name", "date", "place", "node", "home"), "settled"))
        state = scratch.keep(following.join(left, "doc_id", "left_semi"), "nodes")
        scratch.drop(following)
    if not settled:
        return state.select("doc_id", "name", "date", F.lit(0).alias("merged_no"))
    people = reduce(DataFrame.unionByName, settled)
    numbers = linkage.numbered(people.where("node = home").select("doc_id", "place", "home"), ["doc_id"], ["place"], "merged_no").select("home", "merged_no")
    return people.join(numbers.hint("merge"), "home").select("doc_id", "name", "date", "merged_no")


def longest_values(merged: DataFrame, fields: list[str], keys: tuple[str, ...] = ("doc_id", "merged_no")) -> DataFrame:
    """Per person the longest value of each field, the earliest of equals."""
    return merged.groupBy(*keys).agg(*[longest_of(f).alias(f) for f in fields])


def longest_of(field: str) -> Column:
    """The aggregate of :func:`longest_values`."""
    return F.max_by(F.col(field), F.struct(F.length(X.text(F.col(field))), -F.col("chunk_id"), -F.col("person_no")))


def folded_confidence(merged: DataFrame, keys: tuple[str, ...] = ("doc_id", "merged_no")) -> DataFrame:
    """Per person the left-folded mean of the chunks' confidence."""
    return merged.groupBy(*keys).agg(folded_of().alias("confidence"))


def folded_of() -> Column:
    """The aggregate of :func:`folded_confidence`."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_id", "person_no", "confidence")))
    return X.once(ordered, lambda p: F.aggregate(F.slice(p, F.lit(2), F.size(p)), F.get(p, F.lit(0))["confidence"], lambda a, x: (a + x["confidence"]) / 2))


def distinct_entries(entries: DataFrame, keys: tuple[str, ...] = ("doc_id", "merged_no")) -> DataFrame:
    """Entries with equal page sets (``pages``) once, the earliest chunk's, numbered by first page."""
    w = Window.partitionBy(*keys, "_set").orderBy("chunk_id", "entry_no")
    one = entries.withColumn("_set", F.sort_array(F.array_distinct("pages"))).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return one.withColumn("entry_no", F.row_number().over(Window.partitionBy(*keys).orderBy(F.array_min("_set"), "chunk_id", "entry_no"))).drop("_set", "_k")


def all_pages(entries: DataFrame, keys: tuple[str, ...] = ("doc_id", "merged_no")) -> DataFrame:
    """Per person the sorted union of its entries' pages."""
    return entries.select(*keys, F.explode("pages").alias("page")).groupBy(*keys).agg(F.sort_array(F.collect_set("page")).alias("all_pages")).withColumn("total_pages", F.size("all_pages"))
