"""A model's run over documents larger than its context: chunks, calls, merge, summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text as X
from ..operators import chunk, models, route


def identify_in_chunks(
    pages: DataFrame, make: Callable[[], models.Model], config: chunk.ChunkConfig | str, strict: bool = False, in_flight: int = 4, deadline: float | None = 60.0
) -> dict[str, DataFrame]:
    """Persons of documents by a model that sees a chunk of pages at a time.

    ``pages`` has ``doc_id, pos`` (from 0), ``page_number, text, confidence``; ``config`` is how the
    model's documents are cut, or its name. Returns

    * ``chunks``: a row per chunk with its pages, tokens, ``error`` (null if it succeeded) and seconds:
      a failed call, a reply without the expected parts or an empty prompt never ends the run;
    * ``persons``: those of the chunks that succeeded, merged by signature and common words over
      chunks, with the longest values, all pages, and entries that are joined over chunks' overlaps;
    * ``entries``: those entries;
    * ``summary``: a row per document, also of one whose chunks all failed (zeros): persons, entries,
      assigned and unassigned pages of the whole document, mean confidence, numbers of chunks, and which failed.

    Replies are written once to the shared folder, so that no call is made twice.
    """
    config = chunk.ChunkConfig.of(config) if isinstance(config, str) else config
    plans = scratch.keep(chunk.plan(chunk.document_sizes(pages), config), "plans")
    placed = chunk.members(pages, plans)
    tokens = F.sum(X.estimate_tokens(F.col("text"))).alias("estimated_tokens")
    asked = placed.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("n_pages"), F.sort_array(F.collect_list("page_number")).alias("page_numbers"), tokens, route.prompt().alias("prompt"))
    full = models.prompts(asked, models.PERSONS_PROMPT, "prompt")
    replies = models.parse_persons(models.run_model(full, make, in_flight=in_flight, deadline=deadline))
    kept = scratch.keep(replies.select("doc_id", "chunk_id", "n_pages", "page_numbers", "estimated_tokens", "error", "seconds", "persons"), "replies")

    chunks = kept.drop("persons")
    people = kept.select("doc_id", "chunk_id", F.posexplode("persons").alias("k", "p")).select(
        "doc_id", "chunk_id", (F.col("k") + 1).alias("person_no"), X.text(F.col("p.patient_info.full_name")).alias("full_name"), X.text(F.col("p.patient_info.dob")).alias("dob"),
        F.coalesce("p.entries", F.array().cast("array<struct<pages:array<int>,confidence:double>>")).alias("entries"), F.col("p.group_confidence").alias("told"),
    )
    sure = F.aggregate("entries", F.lit(0.0), lambda s, e: s + F.coalesce(e["confidence"], F.lit(0.0))) / F.greatest(F.size("entries"), F.lit(1))
    numbered = scratch.keep(chunk.merge_chunks(people.withColumn("confidence", F.coalesce("told", sure)), strict), "people")

    each = numbered.select("doc_id", "chunk_id", "merged_no", "person_no", F.posexplode("entries").alias("k", "e")).where("size(e.pages) > 0")
    runs = each.select("doc_id", "chunk_id", "merged_no", (F.col("person_no") * 1_000_000 + F.col("k")).alias("entry_no"), F.col("e.pages").alias("pages"), F.coalesce("e.confidence", F.lit(0.0)).alias("confidence"))
    keys = ("doc_id", "merged_no")
    once = chunk.distinct_entries(runs, keys)
    spans = once.select(*keys, F.array_min("pages").alias("first_page"), F.array_max("pages").alias("last_page"), "confidence")
    entries = chunk.stitch(spans, keys)
    found = numbered.groupBy(*keys).agg(*[chunk.longest_of(f).alias(f) for f in ("full_name", "dob")], chunk.folded_of().alias("confidence"))
    persons = found.join(chunk.all_pages(once, keys), list(keys), "left").join(entries.groupBy(*keys).agg(F.count("*").alias("total_entries")), list(keys), "left")
    persons = persons.withColumns({"total_pages": F.coalesce("total_pages", F.lit(0)), "total_entries": F.coalesce("total_entries", F.lit(0).cast("long"))})
    return {"chunks": chunks, "persons": persons, "entries": entries, "summary": _summary(pages, plans, chunks, persons)}


def _summary(pages: DataFrame, plans: DataFrame, chunks: DataFrame, persons: DataFrame) -> DataFrame:
    """One row per document; a page counts once however many persons have it, and only if the document has it."""
    seen = persons.select("doc_id", F.explode("all_pages").alias("page_number")).distinct()
    assigned = pages.select("doc_id", "page_number").join(seen, ["doc_id", "page_number"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("assigned_pages"))
    people = persons.groupBy("doc_id").agg(F.count("*").alias("total_patients"), F.sum("total_entries").alias("total_entries"), F.avg("confidence").alias("average_confidence"))
    ran = chunks.groupBy("doc_id").agg(
        F.count("*").alias("total_chunks"), F.count(F.when(F.col("error").isNull(), 1)).alias("successful_chunks"),
        F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.col("chunk_id")))).alias("failed_chunks"), F.sum("seconds").alias("seconds"),
    )
    zero = lambda c, kind="long": F.coalesce(F.col(c), F.lit(0).cast(kind)).alias(c)
    joined = plans.select("doc_id", "total_pages", "estimated_tokens").join(ran, "doc_id").join(people, "doc_id", "left").join(assigned, "doc_id", "left")
    return joined.select(
        "doc_id", "total_pages", zero("total_patients"), zero("total_entries"), zero("assigned_pages"), (F.col("total_pages") - zero("assigned_pages")).alias("unassigned_pages"),
        zero("average_confidence", "double"), (F.col("total_chunks") > 1).alias("processed_in_chunks"), "total_chunks", "successful_chunks", "failed_chunks", "seconds", "estimated_tokens",
    )


