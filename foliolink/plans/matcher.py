"""Whole runs: the rule matcher, chunked model runs, document extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..operators import chunk, extract, models, resolve, route
from ..schemas import require_pages
from . import records


def identify(pages: DataFrame, threshold: float = 0.8, need_dob: bool = True, confidence_scale: float = 1.0) -> dict[str, DataFrame]:
    """The rule matcher over many documents: ``pages`` (assigned), ``entries``, ``groups``, ``unassigned``, ``summary``.

    ``confidence_scale`` divides the reading confidence first; 100 turns percent into shares.
    Pages with what is read from them are kept in the shared folder, so that none is searched twice.
    """
    rows = require_pages(pages).withColumn("confidence", F.col("confidence") / confidence_scale)
    people = scratch.keep(extract.with_person(rows), "persons")
    assigned = resolve.islands(resolve.greedy_groups(people, threshold, need_dob))
    entries = resolve.entries(assigned)
    groups = resolve.group_confidence(entries)
    return {
        "pages": assigned,
        "entries": entries,
        "groups": groups,
        "unassigned": resolve.unassigned(people.select(*rows.columns), assigned),
        "summary": resolve.run_summary(people, groups),
    }


def chunk_prompts(pages: DataFrame, model_name: str) -> DataFrame:
    """One prompt per chunk of the documents' plans for a model."""
    config = chunk.ChunkConfig.of(model_name)
    plans = chunk.plan(chunk.document_sizes(pages), config)
    placed = chunk.members(pages, plans).withColumn("doc_id", F.struct("doc_id", "chunk_id"))
    return route.prompt_pages(placed).select("doc_id.doc_id", "doc_id.chunk_id", "prompt")


def extract_documents(pages: DataFrame, make: Callable[[], models.Model], simple: bool = False) -> DataFrame:
    """One whole record per document: a model call per non-blank page, parsed replies, consolidated parts (see :func:`records.document_records`)."""
    return records.document_records(pages, make, simple)["documents"]
