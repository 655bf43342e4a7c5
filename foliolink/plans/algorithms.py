"""Algorithms that tell persons apart, side by side on the same documents."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..operators import compare, models
from ..operators.chunk import ChunkConfig
from . import chunked, matcher

FIGURES = ("total_patients", "total_entries", "assigned_pages", "unassigned_pages", "average_confidence")


class Identifier(Protocol):
    """A name, and pages to one row per document with ``doc_id`` and :data:`FIGURES`."""

    name: str

    def identify(self, pages: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class RuleMatcher:
    """The rule matcher with its settings."""

    name: str = "rule_matcher"
    threshold: float = 0.8
    need_dob: bool = True
    confidence_scale: float = 1.0

    def identify(self, pages: DataFrame) -> DataFrame:
        return matcher.identify(pages, self.threshold, self.need_dob, self.confidence_scale)["summary"]


@dataclass(frozen=True)
class ChunkedModel:
    """A model that sees chunks of pages."""

    name: str
    make: Callable[[], models.Model]
    config: ChunkConfig | str = field(default="")
    deadline: float | None = 60.0

    def identify(self, pages: DataFrame) -> DataFrame:
        return chunked.identify_in_chunks(pages, self.make, self.config or self.name, deadline=self.deadline)["summary"]


REGISTRY: dict[str, Identifier] = {"rule_matcher": RuleMatcher()}


def register(identifier: Identifier) -> None:
    """Adds an algorithm under its name, in place of one that had it."""
    REGISTRY[identifier.name] = identifier


def chosen(names: list[str] | None = None) -> list[Identifier]:
    """Registered algorithms by name, all without names; an unknown name is an error that tells the known ones."""
    unknown = sorted(set(names or ()) - set(REGISTRY))
    if unknown:
        raise KeyError(f"unknown algorithms: {', '.join(unknown)}; known: {', '.join(sorted(REGISTRY))}")
    return [REGISTRY[n] for n in (names or sorted(REGISTRY))]


def run(pages: DataFrame, identifiers: list[Identifier]) -> dict[str, DataFrame]:
    """``results``: a row per algorithm and document; ``runs``: a row per algorithm with its seconds, documents and error.

    Each algorithm is a run of its own: one that can't be planned, fails, or lacks a column becomes a row with its ``error`` and the others go on.
    A document's ``processing_time`` is its share of the run's seconds. All read the same pages, which are made once and kept in the shared folder.
    """
    spark = pages.sparkSession
    results, runs = [], []
    pages = scratch.keep(pages, "pages")
    doc = dict(pages.dtypes)["doc_id"]
    for identifier in identifiers:
        began = time.perf_counter()
        try:
            found = scratch.keep(identifier.identify(pages).select("doc_id", *FIGURES), "algorithm")
            n, seconds = found.count(), time.perf_counter() - began
            results.append(found.withColumns({"algorithm": F.lit(identifier.name), "processing_time": F.lit(seconds / max(1, n))}))
            runs.append((identifier.name, True, None, seconds, n))
        except Exception as e:  # noqa: BLE001  a failed algorithm is a row
            runs.append((identifier.name, False, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500], time.perf_counter() - began, 0))
    every = spark.createDataFrame([], f"doc_id {doc}, total_patients long, total_entries long, assigned_pages long, unassigned_pages long, average_confidence double, algorithm string, processing_time double")
    for found in results:
        every = every.unionByName(found)
    return {"results": every, "runs": spark.createDataFrame(runs, "algorithm string, success boolean, error string, seconds double, n_documents long")}


def comparison(pages: DataFrame, identifiers: list[Identifier]) -> dict[str, DataFrame]:
    """:func:`run` and, over the algorithms that succeeded, ``analysis`` per document and the figures as a map ``algorithms`` for the JSON sink."""
    made = run(pages, identifiers)
    return made | {"analysis": compare.comparison(made["results"]), "algorithms": compare.algorithm_map(made["results"])}
