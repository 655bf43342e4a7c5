"""Running totals over many runs, observed while the runs write their results."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class RunningStatistics:
    """Documents, successes, failures and seconds of all runs since the start or the last :meth:`reset`.

    Figures are metrics observed in the tasks of a run's own write, so no run is computed twice;
    only a row of sums per run reaches the driver. Several threads may add runs.
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._totals = self._zero()

    @staticmethod
    def _zero() -> dict[str, float]:
        return {"total_documents": 0, "successful_extractions": 0, "failed_extractions": 0, "total_processing_time": 0.0}

    def follow(self, results: DataFrame, write: Callable[[DataFrame], None]) -> dict[str, float]:
        """Runs ``write`` on ``results (success, processing_time)`` and adds what it saw; a run whose write fails adds nothing.

        ``write`` has to start one job that reads all rows. A null ``success`` counts as a failure. Returns the run's own figures.
        """
        seen = Observation()
        ok = F.coalesce(F.col("success"), F.lit(False))
        write(
            results.observe(
                seen, F.count(F.lit(1)).alias("total_documents"), F.count(F.when(ok, 1)).alias("successful_extractions"),
                F.count(F.when(~ok, 1)).alias("failed_extractions"), F.coalesce(F.sum("processing_time"), F.lit(0.0)).alias("total_processing_time"),
            )
        )
        figures = dict(seen.get)
        with self._lock:
            for name in self._totals:
                self._totals[name] += figures[name]
        return figures

    def get(self) -> dict[str, float]:
        """The totals, with ``success_rate`` in percent and ``average_processing_time``; both 0 before any document."""
        with self._lock:
            totals = dict(self._totals)
        n = totals["total_documents"]
        share = {"success_rate": totals["successful_extractions"] / n * 100 if n else 0.0, "average_processing_time": totals["total_processing_time"] / n if n else 0.0}
        return totals | share

    def reset(self) -> dict[str, float]:
        """Sets the totals to zero and returns what they were."""
        before = self.get()
        with self._lock:
            self._totals = self._zero()
        return before
