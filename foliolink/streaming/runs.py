"""Page runs over streams of pages: an extension of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "last_page int, entry_no int"
OUTPUT = "doc_id {doc}, sig_name string, page_number int, entry_no int"


def page_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet pages as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def numbered_runs(pages: DataFrame) -> DataFrame:
    """Numbers the entries of each ``(doc_id, sig_name)`` as pages arrive: a page goes on with the last entry if it is the next one.

    Only the last page and the entry's number are kept per group, so state is small however
    long a document is. Pages of a trigger are taken by ``page_number``.
    """
    doc = dict(pages.dtypes)["doc_id"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, entry = state.get if state.exists else (None, 0)
        numbers = sorted(n for part in parts for n in part["page_number"])
        out = []
        for n in numbers:
            entry += 0 if last is not None and n == last + 1 else 1
            last = n
            out.append((*key, n, entry))
        state.update((last, entry))
        yield pd.DataFrame(out, columns=["doc_id", "sig_name", "page_number", "entry_no"])

    return pages.groupBy("doc_id", "sig_name").applyInPandasWithState(step, OUTPUT.format(doc=doc), STATE, "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and sums of ``value`` per user and session of events ``(ts, user_id, value)``, late rows dropped after ``late``."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
    )
