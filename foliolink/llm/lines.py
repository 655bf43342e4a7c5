"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, join_spread, new_path, release, store

KEY = ["h1", "h2"]
#: The white space stripped from a line.
_BLANKS = " \t\n\x0b\x0c\r"
#: Rows by which ids are split into batches, at most.
_CUT_ROWS = 10_000


def bare_line(line: Column) -> Column:
    """A line without white space at both ends."""
    return F.btrim(line, F.lit(_BLANKS))


def line_key(bare: Column) -> Column:
    """A bare line with A-Z lower-cased; Spark's own lower-casing is right, and faster, for ASCII alone."""
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Jobs within read buckets as partitions and trust the order of their files, so that a merge join neither shuffles nor sorts them."""
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class Runs:
    """Sorted runs of line hashes in levels: ``fanout`` runs of a level become one of the next.

    A run is a table with a row per line hash, bucketed and sorted by hash, one file a bucket,
    in the shared folder. A batch, laid out the same way, merge-anti-joins one run after the
    other: neither side is shuffled or sorted for it. ``add`` puts a batch's own hashes in
    level 0; a full level is compacted before the next batch reads it.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.tables: list[str] = []

    def lay_out(self, rows: DataFrame) -> DataFrame:
        """``rows`` as a bucketed, sorted table."""
        name = f"line_run_{uuid.uuid4().hex}"
        with _sorted_scans(self.spark):
            rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", new_path(self.spark, "run")).format("parquet").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` whose hash no run has."""
        for level in self.levels:
            for run in level:
                batch = batch.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return batch

    def compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                merged = functools.reduce(lambda a, b: a.join(b.hint("merge"), KEY, "full"), [run.select(*KEY) for run in level])
                self.levels[k + 1].append(self.lay_out(merged))
                self.levels[k] = []
                for run in level:
                    release(run)

    def add(self, run: DataFrame) -> None:
        self.levels[0].append(run)

    def close(self) -> None:
        """Forget all tables and delete what is left of them."""
        for level in self.levels:
            for run in level:
                release(run)
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _cuts(docs: DataFrame, id_col: str, batches: int) -> list:
    """Ids that cut the documents into ``batches`` of about equal size, from a bounded sample; any cuts give the same result."""
    part = min(1.0, _CUT_ROWS / 2 / max(docs.count(), 1))
    found = docs.select(id_col).where(F.col(id_col).isNotNull()).sample(part, seed=3).orderBy(id_col).limit(_CUT_ROWS).collect()
    return [found[k * len(found) // batches][0] for k in range(1, batches)] if found else []


def dropped_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, least_batches: int = 4, batch_rows: int = 50_000_000, fanout: int = 2
) -> DataFrame:
    """Lines to drop: ``(id, digest, dropped)``, with ``dropped`` the positions in the text that has that digest.

    Documents come in batches of ascending ids (of any type that has an order), about
    ``batch_rows`` each and at least ``least_batches``. In each batch the keys of at least
    ``min_chars`` code points are aggregated to one row each and merge-anti-joined with the
    runs of earlier batches; what is left is new and becomes a run. A line goes if an earlier
    batch has its key or if a smaller id of its own batch has it; all lines of the smallest
    document that holds a key stay. Rows with the same id are one document. A null id counts as larger
    than any other and null ids as one document. Keys are compared by 128 bits of hash.
    """
    spark = docs.sparkSession
    who = F.col(id_col)
    cuts = _cuts(docs, id_col, max(least_batches, -(-docs.count() // batch_rows)))
    batch = sum(((who > F.lit(cut)).cast("int") for cut in cuts), F.lit(0))
    lines = store(
        docs.select(who.alias("id"), F.xxhash64(F.col(text_col)).alias("digest"), F.coalesce(batch, F.lit(len(cuts))).alias("batch"), F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select("id", "digest", "batch", "pos", bare_line(F.col("line")).alias("bare"))
        .where(F.length("bare") >= min_chars)
        .select("id", "digest", "batch", "pos", line_key(F.col("bare")).alias("key"))
        .select("id", "digest", "batch", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key"), F.length("key")).alias("h2")),
        "lines",
    )
    runs, dropped = Runs(spark, fanout), []
    for k in range(len(cuts) + 1):
        runs.compact()
        mine = lines.where(F.col("batch") == k)
        keys = runs.lay_out(
            mine.groupBy(*KEY).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls"), F.count("*").alias("n"))
        )
        new = runs.lay_out(runs.unseen(keys))
        with _sorted_scans(spark):
            old = keys.join(new.select(*KEY).hint("merge"), KEY, "left_anti").withColumn("seen", F.lit(True))
            several = (F.col("low") < F.col("high")) | (F.col("low").isNotNull() & (F.col("nulls") > 0))
            shared = store(old.unionByName(new.where(several).withColumn("seen", F.lit(False))).select(*KEY, "low", "seen", "n"), "shared_lines")
        release(keys)
        dropped.append(
            join_spread(mine, shared.drop("n"), KEY, ["id", "pos"], shared.select(*KEY, "n"))
            .where(F.col("seen") | ~F.col("id").eqNullSafe(F.col("low")))
            .select("id", "digest", "pos")
        )
        runs.add(new)
    found = functools.reduce(DataFrame.unionAll, dropped)
    gone = store(found.groupBy("id", "digest").agg(F.collect_set("pos").alias("dropped")), "dropped")
    runs.close()
    release(lines)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with shared lines removed from the text, and ``n_lines`` and ``n_dropped`` (names made free).

    A null or empty text is one empty line and ends as the empty text. See
    :func:`dropped_lines` for which lines go. Other columns pass through; repeated rows stay
    and each loses the same lines. An empty table gives an empty table.
    """
    gone = dropped_lines(docs, id_col, text_col, **options).select(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest"), "dropped")
    lines, dropped = fresh(docs, "lines_all"), fresh(docs, "lines_gone")
    n_lines, n_dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs[text_col]) == gone["gone_digest"]), "left").select(
        *[docs[c] for c in docs.columns], gone["dropped"].alias(dropped), split_lines(docs[text_col]).alias(lines)
    )
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.when(F.col(dropped).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.array_join(F.transform(F.array_except(places, F.col(dropped)), lambda i: F.element_at(F.col(lines), i + 1)), "\n")
    )
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.size(lines).cast("long").alias(n_lines),
        F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias(n_dropped),
    )
