"""Shared pieces: word splitting, scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, and a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only a local session without one gets its own."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="spark-scratch-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """:func:`store` in buckets of ``key``, as many as shuffles have partitions: a join by it moves the other table alone."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", new_path(spark, name)).format("parquet").saveAsTable(table)
    stored = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name; the files stay
    return stored


def release(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`store` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.startswith(scratch_root(spark)) or scratch_root(spark) in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that join_spread splits, at most; each holds more than one row in this many.
HEAVY = 4096
#: Rows of a key that are never worth splitting.
LIGHT = 16
#: Parts to which a left join's rows without a key are dealt.
NULL_PARTS = 4096


def join_spread(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], counts: DataFrame, how: str = "inner", total: int | None = None) -> DataFrame:
    """``big.join(small, keys, how)`` (inner, left or left_semi) in which no key of ``big`` is one task.

    ``counts`` has ``n``, the rows of ``big``, per key; ``total`` is their sum, if it is known.
    Keys with more than one row in ``HEAVY`` (so fewer than ``HEAVY`` keys, and only they are
    collected and broadcast) are dealt to parts by a hash of the columns ``spread``, and their rows in ``small`` are repeated for each part.
    Null keys match nothing, as in any join; the rows that a left join keeps for them are dealt
    to ``NULL_PARTS`` parts by ``spread`` too, however many they are.
    """
    if total is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(total / HEAVY, float(LIGHT))
    heavy = counts.where(F.col("n") > share).select(*keys, F.ceil(F.col("n") / F.lit(share)).cast("int").alias("_parts"))
    found = heavy.toArrow()  # fewer than HEAVY rows; made of Python rows, the table would keep a daemon and two workers more on each executor
    if not found.num_rows and how != "left":
        return big.join(small, keys, how)
    heavy = big.sparkSession.createDataFrame(found, heavy.schema)
    parts = F.coalesce("_parts", F.lit(1))
    keyless = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    slots = F.when(keyless, F.lit(NULL_PARTS)).otherwise(parts)
    dealt = big.join(F.broadcast(heavy), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), slots).cast("int")).drop("_parts")
    copies = small.join(F.broadcast(heavy), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def split_words(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
