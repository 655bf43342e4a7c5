"""Tables and results that are replaced whole or not at all.

A version is written to a folder of its own; it counts once a manifest names it. Manifests are
numbered and put in place by a rename that never overwrites, so readers see the last finished
version, a failed write leaves it readable, and of two writers at once one is told.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS = "_versions"


class PublishConflict(Exception):
    """Another writer published meanwhile."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    path, fs = _fs(spark, root)
    folder = path(f"{root}/{MANIFESTS}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, root: str, number: int) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(f"{root}/{MANIFESTS}/{number:08d}.json").collect()))  # one small file


def publish(df: DataFrame, root: str, expected: int | None = None, form: str = "parquet") -> int:
    """Replaces the table at ``root`` by ``df`` and returns the version's number.

    ``expected`` is the version that ``df`` was made from (0 for none): if another one is the
    last by now, nothing changes and :class:`PublishConflict` is raised. ``df`` may be made from
    the table itself, as the old version stays where it is.
    """
    spark = df.sparkSession
    before = versions(spark, root)
    last = before[-1] if before else 0
    if expected is not None and expected != last:
        raise PublishConflict(f"version {last} is there, not {expected}")
    folder = f"data-{uuid.uuid4().hex}"
    df.write.format(form).save(f"{root}/{folder}")
    path, fs = _fs(spark, root)
    number = last + 1
    staged, final = path(f"{root}/{MANIFESTS}/.{folder}"), path(f"{root}/{MANIFESTS}/{number:08d}.json")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps({"folder": folder, "format": form, "schema": df.schema.json()}).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(staged, final):
        fs.delete(staged, False)
        fs.delete(path(f"{root}/{folder}"), True)
        raise PublishConflict(f"version {number} was published meanwhile")
    return number


def published(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table's last version, or the one asked for."""
    there = versions(spark, root)
    if not there or (version is not None and version not in there):
        raise FileNotFoundError(f"{root} has no version {version or ''}".rstrip())
    from pyspark.sql.types import StructType

    told = _manifest(spark, root, version or there[-1])
    return spark.read.format(told["format"]).schema(StructType.fromJson(json.loads(told["schema"]))).load(f"{root}/{told['folder']}")


def prune(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes all but the last ``keep`` versions and what failed writes left; returns how many folders went. No writer may be at work."""
    there = versions(spark, root)
    path, fs = _fs(spark, root)
    kept = {_manifest(spark, root, n)["folder"] for n in there[-max(1, keep) :]}
    for n in there[: -max(1, keep)]:
        fs.delete(path(f"{root}/{MANIFESTS}/{n:08d}.json"), False)
    gone = [s.getPath() for s in fs.listStatus(path(root)) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in kept]
    for folder in gone:
        fs.delete(folder, True)
    return len(gone)


def update_cache(pages: DataFrame, root: str, keys: tuple[str, ...] = ("stem", "modified")) -> int:
    """Publishes the cache with the documents of ``pages`` put in place of what it had under their stem; others stay."""
    spark = pages.sparkSession
    there = versions(spark, root)
    if not there:
        return publish(pages, root, 0)
    old = published(spark, root, there[-1])
    stays = old.join(pages.select(keys[0]).distinct(), keys[0], "left_anti")
    return publish(stays.unionByName(pages), root, there[-1])


def with_summary(response: Column, summary: Column) -> Column:
    """A response's record in which what the document's summary knows takes the place of what the response said.

    ``response`` is ``struct<patient, doctor: struct<npi>, insurance, dme>``; ``summary`` is
    ``struct<patient_summary, doctor_npi, insurance_summary, dme_summary>``. A part of the summary
    that is null, or an empty NPI, changes nothing.
    """
    npi = F.nullif(summary["doctor_npi"], F.lit(""))
    return F.struct(
        F.coalesce(summary["patient_summary"], response["patient"]).alias("patient"),
        F.struct(F.coalesce(npi, response["doctor"]["npi"]).alias("npi")).alias("doctor"),
        F.coalesce(summary["insurance_summary"], response["insurance"]).alias("insurance"),
        F.coalesce(summary["dme_summary"], response["dme"]).alias("dme"),
    )


def publish_by_model(results: DataFrame, root: str) -> dict[str, int]:
    """Publishes each model's responses ``(model, doc_id, response, summary)`` as JSON under ``root/<model>``, the summary's values first; failed ones (null response) are left out."""
    made = results.where("response is not null").withColumn("response", with_summary(F.col("response"), F.col("summary"))).drop("summary")
    names = [r.model for r in made.select("model").distinct().collect()]  # one row a model
    return {name: publish(made.where(F.col("model") == name), f"{root}/{name}", form="json") for name in sorted(names)}
