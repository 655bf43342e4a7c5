"""Statistics, routed extraction, algorithms side by side, files by suffix, versions."""

from __future__ import annotations

import json
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliolink.operators.statistics import RunningStatistics
from foliolink.plans import algorithms, files
from foliolink.sources import publish
from foliolink.sources.page_files import PageFiles, PageFilesReader


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def test_running_statistics(spark):
    """Totals of several runs equal a grouped count; a failed run adds nothing; reset begins anew."""
    runs = [spark.createDataFrame([(k % n != 0, k / 8) for k in range(50)] + [(None, None)], "success boolean, processing_time double") for n in (2, 3, 5)]
    stats = RunningStatistics()
    assert stats.get()["success_rate"] == 0.0
    threads = [threading.Thread(target=stats.follow, args=(r, noop)) for r in runs]
    [t.start() for t in threads]
    [t.join() for t in threads]
    every = runs[0].unionByName(runs[1]).unionByName(runs[2])
    want = every.agg(F.count("*").alias("n"), F.count(F.when(F.col("success"), 1)).alias("ok"), F.sum("processing_time").alias("s")).first()
    got = stats.get()
    assert (got["total_documents"], got["successful_extractions"], got["failed_extractions"]) == (want.n, want.ok, want.n - want.ok)
    assert got["total_processing_time"] == pytest.approx(want.s) and got["success_rate"] == pytest.approx(100 * want.ok / want.n)
    with pytest.raises(PySparkException):
        stats.follow(runs[0].withColumn("success", F.raise_error(F.lit("x")).cast("boolean")), noop)
    assert stats.get() == got and stats.reset() == got and stats.get()["total_documents"] == 0
    stats.follow(runs[0].limit(0), noop)
    assert stats.get()["total_documents"] == 0


PAGES = "doc_id string, page_number int, text string"


def read(pages):
    seen = pages.where("page_number <> 3")
    return seen.select("doc_id", "page_number", F.concat(F.lit("read "), "page_number").alias("text"), F.lit(0.7).alias("confidence"), (F.col("page_number") != 2).alias("success"), F.lit(1.0).alias("processing_time"))


def test_routed_extraction(spark):
    pages = spark.createDataFrame([("typed", 1, "t" * 80), ("typed", 2, None), ("image", 1, None), ("image", 2, ""), ("image", 3, " ")], PAGES)
    asked = []
    made = files.process(pages, lambda p: (asked.append(p), read(p))[1])
    assert {r.doc_id for r in asked[0].collect()} == {"image"}  # only its documents reach the reader
    got = {r.doc_id: r for r in made["documents"].collect()}
    assert (got["typed"].method, got["typed"].total_characters, got["typed"].success, got["typed"].error) == ("scanned", 80, True, None)
    assert (got["image"].method, got["image"].total_pages, got["image"].successful_pages, got["image"].total_characters, got["image"].processing_time) == ("ocr", 3, 1, 6, 2.0)
    assert made["pages"].count() == 5 and made["summary"].first().total_documents == 2
    without = {r.doc_id: (r.success, r.error) for r in files.process(pages)["documents"].collect()}
    assert without == {"typed": (True, None), "image": (False, "no reader or no text")}
    forced = files.process(pages, read, method="ocr")["documents"].collect()
    assert {r.method for r in forced} == {"ocr"}
    with pytest.raises(ValueError):
        files.process(pages, read, method="guess")


def test_tables_only_where_lines_make_one(spark):
    readings = read(spark.createDataFrame([("d", 1, ""), ("d", 4, "")], PAGES))
    grid = [("h", 0.0, y, 100.0, y) for y in (0.0, 20.0, 40.0)] + [("v", x, 0.0, x, 40.0) for x in (0.0, 50.0, 100.0)]
    lines = spark.createDataFrame([("d", 1, *g) for g in grid] + [("d", 4, *g) for g in grid[:2]], "doc_id string, page_number int, orientation string, x1 double, y1 double, x2 double, y2 double")
    cells = spark.createDataFrame([("d", n, 1, t, x, y) for n in (1, 4) for t, x, y in (("a", 1.0, 5.0), ("b", 60.0, 5.0), ("c", 1.0, 25.0))], "doc_id string, page_number int, table_id int, text string, x double, y double")
    got = {r.page_number: r.text for r in files.with_tables(readings, lines, cells).collect()}
    assert got[1].startswith("read 1\n\n--- TABLE 1 ---\n| a | b |") and got[4] == "read 4"


def test_both_methods(spark):
    pages = spark.createDataFrame([("typed", 1, "t" * 80), ("image", 1, None), ("none", 2, None)], PAGES)
    got = {r.doc_id: r for r in files.both_methods(pages, read).collect()}
    assert (got["typed"].method, got["typed"].n_methods, got["typed"].fastest, got["typed"].most_characters, got["typed"].alternatives) == ("scanned", 2, "scanned", "scanned", ["ocr"])
    assert (got["image"].method, got["image"].n_methods) == ("ocr", None) and got["none"].method == "none"


class Fixed:
    def __init__(self, name, patients):
        self.name, self.patients = name, patients

    def identify(self, pages):
        return pages.groupBy("doc_id").agg(*[F.lit(self.patients).cast("long").alias(c) for c in algorithms.FIGURES[:4]], F.lit(0.5).alias("average_confidence"))


class Late(Fixed):
    """Fails while it runs, not while it is planned."""

    def identify(self, pages):
        return super().identify(pages).withColumn("total_patients", F.raise_error(F.lit("broken")).cast("long"))


class Lacking(Fixed):
    def identify(self, pages):
        return super().identify(pages).drop("total_entries")


def test_algorithms_fail_alone(spark):
    pages = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "doc_id string, page_number int")
    made = algorithms.comparison(pages, [Fixed("one", 1), Late("late", 1), Fixed("two", 2), Lacking("lacking", 1), Fixed("three", 2)])
    runs = {r.algorithm: r for r in made["runs"].collect()}
    assert [runs[n].success for n in ("one", "late", "two", "lacking", "three")] == [True, False, True, False, True] and runs["one"].n_documents == 2
    assert "broken" in runs["late"].error or "Exception" in runs["late"].error
    analysis = {r.doc_id: r for r in made["analysis"].collect()}
    assert (analysis["a"].n_algorithms, analysis["a"].consensus_patients, analysis["a"].min_patients, analysis["a"].max_patients) == (3, 2, 1, 2)
    assert set(made["algorithms"].first().algorithm_results) == {"one", "two", "three"}
    assert algorithms.comparison(pages, [Late("late", 1)])["analysis"].count() == 0


def test_registry():
    algorithms.register(Fixed("fixed", 3))
    try:
        assert [i.name for i in algorithms.chosen(["fixed", "rule_matcher"])] == ["fixed", "rule_matcher"] and len(algorithms.chosen()) == 2
        with pytest.raises(KeyError, match="nothing"):
            algorithms.chosen(["nothing"])
    finally:
        del algorithms.REGISTRY["fixed"]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text(json.dumps({"pages": [{"page_number": 4, "text": "x", "confidence": 0.5, "success": True}, {"text": None}]}))
    (tmp_path / "sub" / "broken.JSON").write_text('{"pages": [')
    (tmp_path / "sub" / "empty.json").write_text('{"other": 1}')
    (tmp_path / "p.PNG").write_bytes(b"\x89PNG1")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "note.txt").write_text("no")
    (tmp_path / ".hidden.json").write_text("{}")
    return str(tmp_path)


def test_files_by_suffix(spark, folder):
    spark.dataSource.register(PageFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("page_files").option("partitionBytes", "1").load(folder)
    assert rows.rdd.getNumPartitions() == 5
    got = {(r.stem, r.pos): r for r in rows.collect()}
    assert set(got) == {("a", 0), ("a", 1), ("broken", None), ("empty", None), ("p", None), ("d", None)}
    assert (got["a", 0].page_number, got["a", 0].text, got["a", 0].success) == (4, "x", True) and (got["a", 1].page_number, got["a", 1].text, got["a", 1].success) == (2, "", False)
    assert got["broken", None].error.startswith("JSONDecodeError") and got["empty", None].error == "ValueError: no list of pages"
    assert bytes(got["p", None].content) == b"\x89PNG1" and got["p", None].kind == "image" and got["d", None].kind == "document"
    assert rows.where("kind = 'image'").count() == 1 and rows.where("suffix in ('png', 'pdf') and length > 4").count() == 1
    images = spark.read.format("page_files").option("suffixes", "png").option("content", "false").load(folder).collect()
    assert [(r.stem, r.content) for r in images] == [("p", None)]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_filters_prune_the_list(folder):
    from pyspark.sql.datasource import EqualTo, IsNotNull, StringStartsWith

    reader = PageFilesReader({"path": folder})
    left = list(reader.pushFilters([EqualTo(("suffix",), "json"), IsNotNull(("suffix",)), StringStartsWith(("stem",), "b"), EqualTo(("text",), "x")]))
    assert left == [IsNotNull(("suffix",)), EqualTo(("text",), "x")]
    assert [f[1] for p in reader.partitions() for f in p.files] == ["broken"]
    with pytest.raises(ValueError):
        PageFilesReader({"path": folder, "suffixes": "txt"})
    with pytest.raises(ValueError):
        PageFilesReader({})


def test_versions(spark, tmp_path):
    """A failed write leaves the old version; a table may be made from itself; a second writer is told."""
    root = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        publish.published(spark, root)
    rows = spark.range(3)
    assert publish.publish(rows, root, 0) == 1
    with pytest.raises(PySparkException):
        publish.publish(rows.withColumn("id", F.raise_error(F.lit("x")).cast("long")), root)
    assert publish.published(spark, root).count() == 3 and publish.versions(spark, root) == [1]
    assert publish.publish(publish.published(spark, root).withColumn("id", F.col("id") + 10), root, 1) == 2
    assert {r.id for r in publish.published(spark, root).collect()} == {10, 11, 12} and publish.published(spark, root, 1).count() == 3
    with pytest.raises(publish.PublishConflict):
        publish.publish(rows, root, 1)
    assert publish.publish(rows.limit(0), root) == 3 and publish.published(spark, root).count() == 0
    assert publish.prune(spark, root, 1) == 3 and publish.versions(spark, root) == [3]  # the failed write's folder too


def test_cache_versions(spark, tmp_path):
    root = str(tmp_path / "cache")
    page = lambda *rows: spark.createDataFrame(rows, "stem string, modified long, page_number int")
    publish.update_cache(page(("a", 1, 1), ("a", 1, 2), ("b", 1, 1)), root)
    publish.update_cache(page(("a", 2, 1)), root)
    assert sorted(map(tuple, publish.published(spark, root).collect())) == [("a", 2, 1), ("b", 1, 1)]


def test_summary_takes_the_place_of_the_response(spark, tmp_path):
    response = "struct<patient: struct<full_name: string>, doctor: struct<npi: string>, insurance: struct<primary_insurance: string>, dme: struct<dme_id: string>>"
    summary = "struct<patient_summary: struct<full_name: string>, doctor_npi: string, insurance_summary: struct<primary_insurance: string>, dme_summary: struct<dme_id: string>>"
    said = (("said",), ("1",), ("plan",), ("d",))
    rows = [("m1", "a", said, (("known",), "", None, ("e",))), ("m1", "b", said, None), ("m2", "a", said, (None, "2", None, None)), ("m2", "b", None, None)]
    results = spark.createDataFrame(rows, f"model string, doc_id string, response {response}, summary {summary}")
    assert publish.publish_by_model(results, str(tmp_path)) == {"m1": 1, "m2": 1}
    one = {r.doc_id: r.response for r in publish.published(spark, f"{tmp_path}/m1").collect()}
    assert (one["a"].patient.full_name, one["a"].doctor.npi, one["a"].insurance.primary_insurance, one["a"].dme.dme_id) == ("known", "1", "plan", "e")
    assert one["b"].patient.full_name == "said"
    assert [(r.doc_id, r.response.doctor.npi) for r in publish.published(spark, f"{tmp_path}/m2").collect()] == [("a", "2")]
    publish.publish_by_model(results.where("doc_id = 'b'"), str(tmp_path))
    assert publish.versions(spark, f"{tmp_path}/m1") == [1, 2] and publish.versions(spark, f"{tmp_path}/m2") == [1]


def test_algorithms_share_one_making_of_the_pages(spark):
    """each algorithm made the pages anew, some several times."""
    from foliolink.plans import algorithms

    made = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            made.add(len(part))
            yield part

    schema = "doc_id string, pos int, page_number int, text string, confidence double, success boolean"
    rows = [("d", k, k + 1, "Patient Name: Ann Lee\nDOB: 01/02/1980\n", 0.9, True) for k in range(3)]
    pages = spark.createDataFrame(rows, schema).mapInPandas(count, schema)
    made.value = 0
    found = algorithms.run(pages, [algorithms.RuleMatcher("a"), algorithms.RuleMatcher("b")])
    assert found["runs"].where("success").count() == 2 and made.value == 3
