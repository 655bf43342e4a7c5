from __future__ import annotations

from foliolink.streaming import runs

SCHEMA = "doc_id string, sig_name string, page_number int"


def test_runs_go_on_across_triggers(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("d", "a", 1), ("d", "a", 2), ("d", "b", 3)], SCHEMA).coalesce(1).write.parquet(src)
    stream = runs.numbered_runs(runs.page_stream(spark, src, SCHEMA))
    query = stream.writeStream.format("memory").queryName("runs_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        spark.createDataFrame([("d", "a", 3), ("d", "a", 7)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        query.processAllAvailable()
        got = sorted((r.sig_name, r.page_number, r.entry_no) for r in spark.table("runs_out").collect())
    finally:
        query.stop()
    assert got == [("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("a", 7, 2), ("b", 3, 1)]
