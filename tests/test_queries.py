"""Every registered query against its SQL, or running where it has none."""

from __future__ import annotations

import pytest
from compare import same

from foliolink.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_items_of_large_part_keys(spark, sf, tmp_path):
    """the SQL orders items by one number of line and part, in which parts of a million and more outweigh lines."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines.withColumn("l_partkey", lines.l_partkey * 10_007 % 3_000_000).write.parquet(f"{tmp_path}/lineitem.parquet")
    same(QUERIES["dedupe_items"](spark, str(tmp_path)), ORACLES["dedupe_items"], str(tmp_path))
