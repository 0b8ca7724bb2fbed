"""Queries on keys and sums that the smallest tables do not have."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions.expressions import bytes_label
from quarry.plans import registry


def test_labels_of_keys_whose_cube_is_beyond_a_long(spark, tmp_path):
    keys = [1, 7, 1290, 2_097_151, 2_097_152, 3_037_001, 36_000_000, 1 << 40, (1 << 63) - 1, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    exact = spark.createDataFrame([(k, None if k is None else k**3 % 5_000_000_000) for k in keys], "o_orderkey long, n long")
    want = exact.select("o_orderkey", bytes_label(F.col("n")).alias("label"))
    assert set(registry.QUERIES["format_bytes"](spark, str(tmp_path)).collect()) == set(want.collect())


@pytest.mark.parametrize("size", [1, 3, 7, 2_000_000_001])
def test_halves_of_bytes_are_rounded_as_in_the_twin(spark, tmp_path, size):
    spark.createDataFrame([(0, size, "x")], "doc_id long, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = registry.QUERIES["storage_scenarios"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.ORACLES["storage_scenarios"]).fetchall())
    half = next(r for r in got if r["factor"] == 1.5)
    assert half["bytes"] % 2 == 0 and math.isclose(half["bytes"], 1.5 * next(r for r in got if r["factor"] == 1.0)["bytes"], abs_tol=0.5)
