"""Hashed vectors that leave the workers without their zeros."""

import numpy as np

from quarry.operators import embedding
from quarry.plans import registry


def test_sparse_vectors_are_the_dense_ones(spark):
    rows = [(1, "two words"), (2, None), (3, ""), (4, "two words"), (5, "… und Größe"), (None, "x")]
    frame = spark.createDataFrame(rows, "k long, text string")
    dense = {r.k: np.array(r.embedding) for r in embedding.embed(frame).collect()}
    found = embedding.embed_sparse(frame).collect()
    assert len(found) == len(rows)
    for r in found:
        own = np.zeros(384)
        for bucket, value in r.embedding:
            own[bucket] = value
        assert (own == dense[r.k]).all() and all(value for _, value in r.embedding)


def test_rows_of_a_small_file_are_dealt_out(spark):
    got = registry.QUERIES["hash_embedding"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().toString()
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and "posexplode" not in plan
