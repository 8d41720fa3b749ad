"""A first pass takes all blocks without tokens, whatever the target rounds to, and no other pass does."""

import pytest
from pyspark.sql import functions as F

from labourmill.llm import mixing


@pytest.mark.parametrize("part", [1 - 2**-53, 1.0, 2.5])
def test_empty_documents_of_the_largest_source(spark, part):
    blocks = spark.createDataFrame([("a", b, 97 if b == 0 else 0) for b in range(12)] + [("b", 0, 17), ("c", 0, 5)], "source string, block long, tokens long")
    weights = mixing.source_weights(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))).withColumn("target_tokens", F.col("tokens") * part)
    got = [(r.epoch, r.block) for r in mixing.block_plan(blocks, weights).filter("source = 'a'").collect()]
    assert sorted(b for e, b in got if b or e == 0 and part >= 1) == list(range(0 if part >= 1 else 1, 12))


def test_the_largest_source_is_seen_once(spark):
    for big in (90, 97, 103):
        totals = spark.createDataFrame([("a", big), ("b", 17), ("c", 5), ("z", 0)], "source string, tokens long")
        got = {r.source: r.target_tokens for r in mixing.source_weights(totals).collect()}
        assert got["a"] == big and got["z"] == 0
