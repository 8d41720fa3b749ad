"""Pages of landed JSON."""

from pathlib import Path

from pyspark.sql import functions as F

from labourmill.plans import jobs


def test_landed_pages_are_compressed(spark):
    path = jobs._landed(spark, "/root/testdata/sf0.001", F.struct("position_id", "title"), lambda items: items.alias("results"))
    files = [f.name for f in Path(path.removeprefix("file:")).glob("part-*")]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert spark.read.json(path).select(F.explode("results")).count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
