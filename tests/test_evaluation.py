"""Quality of mappings."""

from labourmill.operators import evaluation


def test_nothing_mapped_has_no_confidence(spark):
    rows = spark.createDataFrame([("a", None, 0.4), ("b", None, 0.9)], "raw_skill string, esco_uri string, confidence double")
    assert tuple(evaluation.mapping_quality(rows).first()) == (2, 0, 0.0, None, True, None)
    some = rows.unionByName(spark.createDataFrame([("c", "m/1", 0.25)], rows.schema))
    assert tuple(evaluation.mapping_quality(some).first()) == (3, 1, 1 / 3, 0.25, True, True)
