"""Quality of mappings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from labourmill.functions.ratio import token_sort_ratio
from labourmill.operators.matching import fuzzy_top_k


@F.pandas_udf(DoubleType())
def label_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Token-sort ratio (0 to 1) of two labels in lower case; null with either."""
    return pd.Series([None if x is None or y is None else token_sort_ratio(x.lower(), y.lower()) / 100.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def hallucination_check(mappings: DataFrame, concepts: DataFrame) -> DataFrame:
    """Mappings whose uri the taxonomy doesn't have."""
    return mappings.filter("esco_uri is not null").join(concepts.select(F.col("uri").alias("esco_uri")), "esco_uri", "left_anti")


def mapping_quality(mappings: DataFrame, least_rate: float = 0.60, least_confidence: float = 0.50) -> DataFrame:
    """One row of counts, rates and their flags. Where nothing is mapped, the confidence and its flag are null."""
    mapped, total = F.count("esco_uri"), F.count(F.lit(1))
    one = mappings.agg(total.alias("total"), mapped.alias("mapped"), F.coalesce(mapped / F.greatest(total, F.lit(1)), F.lit(0.0)).alias("mapping_rate"), F.avg(F.when(F.col("esco_uri").isNotNull(), F.col("confidence"))).alias("avg_confidence"))
    return one.withColumns({"low_rate": F.col("mapping_rate") < least_rate, "low_confidence": F.col("avg_confidence") < least_confidence})


def eval_entries(entries: DataFrame, mappings: DataFrame, concepts: DataFrame, label_threshold: float = 0.8) -> DataFrame:
    """Each golden entry with what was returned for its raw_skill (esco_uri, esco_label, confidence) and whether that is right."""
    returned = mappings.select("raw_skill", F.col("esco_uri").alias("returned_uri"), F.col("esco_label").alias("returned_label"), F.col("confidence").alias("returned_confidence"))
    known = concepts.select(F.col("uri").alias("returned_uri"), F.lit(True).alias("known")).distinct()
    both = entries.join(returned, "raw_skill", "left").join(known, "returned_uri", "left")
    has = (F.coalesce("returned_label", F.lit("")) != "") & (F.coalesce("expected_label", F.lit("")) != "")
    scored = both.withColumn("score", F.when(has, label_ratio("returned_label", "expected_label")).otherwise(0.0))
    matched = F.when(F.col("expected_label").isNull(), F.col("returned_uri").isNull()).when(F.coalesce("expected_uri", F.lit("")) != "", F.col("returned_uri").eqNullSafe(F.col("expected_uri"))).otherwise(F.col("score") >= label_threshold)
    return scored.select(
        "id", "raw_skill", "expected_label", "expected_uri", "returned_uri", "returned_label", "returned_confidence", matched.alias("matched"),
        (F.col("returned_uri").isNotNull() & F.col("known").isNull()).alias("hallucinated"), F.round("score", 3).alias("label_score"),
    )


def eval_report(results: DataFrame, min_precision: float = 0.70, min_mapping_rate: float = 0.75, max_hallucination: float = 0.05, min_confidence: float = 0.55) -> DataFrame:
    """One row of metrics and the list of thresholds that they miss. Without entries all rates are 0."""

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    should = F.col("expected_label").isNotNull()
    n = F.count(F.lit(1))
    one = results.agg(
        n.alias("total"), share(F.count(F.when(should & F.col("returned_uri").isNotNull(), 1)), F.count(F.when(should, 1))).alias("r"), share(F.count(F.when(F.col("matched"), 1)), n).alias("p"),
        F.avg("returned_confidence").alias("c"), F.coalesce(F.min("returned_confidence"), F.lit(0.0)).alias("m"), share(F.count(F.when(F.col("hallucinated"), 1)), n).alias("h"),
    )
    checks = {"precision_at_1": F.col("p") < min_precision, "mapping_rate": F.col("r") < min_mapping_rate, "hallucination_rate": F.col("h") > max_hallucination, "avg_confidence": F.coalesce(F.col("c") < min_confidence, F.lit(False))}
    failures = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in checks.items()]), lambda x: x.isNotNull())
    return one.select(
        "total", F.round("r", 4).alias("mapping_rate"), F.round("p", 4).alias("precision_at_1"), F.round(F.coalesce("c", F.lit(0.0)), 4).alias("avg_confidence"), F.round("m", 4).alias("min_confidence"),
        F.round("h", 4).alias("hallucination_rate"), (F.size(failures) == 0).alias("threshold_ok"), failures.alias("failures"),
    )


def golden_proposals(entries: DataFrame, labels: DataFrame, concepts: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Entries with proposed_uri, proposed_label, match and action: already set, skip, no candidate, approve or review."""
    open_ = entries.filter("coalesce(expected_uri, '') = '' and expected_label is not null").select("raw_skill").distinct()
    best = fuzzy_top_k(open_, labels, 3).filter("rank = 1").join(concepts.select("uri", "preferred_label"), "uri", "left").select("raw_skill", F.col("uri").alias("u"), F.coalesce("preferred_label", "label").alias("l"))
    both = entries.join(best, "raw_skill", "left").withColumn("m", F.when(F.col("l").isNotNull() & F.col("expected_label").isNotNull(), label_ratio("l", "expected_label")))
    is_set = F.coalesce("expected_uri", F.lit("")) != ""
    action = F.when(is_set, "already set").when(F.col("expected_label").isNull(), "skip").when(F.col("u").isNull(), "no candidate").when(F.col("m") >= threshold, "approve").otherwise("review")
    match = F.when(is_set, 1.0).when(F.col("expected_label").isNull(), None).when(F.col("u").isNull(), 0.0).otherwise(F.round("m", 3))
    open_row = ~is_set & F.col("expected_label").isNotNull()
    return both.select(
        *entries.columns, F.when(is_set, F.col("expected_uri")).when(open_row, F.col("u")).alias("proposed_uri"), F.when(is_set, F.col("expected_label")).when(open_row, F.col("l")).alias("proposed_label"), match.alias("match"), action.alias("action")
    )


def apply_proposals(proposals: DataFrame, columns: list[str]) -> DataFrame:
    """The entries, with the uris of approved proposals."""
    return proposals.withColumn("expected_uri", F.when(F.col("action") == "approve", F.col("proposed_uri")).otherwise(F.col("expected_uri"))).select(*columns)
