"""Precision, recall and F1 of detections against labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_labels(spans: DataFrame, gold: DataFrame) -> DataFrame:
    """Expected labels with a flag for whether some span of the type contains them."""
    expected = gold.select("case_id", F.explode("expected").alias("e")).select(
        "case_id", F.col("e.type").alias("type"), F.col("e.value_substring").alias("wanted")
    )
    hits = spans.select("case_id", "type", "value")
    joined = expected.join(hits, ["case_id", "type"], "left")
    return joined.groupBy("case_id", "type", "wanted").agg(
        F.coalesce(F.bool_or(F.contains("value", "wanted")), F.lit(False)).alias("found")
    )


def evaluate(spans: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per type and one overall row (type NULL).

    A found label is a true positive, a missing one a false negative. A forbidden string
    that some span contains is one false positive, booked on the type of the first such span.
    """
    labels = match_labels(spans, gold).select(
        "type",
        F.col("found").cast("int").alias("tp"),
        F.lit(0).alias("fp"),
        (~F.col("found")).cast("int").alias("fn"),
    )
    forbidden = gold.select("case_id", F.explode("negatives").alias("unwanted"))
    wrong = (
        forbidden.join(spans.select("case_id", "type", "value", "start"), "case_id")
        .where(F.contains("value", "unwanted"))
        .groupBy("case_id", "unwanted")
        .agg(F.min_by("type", "start").alias("type"))
        .select("type", F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))
    )
    sums = (
        labels.unionByName(wrong)
        .rollup("type")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    )
    precision = F.when(
        F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))
    ).otherwise(1.0)
    recall = F.when(
        F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))
    ).otherwise(1.0)
    scored = sums.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    return scored.withColumn(
        "f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    )
