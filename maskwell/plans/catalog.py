"""All queries by name, and their counterparts in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.operators import detect as det
from maskwell.plans.chat_queries import chat_oracles, chat_queries
from maskwell.plans.content_queries import content_oracles, content_queries
from maskwell.plans.planted import PLANTED, planted
from maskwell.plans.stream_queries import stream_oracles, stream_queries
from maskwell.sources.tables import spread

SMALL_DIR = "/root/testdata/sf0.001"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_rows(df: DataFrame, *keep: str) -> DataFrame:
    return det.explode_spans(df, "spans", *keep).select(
        *keep, "type", "value", "start", "end", F.round("confidence", 4).alias("confidence")
    )


def _detector(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = det.detector_spans(planted(spark, sf_dir, name), [name.upper()])
        return span_rows(found, "id")

    return run


def detector_queries() -> dict[str, Query]:
    return {f"detect_{name}": _detector(name) for name in PLANTED}


def found_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every rule over every document, overlaps resolved, counted by type."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return (
        det.drop_excluded(det.detect_spans(docs))
        .select(F.explode("spans").alias("s"))
        .groupBy(F.col("s.type").alias("type"))
        .agg(F.count("*").alias("n"))
    )


def queries() -> dict[str, Query]:
    return {"found_by_type": found_by_type, **detector_queries(), **chat_queries(), **content_queries(), **stream_queries()}


def oracle_sql() -> dict[str, str]:
    from maskwell.plans.oracle import identifier_oracles

    return {**identifier_oracles(), **chat_oracles(), **content_oracles(), **stream_oracles()}
