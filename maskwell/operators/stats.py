"""Counters and reports over spans, messages and decisions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwell.rules.registry import CATEGORY_OF, PII_TYPES, PROVIDERS
from maskwell.sources.tables import saved

RETENTION_DAYS = 90


def counts_by_type(spans: DataFrame, *keys: str) -> DataFrame:
    return spans.groupBy(*keys, "type").agg(F.count("*").alias("n"))


def summarize(df: DataFrame, spans: str = "spans", out: str = "summary") -> DataFrame:
    """"2 email, 1 ssn" with types in the order they are first seen."""
    text = (
        f"array_join(transform(array_distinct({spans}.type), t -> concat("
        f"size(filter({spans}.type, x -> x = t)), ' ', replace(lower(t), '_', ' '))), ', ')"
    )
    return df.withColumn(
        out, F.expr(f"if(size({spans}) = 0, 'no PII detected', {text})")
    )


def types_found(df: DataFrame, spans: str = "spans", out: str = "types") -> DataFrame:
    return df.withColumn(out, F.array_distinct(F.col(f"{spans}.type")))


def avg_confidence(df: DataFrame, spans: str = "spans", out: str = "avg_confidence") -> DataFrame:
    total = F.aggregate(
        f"{spans}.confidence", F.lit(0.0), lambda a, c: a + c
    )
    return df.withColumn(out, F.when(F.size(spans) > 0, total / F.size(spans)))


def distinct_findings(spans: DataFrame, *keys: str) -> DataFrame:
    """One row per type and value of a message: the first by start."""
    return spans.groupBy(*keys, "type", "value").agg(
        F.min(F.struct("start", "end", "confidence")).alias("first")
    ).select(*keys, "type", "value", "first.*")


def with_type_info(spans: DataFrame) -> DataFrame:
    """Label, tier, placeholder and category; an unknown type is its own label."""
    from maskwell.rules.registry import pii_types

    info = pii_types(spans.sparkSession)
    return spans.join(F.broadcast(info), "type", "left").withColumn(
        "placeholder", F.coalesce("placeholder", "type")
    )


def counts_by_category(spans: DataFrame, *keys: str) -> DataFrame:
    pairs = [F.lit(x) for kv in CATEGORY_OF.items() for x in kv]
    category = F.try_element_at(F.create_map(*pairs), F.col("type"))
    return spans.withColumn("category", category).groupBy(*keys, "category").agg(
        F.count("*").alias("n")
    )


def daily_stats(messages: DataFrame, spans: str = "spans", zeros: bool = False) -> DataFrame:
    """Messages scanned, findings by type, blocked and sent anyway, per day.

    ``messages`` needs ``ts``, the spans and, if decisions were taken, ``logged_action``.
    Both aggregates combine on the map side; the counts per type are joined by day only
    after they have shrunk to one row per day.
    """
    action = (
        F.col("logged_action") if "logged_action" in messages.columns
        else F.lit(None).cast("string")
    )
    dated = messages.select(
        F.to_date("ts").alias("date"), spans, action.alias("action")
    )
    per_day = dated.groupBy("date").agg(
        F.count("*").alias("messages_scanned"),
        F.count_if(F.col("action") == "blocked").alias("messages_blocked"),
        F.count_if(F.col("action") == "dismissed").alias("messages_sent_anyway"),
    )
    by_type = (
        dated.select("date", F.explode(F.col(f"{spans}.type")).alias("type"))
        .groupBy("date", "type")
        .agg(F.count("*").alias("n"))
        .groupBy("date")
        .agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias(
                "pii_detected"
            )
        )
    )
    empty = F.create_map().cast("map<string,bigint>")
    found = F.coalesce("pii_detected", empty)
    if zeros:
        blank = F.create_map(*[F.lit(x) for t in PII_TYPES for x in (t[0], 0)]).cast(
            "map<string,bigint>"
        )
        found = F.map_zip_with(
            blank, found, lambda _, a, b: F.coalesce(b, a)
        )
    return per_day.join(by_type, "date", "left").select(
        "date", "messages_scanned", found.alias("pii_detected"),
        "messages_blocked", "messages_sent_anyway",
    )


COUNTERS = ("messages_scanned", "messages_blocked", "messages_sent_anyway")


def _detections() -> Column:
    return F.aggregate(F.map_values("pii_detected"), F.lit(0).cast("bigint"), lambda a, n: a + n)


def total_stats(daily: DataFrame) -> DataFrame:
    """Sums over all days: one row."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]
    return daily.agg(*sums, F.coalesce(F.sum(_detections()), F.lit(0)).alias("detections"))


def total_by_type(daily: DataFrame) -> DataFrame:
    return (
        daily.select(F.explode("pii_detected").alias("type", "n"))
        .groupBy("type")
        .agg(F.sum("n").alias("n"))
    )


def week_stats(daily: DataFrame, as_of: date | str) -> DataFrame:
    """The seven days that end with ``as_of``."""
    end = F.to_date(F.lit(str(as_of)))
    inside = daily.where((F.col("date") <= end) & (F.col("date") > F.date_sub(end, 7)))
    return total_stats(inside)


def running_week(daily: DataFrame) -> DataFrame:
    """The same sum for every day. ``daily`` has one row per day, so one group is small."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    window = Window.partitionBy(F.lit(0)).orderBy(day).rangeBetween(-6, 0)
    return daily.select(
        "date",
        *[F.sum(c).over(window).alias(f"week_{c}") for c in COUNTERS],
        F.sum(_detections()).over(window).alias("week_detections"),
    )


def weekly_summary(daily: DataFrame, as_of: date | str) -> DataFrame:
    end = F.to_date(F.lit(str(as_of)))
    inside = daily.where((F.col("date") <= end) & (F.col("date") > F.date_sub(end, 7)))
    return inside.agg(
        F.coalesce(F.sum("messages_scanned"), F.lit(0)).alias("total_scanned"),
        F.coalesce(F.sum("messages_blocked"), F.lit(0)).alias("total_blocked"),
        F.coalesce(F.sum(_detections()), F.lit(0)).alias("total_detections"),
    ).select(F.date_sub(end, 6).alias("week_starting"), "*")


def weekly_series(daily: DataFrame) -> DataFrame:
    """One summary row per calendar week, weeks starting on Monday."""
    return daily.groupBy(F.to_date(F.date_trunc("week", "date")).alias("week_starting")).agg(
        F.sum("messages_scanned").alias("total_scanned"),
        F.sum("messages_blocked").alias("total_blocked"),
        F.sum(_detections()).alias("total_detections"),
    )


def prune_stats(daily: DataFrame, as_of: date | str, days: int = RETENTION_DAYS) -> DataFrame:
    return daily.where(F.col("date") >= F.date_sub(F.to_date(F.lit(str(as_of))), days))


def prune_vault(vault: DataFrame, now: datetime | str, hours: int = 24) -> DataFrame:
    cutoff = F.lit(str(now)).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
    return vault.where(F.col("created_at") >= cutoff)


def top_types(by_type: DataFrame, n: int | None = None) -> DataFrame:
    ranked = by_type.orderBy(F.desc("n"), "type")
    return ranked.limit(n) if n else ranked


# Half-open bucket edges; the choice of edges is ours.
CONFIDENCE_EDGES = (0.5, 0.7, 0.85, 0.95)
LENGTH_EDGES = (100, 500, 1000, 5000, 20000)


def bucket(column: Column, edges: tuple[float, ...]) -> Column:
    out = F.lit(f">={edges[-1]}")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        out = F.when(column < high, f"{low}-{high}").otherwise(out)
    return F.when(column < edges[0], f"<{edges[0]}").otherwise(out)


def scan_profile(messages: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Findings by source, confidence bucket and length bucket of the message."""
    sized = messages.select(
        bucket(F.length(text), LENGTH_EDGES).alias("length_bucket"), F.explode(spans).alias("s")
    )
    return sized.groupBy(
        F.col("s.source").alias("source"),
        bucket(F.col("s.confidence"), CONFIDENCE_EDGES).alias("confidence_bucket"),
        "length_bucket",
    ).agg(F.count("*").alias("n"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("entity_type").agg(
        F.count_if(F.col("correct")).alias("correct"),
        F.count_if(~F.col("correct")).alias("incorrect"),
    )


def valid_reports(reports: DataFrame) -> DataFrame:
    size = F.length("description")
    return reports.where(
        (F.length("id") >= 1)
        & F.col("created_at").isNotNull()
        & (F.length("entity_type") >= 1)
        & size.between(4, 240)
        & (F.col("provider").isNull() | F.col("provider").isin(*PROVIDERS))
    )


def missed_reports(reports: DataFrame) -> DataFrame:
    return valid_reports(reports).groupBy("entity_type", "provider").agg(
        F.count("*").alias("n")
    )


def nearest_rank(df: DataFrame, column: str, p: float, out: str = "value") -> DataFrame:
    """Nearest-rank percentile: the value at position ceil(p * n) of the sorted column, no row for an empty one.

    Exact. Equal values are counted before they move; the counts are range-partitioned, so no outlier and
    no frequent value makes a large range. Running sums over the ranges, one row each, find the
    one that holds the position, and only its values are ranked.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    counted = values.groupBy("v").agg(F.count("*").alias("c"))
    # Written, as the numbers of the ranges must not change between the two reads.
    ranged = saved(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        ranged.groupBy("part")
        .agg(F.sum("c").alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("rank", F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.sum("size").over(Window.partitionBy()))))
        .where("before < rank AND before + size >= rank")
        .select(F.col("part").alias("chosen"), "before", "rank")
    )
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("v"))
    return (
        ranged.join(ranges, F.col("part") == F.col("chosen"))
        .withColumn("upto", upto)
        .where("upto >= rank")
        .groupBy("part")
        .agg(F.min("v").alias(out))
        .select(out)
    )
