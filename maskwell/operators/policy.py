"""Decisions on messages with findings, and the audit rows they leave behind.

Audit rows hold the type and the placeholder label, never the value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.rules.registry import PII_TYPES, PLACEHOLDER_OF, PROVIDERS

ACTIONS = ("warned", "blocked", "anonymized", "dismissed")


def decide(
    df: DataFrame,
    mode: str = "warn",
    on_dismiss: str = "block",
    choice: str | None = None,
    spans: str = "spans",
) -> DataFrame:
    """Add ``decision`` (proceed, modify or block) and ``logged_action``.

    Nothing found, or silent mode: proceed. Block mode: block. Otherwise the user's choice
    counts (``send``, ``anonymize``, ``block``); without one the dismiss rule applies.
    """
    none = F.size(spans) == 0
    picked = F.col(choice) if choice else F.lit(None).cast("string")
    dismissed_sends = on_dismiss == "send"
    decision = (
        F.when(none | F.lit(mode == "silent"), "proceed")
        .when(F.lit(mode == "block"), "block")
        .when(picked == "send", "proceed")
        .when(picked == "anonymize", "modify")
        .when(picked == "block", "block")
        .otherwise("proceed" if dismissed_sends else "block")
    )
    logged = (
        F.when(none | F.lit(mode == "silent"), F.lit(None).cast("string"))
        .when(F.lit(mode == "block"), "blocked")
        .when(picked == "send", "dismissed")
        .when(picked == "anonymize", "anonymized")
        .when(picked == "block", "blocked")
        .otherwise("dismissed" if dismissed_sends else "blocked")
    )
    return df.withColumn("decision", decision).withColumn("logged_action", logged)


def _placeholder(type_column: str):
    entries = [F.lit(x) for pair in PLACEHOLDER_OF.items() for x in pair]
    return F.coalesce(
        F.try_element_at(F.create_map(*entries), F.col(type_column)), F.lit("")
    )


def audit_rows(decided: DataFrame, spans: str = "spans") -> DataFrame:
    """One ``warned`` row per span and, where a decision was logged, one more per span."""
    found = decided.select("ts", "provider", "logged_action", F.explode(spans).alias("s"))
    actions = F.array_compact(F.array(F.lit("warned"), F.col("logged_action")))
    return found.select(
        "ts",
        "provider",
        F.col("s.type").alias("entity_type"),
        F.explode(actions).alias("action"),
    ).withColumn("placeholder_used", _placeholder("entity_type"))


def valid_audit(audit: DataFrame) -> DataFrame:
    """Rows that fit the audit schema; others are dropped silently."""
    return audit.where(
        F.col("ts").isNotNull()
        & F.col("provider").isin(*PROVIDERS)
        & F.col("entity_type").isin(*[t[0] for t in PII_TYPES])
        & F.col("action").isin(*ACTIONS)
        & F.col("placeholder_used").isNotNull()
    )


def recent_audit(audit: DataFrame, n: int = 100) -> DataFrame:
    """Newest rows first. Ties are ordered by the remaining columns, so runs agree."""
    rest = [c for c in audit.columns if c != "ts"]
    return audit.orderBy(F.desc("ts"), *rest).limit(n)


def cap_audit(audit: DataFrame, n: int) -> DataFrame:
    """The log keeps its newest rows: the feature is the cap."""
    return recent_audit(audit, n)


def merge_dismissals(allowlist: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: counts add up, the newest dismissal time stays."""
    columns = ["text_hash", "type", "dismissed_at", "dismiss_count"]
    return (
        allowlist.select(columns)
        .unionByName(new.select(columns))
        .groupBy("text_hash", "type")
        .agg(
            F.max("dismissed_at").alias("dismissed_at"),
            F.sum("dismiss_count").cast("bigint").alias("dismiss_count"),
        )
    )


def cap_allowlist(allowlist: DataFrame, n: int) -> DataFrame:
    """Evict the entries that were dismissed longest ago: a top-n, not a full sort."""
    return allowlist.orderBy(F.desc("dismissed_at"), "text_hash", "type").limit(n)
