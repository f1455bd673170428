"""Batch and streaming sources, and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.functions.scan import Rule

MESSAGES = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("turn", T.IntegerType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("provider", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
AUDIT = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("provider", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("placeholder_used", T.StringType()),
    ]
)
RULES = (
    "type string, pattern string, confidence string, `order` int, shape string, "
    "needs array<string>, name string, family string, guard string"
)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on small inputs; leave large ones alone.

    A scan of text is bound by the processor, and a small file is one row group and so one
    task. When the input has no more partitions than there are cores, its size is bounded
    by cores times the split size, and moving it once costs little. Larger inputs already
    have more tasks than cores and are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() <= cores else df


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several branches need below the checkpoint folder, and read it.

    A scan is far dearer than its output. Without this every branch would scan again, and a
    lost executor would repeat it.
    """
    from maskwell.streaming.live import checkpoint_dir

    path = checkpoint_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_messages(
    df: DataFrame,
    doc_id: str | Column,
    text: str | Column,
    session_id: str | Column | None = None,
    turn: str | Column | None = None,
    ts: str | Column | None = None,
    provider: str | Column | None = None,
) -> DataFrame:
    """Project any table to the message schema. Only the named columns are read."""

    def column(c: str | Column | None, kind: str) -> Column:
        if c is None:
            return F.lit(None).cast(kind)
        return (F.col(c) if isinstance(c, str) else c).cast(kind)

    return df.select(
        column(doc_id, "string").alias("doc_id"),
        column(session_id, "string").alias("session_id"),
        column(turn, "int").alias("turn"),
        column(ts, "timestamp").alias("ts"),
        column(provider, "string").alias("provider"),
        column(text, "string").alias("text"),
    )


def read_messages(
    spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None,
    options: dict | None = None, **columns: str,
) -> DataFrame:
    """Read parquet, orc, json, csv or text into the message schema."""
    reader = spark.read.format(format).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    return as_messages(reader.load(path), **columns)


def stream_messages(
    spark: SparkSession, path: str | None = None, format: str = "parquet",
    schema: T.StructType | str | None = None, options: dict | None = None, **columns: str,
) -> DataFrame:
    """The same over a stream: files, or any source on the class path such as Kafka."""
    reader = spark.readStream.format(format).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    return as_messages(reader.load(path) if path else reader.load(), **columns)


def write_spans(spans: DataFrame, path: str, mode: str = "append") -> None:
    """Spans in row form, partitioned by type.

    Rows are clustered by type and a salt first, so a frequent type is written by many
    tasks and a rare one does not leave a file in every task.
    """
    salted = spans.withColumn("_salt", F.pmod(F.xxhash64(*spans.columns), F.lit(64)))
    (
        salted.repartition("type", "_salt")
        .drop("_salt")
        .write.mode(mode)
        .partitionBy("type")
        .parquet(path)
    )


def write_audit(audit: DataFrame, path: str) -> None:
    audit.select([f.name for f in AUDIT]).write.mode("append").parquet(path)


def export_audit(audit: DataFrame, path: str) -> None:
    audit.select([f.name for f in AUDIT]).write.mode("overwrite").json(path)


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The rule pack as a table, to edit and store."""
    rows = [
        (r.type, r.pattern, r.confidence, r.order, r.shape, list(r.needs), r.name, r.family, r.guard)
        for r in rules
    ]
    return spark.createDataFrame(rows, RULES)


def load_rules(df: DataFrame, limit: int = 10_000) -> list[Rule]:
    """Rules from a table. Patterns must be literals in the plan, so the rows come to the
    driver; a table of more than ``limit`` rules is refused rather than cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rules")
    return sorted(
        (
            Rule(
                r["type"], r["pattern"], r["confidence"], r["order"], r["shape"],
                tuple(r["needs"] or ()), r["name"] or "", r["family"], r["guard"] or "true",
            )
            for r in rows
        ),
        key=lambda r: r.order,
    )


def add_rule(
    rules: Sequence[Rule], type_: str, pattern: str, confidence: float | str = 0.9,
    words: Sequence[str] = (), order: int = 1000,
) -> list[Rule]:
    """A user-defined rule: a pattern and, optionally, words that must come before it."""
    from maskwell.functions.sqltext import contains_any

    score = confidence if isinstance(confidence, str) else f"{confidence}D"
    if words:
        score = f"CASE WHEN {contains_any('hit.context', words)} THEN {score} END"
    return [*rules, Rule(type_, pattern, score, order, needs=tuple(w.lower() for w in words))]
