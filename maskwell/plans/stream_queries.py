"""Stream queries: the given tables read as streams and processed until nothing is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwell.operators import chatlogs, policy
from maskwell.operators import detect as det
from maskwell.plans import chat_queries as chat
from maskwell.plans import content_queries as content
from maskwell.streaming import live


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    )


def _spans(spark, sf_dir):
    messages = chat.as_chat(stream_of(spark, sf_dir, "orders")).withColumn(
        "session_id", F.col("session_id").cast("string")
    )
    return live.scan_stream(messages, types=chat.TYPES, phrases=False)


def stream_scan(spark, sf_dir):
    rows = det.explode_spans(_spans(spark, sf_dir), "spans", "doc_id").select(
        "doc_id", "type", "value", "start", "end", F.round("confidence", 4).alias("confidence")
    )
    return live.run_once(rows, "scan")


def stream_audit(spark, sf_dir):
    chosen = _spans(spark, sf_dir).withColumn("choice", F.when(F.col("doc_id") % 3 == 0, "send"))
    return live.run_once(live.audit_stream(policy.decide(chosen, choice="choice")), "audit")


def _clock(like: DataFrame, ts: str, **filled) -> DataFrame:
    """One row that says only how late it is: it closes what waits for its watermark."""
    named = {f.name: F.lit(filled.get(f.name)).cast(f.dataType) for f in like.schema}
    named["ts"] = F.lit(ts).cast("timestamp")
    return like.sparkSession.range(1).select(*[named[f.name].alias(f.name) for f in like.schema])


def stream_latest_versions(spark, sf_dir):
    """Turns as drafts of their conversation: the newest come first, a third of the others is sent again late.

    The repeated drafts carry the time of their sending, so the watermark lets them pass and only the remembered
    version keeps them out.
    """
    drafts = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("version"), "text",
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60).alias("ts"),
    )
    newest = F.max("version").over(Window.partitionBy("doc_id"))
    late = (F.col("version") < newest) & ((F.col("version") + F.col("doc_id")) % 3 == 0)
    drafts = drafts.withColumn("late", late)
    again = drafts.where("late").withColumn("ts", F.lit("2023-11-15 07:00:00").cast("timestamp"))
    waves = [
        drafts.where("NOT late").drop("late"),
        _clock(drafts.drop("late"), "2023-11-15 06:00:00"),
        again.drop("late"),
        _clock(drafts.drop("late"), "2023-12-01"),
    ]
    return live.in_waves(spark, "versions", waves, lambda s: live.latest_versions(s, late="1 minute")).rows()


#: Messages of the second wave.
_LATE_KEY = "doc_id % 10 = 0"


def stream_daily_counts(spark, sf_dir):
    """Every tenth message arrives after the others: what the watermark has passed by then is not counted.

    The last message closes all days but its own.
    """
    messages = chat.as_chat(spark.read.parquet(f"{sf_dir}/orders.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.expr(_LATE_KEY)
    waves = [messages.where(~late), messages.where(late), _clock(messages, "2100-01-01", text="my ssn is 234-56-7890")]

    def counted(stream):
        return live.daily_counts(live.scan_stream(stream, types=chat.TYPES, phrases=False))

    rows = live.in_waves(spark, "daily", waves, counted).rows()
    return rows.select(F.col("date").cast("string").alias("date"), "type", "n")


def stream_session_numbers(spark, sf_dir):
    """Turns in two waves, each session's later turns in the second; the numbers live for a day."""
    messages = chat.as_chat(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    middle = F.avg("turn").over(Window.partitionBy("session_id"))
    messages = messages.withColumn("later", F.col("turn") > middle)

    def numbered(stream):
        found = live.scan_stream(stream, types=chat.TYPES, phrases=False)
        return live.session_numbers(det.explode_spans(found, "spans", "session_id", "turn"))

    waves = [messages.where("NOT later").drop("later"), messages.where("later").drop("later")]
    return live.in_waves(spark, "numbers", waves, numbered, by_event=False).rows()


def stream_answers(spark, sf_dir):
    """Events in two waves; every seventh answer lacks its end and is given out at the timeout."""
    told = content.as_streams(content.as_talk(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    events = chatlogs.sse_events(told).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    ended = chatlogs.is_stream_complete(events)
    last = F.min(F.when(F.col("complete"), F.col("seq"))).over(Window.partitionBy("response_id"))
    events = ended.withColumn("last", last).where("response_id % 7 <> 0 OR seq < last").drop("last", "complete")
    waves = [
        events.where("seq < 2"),
        events.where("seq >= 2"),
        _clock(events, "2100-01-01"),
    ]
    rows = live.in_waves(spark, "answers", waves, lambda s: live.assemble_stream(s, late="1 hour")).rows()
    return rows.select(F.col("response_id").cast("long").alias("response_id"), "text", "complete")


def stream_queries() -> dict:
    return {
        f.__name__: f
        for f in (
            stream_scan, stream_audit, stream_latest_versions, stream_daily_counts, stream_session_numbers,
            stream_answers,
        )
    }


def stream_oracles() -> dict[str, str]:
    batch = chat.chat_oracles()
    answers = "conv_id * 1000 + turn"
    late = f"c.{_LATE_KEY}"
    return {
        "stream_scan": batch["scan_rows"],
        "stream_audit": batch["audit_rows"],
        "stream_latest_versions": "SELECT conv_id AS doc_id, max(turn) AS version, max_by(text, turn) AS text FROM conversations GROUP BY conv_id",
        "stream_daily_counts": f"""{chat.WITH}, seen AS (SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 1 DAY AS mark FROM chat c WHERE NOT ({late}))
            SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, type, count(*) AS n FROM sp c, seen
            WHERE NOT ({late}) OR CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY > mark GROUP BY ALL""",
        "stream_session_numbers": batch["assign_placeholders"],
        "stream_answers": f"""SELECT {answers} AS response_id, regexp_replace(text, '\\s+', '_', 'g') AS text, ({answers}) % 7 <> 0 AS complete
            FROM conversations WHERE length(text) > 0""",
    }
