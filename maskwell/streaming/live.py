"""Continuous scans and stateful operators.

Scanning, masking per message and audit rows keep no state: the batch operators run on a
stream unchanged. State is kept for three things: the newest version of a text, the
numbering of a session, and answers that are still arriving.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from maskwell.operators import chatlogs, mask, policy
from maskwell.operators.detect import detect_spans, drop_excluded

QUIET_MS = 500
MAP_TTL_HOURS = 24
ANSWER_TIMEOUT_MS = 30_000
#: How long a document may be silent before its version number is forgotten.
VERSION_MEMORY_MS = 24 * 3600 * 1000
#: Stands for a missing version and is older than any.
NO_VERSION = -(2**63)
#: Groups of sessions that are numbered together; part of a checkpoint's layout.
SESSION_BUCKETS = 1024
#: Groups of answers that wait together, and answers that one row of the state names; part of a checkpoint's layout.
ANSWER_BUCKETS = 1024
ANSWERS_A_PAGE = 1000
PROVIDER_CLASS = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def checkpoint_dir(spark, name: str) -> str:
    """A folder below the one the cluster names; a temporary one in local mode only, where every task can see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="run-")
    import uuid

    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scan_stream(messages: DataFrame, **options) -> DataFrame:
    """The same columns as the batch scan, row by row."""
    return drop_excluded(detect_spans(messages, **options))


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own for operators that need the RocksDB state store; nothing of the caller's changes.

    Settings made at run time are taken over, which a new session does not do by itself.
    """
    own = spark.newSession()
    for name, value in dict(spark.conf.getAll).items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set(PROVIDER_CLASS, ROCKSDB)
    return own


def latest_versions(
    drafts: DataFrame, quiet_ms: int = QUIET_MS, remember_ms: int = VERSION_MEMORY_MS, late: str | None = None
) -> DataFrame:
    """The newest text of each document once it has been left alone for a moment. Needs the RocksDB state store.

    ``drafts`` has ``doc_id``, ``version`` and ``text``. A document is given out ``quiet_ms`` after its newest
    version, and again whenever a newer one has come to rest. Versions never go back: the number of the newest one
    outlives its text, so an older draft that arrives after the text was given out is dropped, until the document has
    been silent for ``remember_ms``. Equal versions: the greatest text of a batch, and the first batch, count.

    With ``late`` time is that of the column ``ts`` and moves with its watermark, that much behind; without it time is
    the clock's. Rows without a version are ignored, rows without an id only move the watermark, and a draft without a
    time is as old as can be.
    """
    by_event = late is not None
    kind = dict(drafts.dtypes)["doc_id"]
    rows = drafts.withWatermark("ts", late) if by_event else drafts
    at = F.coalesce(F.unix_millis("ts"), F.lit(0)) if by_event else F.lit(0).cast("long")
    rows = rows.select(
        "doc_id", F.coalesce(F.col("version").cast("long"), F.lit(NO_VERSION)).alias("version"), "text",
        at.alias("at"), *(["ts"] if by_event else []),
    )

    class Newest(StatefulProcessor):
        """``waiting`` is the text to give out; ``seen`` the newest version, which stays when the text has gone."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getValueState("waiting", "version long, text string, due long")
            # State can expire by itself only on the clock; by event time a timer does the same.
            self.seen = handle.getValueState("seen", "version long, forget long", None if by_event else remember_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            newest = None
            for batch in rows:
                for version, text, at in zip(batch["version"], batch["text"], batch["at"]):
                    row = (int(version), text is not None, text or "", int(at))
                    newest = row if newest is None or row > newest else newest
            if newest is None or pd.isna(key[0]) or newest[0] == NO_VERSION:
                return
            seen = self.seen.get() if self.seen.exists() else None
            if seen is not None and newest[0] <= seen[0]:
                return
            now = newest[3] if by_event else timerValues.getCurrentProcessingTimeInMs()
            if self.waiting.exists():
                self.handle.deleteTimer(self.waiting.get()[2])
            if by_event:
                if seen is not None:
                    self.handle.deleteTimer(seen[1])
                self.handle.registerTimer(now + quiet_ms + remember_ms)
            self.handle.registerTimer(now + quiet_ms)
            self.waiting.update((newest[0], newest[2] if newest[1] else None, now + quiet_ms))
            self.seen.update((newest[0], now + quiet_ms + remember_ms))
            return
            yield

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = expiredTimerInfo.getExpiryTimeInMs()
            if self.waiting.exists() and self.waiting.get()[2] <= now:
                version, text, _ = self.waiting.get()
                self.waiting.clear()
                yield pd.DataFrame({"doc_id": [key[0]], "version": [version], "text": [text]})
            if by_event and self.seen.exists() and self.seen.get()[1] <= now:
                self.seen.clear()

        def close(self) -> None:
            pass

    return rows.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=Newest(),
        outputStructType=f"doc_id {kind}, version long, text string",
        outputMode="append",
        timeMode="eventTime" if by_event else "processingTime",
    )


def session_numbers(spans: DataFrame, ttl_hours: float | None = MAP_TTL_HOURS, buckets: int = SESSION_BUCKETS) -> DataFrame:
    """New placeholders as they appear. Needs the RocksDB state store.

    ``spans`` is in row form with session, turn, start, type and value. Numbers follow
    (turn, start) within a batch; batches are numbered in the order they come. Sessions and labels share ``buckets``
    groups, which must stay the same for the life of a checkpoint: a group costs a Python worker some milliseconds,
    whatever it holds, and most sessions are small. The class is local so that it travels to the workers with the
    plan. Without ``ttl_hours`` nothing is forgotten.
    """

    class SessionNumbers(StatefulProcessor):
        """Numbers of the values of the sessions and labels of a bucket, forgotten after a day."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            life = int(ttl_hours * 3600 * 1000) if ttl_hours else None
            self.known = handle.getMapState("known", "session string, label string, value string", "n int", life)
            self.last = handle.getMapState("last", "session string, label string", "n int", life)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            firsts: dict[tuple, dict[str, tuple]] = {}
            for batch in rows:
                # Only first sightings are kept while reading.
                columns = (batch[c] for c in ("session_id", "label", "value", "turn", "start"))
                for session, label, value, turn, start in zip(*columns):
                    seen, at = firsts.setdefault((session, label), {}), (turn, start)
                    if value not in seen or at < seen[value]:
                        seen[value] = at
            out = []
            for (session, label), seen in firsts.items():
                before = count = self.last.getValue((session, label))[0] if self.last.containsKey((session, label)) else 0
                for value in sorted(seen, key=lambda v: (*seen[v], v)):
                    # Without a number yet, nothing of the session is known.
                    if not before or not self.known.containsKey((session, label, value)):
                        count += 1
                        self.known.updateValue((session, label, value), (count,))
                        out.append((session, label, value, count, f"[{label}_{count}]"))
                self.last.updateValue((session, label), (count,))
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=columns_out)
                    out = []
            yield pd.DataFrame(out, columns=columns_out)

        def close(self) -> None:
            pass

    columns_out = ["session_id", "label", "value", "n", "placeholder"]
    bucket = F.pmod(F.xxhash64("session_id", "label"), F.lit(buckets)).cast("int").alias("bucket")
    return mask.with_label(spans).select(
        bucket, F.col("session_id").cast("string").alias("session_id"), "label", "value", "turn", "start"
    ).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=SessionNumbers(),
        outputStructType="session_id string, label string, value string, n int, placeholder string",
        outputMode="append",
        timeMode="processingTime" if ttl_hours else "none",
    )


def daily_counts(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """Findings per day and type. The watermark decides when a day is final."""
    timed = messages.withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        timed.withWatermark("ts", late)
        .select("ts", F.explode(F.col("spans.type")).alias("type"))
        .groupBy(F.window("ts", "1 day").alias("day"), "type")
        .agg(F.count("*").alias("n"))
        .select(F.to_date("day.start").alias("date"), "type", "n")
    )


def assemble_stream(
    events: DataFrame, timeout_ms: int = ANSWER_TIMEOUT_MS, late: str | None = None, buckets: int = ANSWER_BUCKETS
) -> DataFrame:
    """Answers put together as their events arrive, given out at the end marker or timeout. Needs RocksDB.

    Pieces are kept as rows of the state and joined by ``seq`` when an answer is given out. An answer is complete if
    its end marker came. A closed answer is remembered until the timeout, so stragglers are ignored; then nothing of
    it is left. Time is the clock's, or with ``late`` that of the column ``ts``. Rows without an id only move the
    watermark. Answers share ``buckets`` groups, which must stay the same for the life of a checkpoint: a group costs
    a Python worker some milliseconds, and most answers are short. A worker holds a bucket's share of a batch.
    """
    by_event = late is not None
    judged = chatlogs.is_stream_complete(chatlogs.extract_response_delta(events))
    judged = judged.withWatermark("ts", late) if by_event else judged
    at = F.coalesce(F.unix_millis("ts"), F.lit(0)) if by_event else F.lit(0).cast("long")
    bucket = F.pmod(F.xxhash64("response_id", "provider"), F.lit(buckets)).cast("int").alias("bucket")
    judged = judged.withColumn("response_id", F.col("response_id").cast("string")).select(
        bucket, "response_id", "provider", F.col("seq").cast("long").alias("seq"), "delta", "complete",
        at.alias("at"), *(["ts"] if by_event else []),
    )
    columns_out = ["response_id", "provider", "text", "complete"]

    class Answers(StatefulProcessor):
        """The pieces of a bucket's answers, until when each is remembered, and which to look at when a timer ends."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            answer = "response_id string, provider string"
            #: What a batch brought of an answer: pieces as JSON, by the number of the batch that brought some.
            self.parts = handle.getMapState("parts", f"{answer}, n int", "pieces string")
            self.ends = handle.getMapState("ends", answer, "closed boolean, due long, n int")
            #: Answers by the time they were due at when they were written down, in pages; they may be due later now.
            self.pages = handle.getMapState("pages", "due long", "n int")
            self.waiting = handle.getMapState("waiting", "due long, page int", "answers string")

        def taken(self, answer: tuple, n: int) -> list[tuple]:
            """The pieces of an answer, which leave the state."""
            out = []
            for i in range(n):
                out += [(seq, delta) for seq, delta in json.loads(self.parts.getValue((*answer, i))[0])]
                self.parts.removeKey((*answer, i))
            return out

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            # Of an answer: pieces, end, newest time.
            news: dict[tuple, list] = {}
            for batch in rows:
                columns = (batch[c] for c in ("response_id", "provider", "seq", "delta", "complete", "at"))
                for response, provider, seq, delta, complete, at in zip(*columns):
                    if pd.isna(response):
                        continue
                    answer = (response, None if pd.isna(provider) else provider)
                    new = news.setdefault(answer, [[], None, 0])
                    new[2] = max(new[2], int(at))
                    if complete and (new[1] is None or seq < new[1]):
                        new[1] = int(seq)
                    if isinstance(delta, str):
                        new[0].append((int(seq), delta))
            out, dues = [], {}
            clock = None if by_event else timerValues.getCurrentProcessingTimeInMs()
            for answer, (new, end, latest) in news.items():
                known = self.ends.getValue(answer) if self.ends.containsKey(answer) else None
                closed, before, n = known or (False, None, 0)
                if closed:
                    continue
                due = max((latest if by_event else clock) + timeout_ms, before or 0)
                if due != before:
                    dues.setdefault(due, []).append(answer)
                if end is not None:
                    text = "".join(delta for seq, delta in sorted([*self.taken(answer, n), *new]) if seq <= end)
                    n = 0
                    if text:
                        out.append((*answer, text, True))
                elif new:
                    self.parts.updateValue((*answer, n), (json.dumps(new),))
                    n += 1
                self.ends.updateValue(answer, (end is not None, due, n))
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=columns_out)
                    out = []
            for due, answers in dues.items():
                page = self.pages.getValue((due,))[0] if self.pages.containsKey((due,)) else 0
                if not page:
                    self.handle.registerTimer(due)
                for i in range(0, len(answers), ANSWERS_A_PAGE):
                    self.waiting.updateValue((due, page), (json.dumps(answers[i : i + ANSWERS_A_PAGE]),))
                    page += 1
                self.pages.updateValue((due,), (page,))
            yield pd.DataFrame(out, columns=columns_out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            due = expiredTimerInfo.getExpiryTimeInMs()
            if not self.pages.containsKey((due,)):
                return
            for page in range(self.pages.getValue((due,))[0]):
                out = []
                for answer in map(tuple, json.loads(self.waiting.getValue((due, page))[0])):
                    known = self.ends.getValue(answer) if self.ends.containsKey(answer) else None
                    # One that went on is named again under its later time.
                    if known is None or known[1] > due:
                        continue
                    text = "".join(delta for _, delta in sorted(self.taken(answer, known[2])))
                    if text:
                        out.append((*answer, text, False))
                    self.ends.removeKey(answer)
                self.waiting.removeKey((due, page))
                yield pd.DataFrame(out, columns=columns_out)
            self.pages.removeKey((due,))

        def close(self) -> None:
            pass

    return judged.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Answers(),
        outputStructType="response_id string, provider string, text string, complete boolean",
        outputMode="append",
        timeMode="eventTime" if by_event else "processingTime",
    )


def audit_stream(decided: DataFrame) -> DataFrame:
    """Audit rows of decided messages, as they come."""
    return policy.valid_audit(policy.audit_rows(decided))


def run_once(df: DataFrame, name: str) -> DataFrame:
    """Process what is there, write it as a table below the checkpoint folder and read it."""
    return Run(df.sparkSession, name).more(df).rows()


class Run:
    """A stream that is started again whenever there is more to read, with one checkpoint and one result table."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, checkpoint_dir(spark, name)
        self.schema = None
        self.progress: list = []

    def more(self, df: DataFrame) -> Run:
        """Process what has come since the last time."""
        self.schema = df.schema
        query = (
            df.writeStream.format("parquet")
            .option("path", f"{self.base}/rows")
            .option("checkpointLocation", f"{self.base}/state")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        self.progress += query.recentProgress
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/rows")

    def state_rows(self) -> int:
        """Rows in the state after the last batch."""
        return sum(operator["numRowsTotal"] for operator in self.progress[-1]["stateOperators"])


def in_waves(
    spark: SparkSession, name: str, waves: list[DataFrame], stream: Callable[[DataFrame], DataFrame], by_event: bool = True
) -> Run:
    """Let tables arrive one after the other, each in a run of its own, so that state and watermarks carry over.

    ``stream`` makes the result of the streaming table. The runs use a session with the RocksDB state store. On the
    clock an operator asks for batches without data for ever, so only event time gets them.
    """
    own = stateful_session(spark)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(by_event).lower())
    folder = checkpoint_dir(spark, f"{name}-in")
    run = Run(own, name)
    for wave in waves:
        wave.write.mode("append").parquet(folder)
        run.more(stream(own.readStream.schema(waves[0].schema).parquet(folder)))
    run.spark = spark
    return run
