"""Dumps of server-sent event streams as files.

The text reader cuts files at blank lines, so a record is one frame and a large file is read by many tasks. Frames are
put in order over the splits of a file by its path and where the split begins; inside a split they come in order. The
number of the frames before a split, and the answer that was open at its start, are carried from split to split as one
row each. An answer is therefore never one string in one row, however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwell.operators import chatlogs
from maskwell.sources.tables import saved

#: A comment that says whose answer follows: its id and the provider.
HEADER = r"(?m)^: ?answer ([^\s]+) ([^\s]+)\r?$"
BLANK_LINE = "\n\n"


def _frames(reader, path: str, separator: str) -> DataFrame:
    """The records of files: frame, file, and where the split begins."""
    lines = reader.option("lineSep", separator).text(path)
    return lines.select(
        F.col("value").alias("frame"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def _in_order(frames: DataFrame) -> DataFrame:
    """The frames as a table with ``at``, which rises within a split, as the reader meets them."""
    return saved(frames.withColumn("at", F.monotonically_increasing_id()), "frames")


def events_of(frames: DataFrame, header: str = HEADER) -> DataFrame:
    """file, response_id, provider, seq, event, data, id, retry of a table of frames in order.

    ``seq`` counts the frames of a file. Frames before the first header belong to no answer: their id is NULL. Frames
    without data are dropped once they are counted.
    """
    named = F.when(
        F.col("frame").rlike(header),
        F.struct(F.regexp_extract("frame", header, 1).alias("id"), F.regexp_extract("frame", header, 2).alias("provider")),
    )
    told = frames.withColumn("told", named)
    split = ["file", "block"]
    splits = told.groupBy(*split).agg(F.count("*").alias("n"), F.max_by("told", F.when(F.col("told").isNotNull(), F.col("at"))).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = splits.select(
        *split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("passed"),
        F.last("last", ignorenulls=True).over(before).alias("open"),
    )
    inside = Window.partitionBy(*split).orderBy("at")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = told.select(
        *split, "frame", (F.row_number().over(inside) - 1).alias("here"), F.last("told", ignorenulls=True).over(so_far).alias("own")
    )
    whose = F.coalesce("own", "open")
    numbered = placed.join(carried, split).select(
        "file", whose["id"].alias("response_id"), whose["provider"].alias("provider"),
        (F.col("passed") + F.col("here")).alias("seq"), "frame",
    )
    return chatlogs.parsed_frames(numbered, ["file", "response_id", "provider"])


def read_event_files(spark: SparkSession, path: str, header: str = HEADER, separator: str = BLANK_LINE) -> DataFrame:
    """Events of all files below ``path``."""
    return events_of(_in_order(_frames(spark.read, path, separator)), header)


def stream_event_files(
    spark: SparkSession, path: str, out: str, checkpoint: str, header: str = HEADER, separator: str = BLANK_LINE,
    files_per_batch: int | None = None,
):
    """Start writing the events of files that arrive below ``path`` to ``out``, one folder a batch.

    A file is read whole in one batch, so its splits are in one table. A batch that is repeated after a failure
    replaces its folder. Read ``out`` with ``spark.read.parquet``.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, number: int) -> None:
        events_of(_in_order(batch), header).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return (
        _frames(reader, path, separator)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def assembled(events: DataFrame) -> DataFrame:
    """Answers of events with their ids; frames that belong to none are left out."""
    known = events.where("response_id IS NOT NULL")
    return chatlogs.assemble_responses(known, ("file", "response_id", "provider"))
