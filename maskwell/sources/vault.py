"""Encrypted store of session maps, in pages. The caller supplies the key (16, 24 or 32 bytes).

A session's map is cut into pages of a bounded number of placeholders, each sealed by itself, so a large session is
spread over tasks and files. What a page belongs to (session, label, number, size of the map and time) is
authenticated with it: a page put in another's place, or taken from an older state, does not open. The key reaches the
expressions as the result of a one-row subquery, so plans, their texts and logs do not show it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.operators.mask import PAGE, map_to_pages

VAULT = "session_id string, label string, page int, last int, blob binary, created_at timestamp"
BELONGS = ("session_id", "label", "page", "last")


def _key(spark: SparkSession, key: bytes) -> Column:
    return spark.createDataFrame([(bytearray(key),)], "key binary").scalar()


def _belongs() -> Column:
    return F.to_json(F.struct(*BELONGS, F.unix_micros("created_at").alias("at")))


def seal(pages: DataFrame, key: bytes, created_at: Column | None = None) -> DataFrame:
    """Authenticated encryption of pages; the initialisation vector is random and part of the blob."""
    when = F.current_timestamp() if created_at is None else created_at
    timed = pages.select(*BELONGS, "snapshot", when.alias("created_at"))
    blob = F.aes_encrypt(
        F.to_json("snapshot"), _key(pages.sparkSession, key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray()), _belongs()
    )
    return timed.select(*BELONGS, blob.alias("blob"), "created_at")


def unseal(vault: DataFrame, key: bytes) -> DataFrame:
    """The pages again; one that does not open has a NULL snapshot."""
    plain = F.try_aes_decrypt("blob", _key(vault.sparkSession, key), F.lit("GCM"), F.lit("DEFAULT"), _belongs()).cast("string")
    return vault.select(*BELONGS, F.from_json(plain, "map<string,string>").alias("snapshot"), "created_at")


def write_vault(placeholder_map: DataFrame, path: str, key: bytes, mode: str = "append", size: int = PAGE) -> None:
    seal(map_to_pages(placeholder_map, size=size), key).write.mode(mode).parquet(path)


def read_vault(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """The pages of the newest state of each session."""
    stored = spark.read.schema(VAULT).parquet(path)
    newest = stored.groupBy(F.col("session_id").alias("of")).agg(F.max("created_at").alias("newest"))
    same = stored["session_id"].eqNullSafe(newest["of"]) & (stored["created_at"] == newest["newest"])
    return unseal(stored.join(newest, same, "left_semi"), key)


def vault_state(pages: DataFrame) -> DataFrame:
    """Per session and label: pages, those that opened, the map's size and whether all of it is there."""
    entries = F.coalesce(F.size("snapshot") - 1, F.lit(0))
    return (
        pages.groupBy("session_id", "label")
        .agg(
            F.count("*").alias("pages"),
            F.count("snapshot").alias("opened"),
            F.max("last").alias("last"),
            F.sum(entries).alias("entries"),
        )
        .select("session_id", "label", "pages", "opened", "last", (F.col("entries") == F.col("last")).alias("complete"))
    )
