"""Sinks: the sharded thread log, and blobs taken out of payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions.ids import shard


def write_thread_log(events: DataFrame, path: str, thread: str = "thread_id", depth: int = 1, batch: int = 0) -> None:
    """Write a batch of events in folders by the hash of their thread, clustered so that a thread's rows share files. A batch
    has a folder of its own, so one that is written again takes its own place instead of doubling rows."""
    placed = events.withColumn("shard", shard(F.col(thread), depth)).repartition("shard").sortWithinPartitions(thread)
    placed.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/batch={batch}")


def append_rows(rows: DataFrame, path: str, batch: int, most_rows: int = 1_000_000) -> None:
    """Append rows to a ledger of JSON lines as the segment of a batch, in files of at most `most_rows`; written again, a
    segment replaces itself."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", most_rows).json(f"{path}/segment={batch:010d}")


def save_vectors(vectors: DataFrame, path: str, space: str) -> None:
    """Keep embeddings of one model's space; those of other spaces stay as they are."""
    vectors.write.mode("overwrite").parquet(f"{path}/space={space}")


def load_vectors(spark: SparkSession, path: str, space: str) -> DataFrame:
    return spark.read.parquet(f"{path}/space={space}")


def extract_blobs(rows: DataFrame, data: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the hash and size of their base64 `data` in its place, and the distinct blobs (blob_hash, blob)."""
    raw = F.try_to_binary(data, F.lit("base64"))
    named = rows.withColumn("blob_hash", F.sha2(raw, 256)).withColumn("blob_bytes", F.octet_length(raw))
    blobs = rows.select(F.sha2(raw, 256).alias("blob_hash"), raw.alias("blob")).filter("blob is not null").dropDuplicates(["blob_hash"])
    return named.drop(data), blobs


def restore_blobs(named: DataFrame, blobs: DataFrame, data: str) -> DataFrame:
    return named.join(blobs, "blob_hash", "left").withColumn(data, F.base64("blob")).drop("blob", "blob_hash", "blob_bytes")
