"""Incremental folds: streams of events into derived tables, exactly once and equal to a batch over everything."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenlog.functions.shared import file_system, names_in
from lumenlog.operators.metrics import fault_signature, merged_ledger, request_ledger


def ledger_fold(stream: DataFrame, path: str, checkpoint: str, measures: list[str]) -> StreamingQuery:
    """Fold each micro-batch into versions of the request ledger under `path`; a repeated batch writes the same version.

    MAX and MIN merge, so late and repeated rows are accepted without a watermark. A version is complete before the next
    batch begins; readers take the newest.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0:
            whole = request_ledger(batch, measures)
        else:
            whole = merged_ledger(spark.read.parquet(f"{path}/v={batch_id - 1}"), batch, measures)
        whole.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        # The version before the one that was read can't be needed again, even if this batch is repeated.
        files, old = file_system(spark, f"{path}/v={batch_id - 2}")
        files.delete(old, True)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_ledger(spark: SparkSession, path: str) -> DataFrame:
    whole = [int(n[2:]) for n in names_in(spark, path) if n.startswith("v=") and "_SUCCESS" in names_in(spark, f"{path}/{n}")]
    return spark.read.parquet(f"{path}/v={max(whole)}")


def activity_stream(stream: DataFrame, thread: str, at: str) -> DataFrame:
    """Update-mode first and last time of each thread, without a watermark: late rows count."""
    return stream.groupBy(thread).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def windowed_counts(stream: DataFrame, at: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts in tumbling windows with a watermark, as an extension to the folds."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key over the whole stream; state grows with the keys."""
    return stream.dropDuplicates(keys)


def with_turns(stream: DataFrame) -> DataFrame:
    """(thread_id, event_id, turn_no) with the turn carried across batches; each batch is ordered by event_id."""

    def carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("event_id")
        turn = state.get[0] if state.exists else 0
        numbers = turn + (rows["role"] == "user").cumsum()
        state.update((int(numbers.iloc[-1]),))
        yield pd.DataFrame({"thread_id": rows["thread_id"], "event_id": rows["event_id"], "turn_no": numbers.astype("int64")})

    return stream.groupBy("thread_id").applyInPandasWithState(carry, "thread_id long, event_id long, turn_no long", "turn long", "append", GroupStateTimeout.NoTimeout)


def poll(sources: dict[str, Callable[[], StreamingQuery]]) -> dict[str, str | None]:
    """Run each source's query over what is new, in order; the error of each that failed, which keeps no other from running.
    A query reads with trigger availableNow, and its checkpoint tells what it has read."""
    out: dict[str, str | None] = {}
    for name, start in sources.items():
        try:
            start().awaitTermination()
            out[name] = None
        except Exception as e:  # one source's failure is its own; it is reported, and tried again at the next poll
            out[name] = f"{name}: {str(e)[:300]}"
    return out


def fault_counts(stream: DataFrame, message: str = "message") -> DataFrame:
    """(signature, count) of faults whenever a signature's count reaches one, ten, a hundred, ...: enough to tell a blip from
    an outage, and few rows. The count is kept across batches."""

    def tally(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        after = before + sum(len(b) for b in batches)
        state.update((after,))
        reached = [10**k for k in range(len(str(after))) if before < 10**k <= after]
        yield pd.DataFrame({"signature": [key[0]] * len(reached), "count": reached})

    signed = stream.select(fault_signature(F.col(message)).alias("signature"))
    return signed.groupBy("signature").applyInPandasWithState(tally, "signature string, count long", "n long", "append", GroupStateTimeout.NoTimeout)


def pending(docs: DataFrame, done: DataFrame, key: str = "doc_id", most: int | None = None) -> DataFrame:
    """Documents that have no vector yet, the newest first, at most as many as one drain takes."""
    left = docs.join(done.select(key), key, "left_anti").orderBy(F.desc(key))
    return left if most is None else left.limit(most)


def embedded(docs: DataFrame, embedder: Callable[[], Callable[[list[str]], list]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, vec) by an embedder: a function that loads a model once a task and gives one that embeds a batch of texts."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = embedder()
        for batch in it:
            yield pd.DataFrame({key: batch[key], "vec": [[float(x) for x in v] for v in embed(batch[text].tolist())]})

    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text)).mapInPandas(run, f"{key} long, vec array<float>")


def drain(docs: DataFrame, path: str, embedder, batch: int, key: str = "doc_id", text: str = "text", most: int = 10_000) -> None:
    """Embed the newest documents that have no vector under `path`, as one part that a repeated drain writes again."""
    spark = docs.sparkSession
    parts = [n for n in names_in(spark, path) if n.startswith("part=") and n != f"part={batch}"]
    done = spark.read.option("basePath", path).parquet(*[f"{path}/{n}" for n in parts]) if parts else spark.createDataFrame([], f"{key} long")
    embedded(pending(docs, done, key, most), embedder, key, text).write.mode("overwrite").parquet(f"{path}/part={batch}")
