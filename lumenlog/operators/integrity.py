"""Scopes, reconciliation of two stores, repair and migration, and what lies on disk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions.ids import shard
from lumenlog.functions.query import time_bound


def scan_window(rows: DataFrame, newest: int, key: str = "event_id") -> DataFrame:
    """Rows whose id is within the `newest` last ids: the bound is read once, and reaches the scan as a filter."""
    top = rows.agg(F.max(key)).first()[0]
    return rows if top is None else rows.filter(F.col(key) > top - newest)


def scoped(
    rows: DataFrame, threads: DataFrame, *, thread: str | None = None, ids: list | None = None, sources: list[str] | None = None, types: list[str] | None = None, kinds: list[str] | None = None,
    without_kinds: list[str] | None = None, tool: str | None = None, since: str | None = None, until: str | None = None, now=None, agents: bool = False, at: str = "occurred_at",
) -> DataFrame:
    """Rows (thread_id, content_type, tool_name, `at`) within a search's scopes; threads: id, source, thread_type, hidden.

    Without a named thread, hidden threads and, unless `agents`, those of type system are left out; naming one brings
    it in whatever it is. Rows without a time are in no window. Bounds are ages or ISO times, and inclusive.
    """
    found = rows
    if thread is not None:
        found = found.filter(F.col("thread_id") == thread)
    else:
        barred = F.col("hidden") if agents else F.col("hidden") | (F.col("thread_type") == "system")
        found = found.join(threads.filter(barred & F.col("id").isNotNull()).select(F.col("id").alias("thread_id")), "thread_id", "left_anti")
    if ids is not None:
        found = found.filter(F.col("thread_id").isin(ids))
    wanted = [F.col(c).isin(v) for c, v in (("source", sources), ("thread_type", types)) if v]
    if wanted:
        found = found.join(threads.filter(reduce(lambda a, b: a & b, wanted)).select(F.col("id").alias("thread_id")), "thread_id", "left_semi")
    checks = [F.col("content_type").isin(kinds)] if kinds else []
    checks += [~F.col("content_type").isin(without_kinds)] if without_kinds else []
    checks += [F.col("tool_name") == tool] if tool else []
    bound = lambda value: F.lit(f"{time_bound(value, now):%Y-%m-%d %H:%M:%S.%f}").cast("timestamp_ntz")
    time = F.col(at).cast("timestamp_ntz")
    checks += [time >= bound(since)] if since else []
    checks += [time <= bound(until)] if until else []
    return reduce(DataFrame.filter, checks, found)


def in_time(rows: DataFrame, at: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Rows in a window of time; those without a time are in none, even an open one."""
    found = rows.filter(F.col(at).isNotNull())
    found = found if since is None else found.filter(F.col(at) >= since)
    return found if until is None else found.filter(F.col(at) <= until)


def short_of(docs: DataFrame, parts: DataFrame, key: str, needed: Column) -> DataFrame:
    """Documents with fewer parts than they need, with the number they have."""
    have = parts.groupBy(key).agg(F.count(F.lit(1)).alias("have"))
    return docs.withColumn("needed", needed).join(have, key, "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < needed")


def open_findings(rows: DataFrame, resolved: DataFrame, by: str, item: str, at: Column, since: Column, grace: Column) -> DataFrame:
    """Per `by`: findings in the window, those that count (not advisory), those resolved (their item has a resolution at or
    after them), deferred (additive, and their item's first open finding is within the grace), and due.

    rows: by, item, advisory, additive; resolved: by, item, through.
    """
    latest = resolved.groupBy(by, item).agg(F.max("through").alias("__through"))
    recent = rows.withColumn("__at", at).filter(F.col("__at") >= since).join(latest, [by, item], "left")
    marked = recent.withColumn("__counts", ~F.col("advisory")).withColumn("__resolved", F.col("__counts") & F.coalesce(F.col("__at") <= F.col("__through"), F.lit(False)))
    first = marked.filter("__counts and not __resolved").groupBy(by, item).agg(F.min("__at").alias("__first"))
    judged = marked.join(first, [by, item], "left").withColumn("__deferred", F.col("__counts") & ~F.col("__resolved") & F.col("additive") & (F.col("__first") > grace))
    n = lambda c: F.count(F.when(c, 1))
    return judged.groupBy(by).agg(F.count(F.lit(1)).alias("recent"), n(F.col("__counts")).alias("substantive"), n(F.col("__resolved")).alias("resolved"), n(F.col("__deferred")).alias("deferred"), n(F.col("__counts") & ~F.col("__resolved") & ~F.col("__deferred")).alias("due"))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of values in order, nulls apart from empty ones."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in columns])), 256)


def differing(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, kind) of rows that two stores don't agree on: only_left, only_right, or changed."""
    left, right = (rows.select(key, fingerprint(*[F.col(c) for c in columns]).alias(name)) for rows, name in ((a, "__a"), (b, "__b")))
    kind = F.when(F.col("__b").isNull(), "only_left").when(F.col("__a").isNull(), "only_right").when(F.col("__a") != F.col("__b"), "changed")
    return left.join(right, key, "full_outer").select(key, kind.alias("kind")).filter("kind is not null")


def drift_counts(index: DataFrame, truth: DataFrame, by: str, key: str, through: Column) -> DataFrame:
    """Per `by`: rows of the index and of the truth up to a watermark, and their difference where there is one."""
    n = lambda rows, name: rows.filter(F.col(key) <= through).groupBy(by).agg(F.count(F.lit(1)).alias(name))
    both = n(index, "in_index").join(n(truth, "in_truth"), by, "full_outer").fillna(0, ["in_index", "in_truth"])
    return both.withColumn("drift", F.col("in_index") - F.col("in_truth")).filter("drift != 0")


def lost(before: DataFrame, after: DataFrame, key: str, thread: str, dedup: str) -> DataFrame:
    """Rows that a new store lost: neither their id is there nor, in their thread, their key."""
    gone = before.join(after.select(key), key, "left_anti")
    return gone.join(after.filter(F.col(dedup).isNotNull()).select(thread, dedup).distinct(), [thread, dedup], "left_anti")


def may_publish(before: DataFrame, after: DataFrame, key: str, thread: str, dedup: str) -> DataFrame:
    """One row: how many committed rows a new store lost, and whether it may take the old one's place."""
    return lost(before, after, key, thread, dedup).agg(F.count(F.lit(1)).alias("lost")).withColumn("publish", F.col("lost") == 0)


def repaired(lines: DataFrame, mirror: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(whole lines and, for damaged or missing ones, the mirror's; damaged lines for quarantine). lines: key, payload, damaged."""
    good = lines.filter("not damaged").select(key, "payload")
    restored = mirror.join(good.select(key), key, "left_anti").select(key, "payload")
    return good.unionByName(restored), lines.filter("damaged")


#: Fixed value: digits of ids in base 32.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(at: Column, seed: Column) -> Column:
    """A 26-digit id that sorts by time: 48 bits of milliseconds, then 80 bits of the seed's hash. Equal rows get equal ids."""
    base32 = lambda hexes, n: F.lpad(F.upper(F.conv(hexes, 16, 32)), n, "0")
    time = F.lpad(F.upper(F.conv(F.unix_millis(at.cast("timestamp")).cast("string"), 10, 32)), 10, "0")
    digest = F.sha2(seed.cast("string"), 256)
    return F.translate(F.concat(time, base32(F.substring(digest, 1, 10), 8), base32(F.substring(digest, 11, 10), 8)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", CROCKFORD)


def migrated(threads: DataFrame, rows: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Threads with new ids and their old ones as aliases, and rows that follow them; rows of no thread keep a null id."""
    moved = threads.withColumn("legacy_id", F.col("id")).withColumn("id", ulid(F.col(at), F.col("legacy_id")))
    ids = moved.select(F.col("legacy_id").alias("thread_id"), F.col("id").alias("__new"))
    return moved, rows.join(ids, "thread_id", "left").withColumn("thread_id", F.col("__new")).drop("__new")


def store_to_truth(store: DataFrame, truth: DataFrame, path: str, key: str = "event_id", thread: str = "thread_id", depth: int = 1) -> int:
    """Write a store's rows as sharded files, but only if the store holds every row of the truth; the number of rows it lacks."""
    missing = truth.join(store.select(key), key, "left_anti").count()
    if not missing:
        store.withColumn("shard", shard(F.col(thread), depth)).repartition("shard").sortWithinPartitions(thread, key).write.mode("overwrite").partitionBy("shard").json(path)
    return missing


def schema_parity(spark: SparkSession, declared: dict[str, str], live: dict[str, DataFrame]) -> DataFrame:
    """(table, column, problem) where declared schemas (DDL by table) and live tables differ: missing, extra or of another type."""
    from pyspark.sql.types import StructType

    out = [(t, None, "extra table") for t in live.keys() - declared.keys()]
    for name, ddl in declared.items():
        if name not in live:
            out.append((name, None, "missing table"))
            continue
        want = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(ddl).fields}
        have = {f.name: f.dataType.simpleString() for f in live[name].schema.fields}
        out += [(name, c, "missing") for c in want.keys() - have.keys()] + [(name, c, "extra") for c in have.keys() - want.keys()] + [(name, c, f"{have[c]} for {want[c]}") for c in want.keys() & have.keys() if want[c] != have[c]]
    return spark.createDataFrame(sorted(out, key=str), "table string, column string, problem string")


def files_by(spark: SparkSession, path: str, kind: Column) -> DataFrame:
    """(kind, files, bytes, latest) of what lies under a path, from file metadata alone. `kind` is of column path."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return listed.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("latest"))
