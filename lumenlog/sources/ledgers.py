"""Tolerant readers of line-based logs: JSON lines with torn or damaged lines, rotated ledger segments, text with line numbers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.operators.ingest import torn_lines


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, lineno, value) of whole text files; line numbers start at 1. A file is one row before it is split, so this
    is for session files, which are bounded; logs without need of line numbers are read by `json_lines`."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n", -1).alias("lines"))
    return files.select("path", F.posexplode("lines").alias("lineno", "value")).withColumn("lineno", F.col("lineno") + 1)


def json_lines(spark: SparkSession, path: str, schema: T.StructType, bad: str = "_bad") -> DataFrame:
    """Rows of JSON lines with a declared schema; a line that doesn't parse keeps its text in `bad`."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(bad, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)


#: Suffixes of rotated segments: a plain number, of the oldest kind, or a time with a counter within its second.
_ROTATED = r"[.](?:([0-9]{1,5})|([0-9]{8}T[0-9]{6}Z?)(?:[.]([0-9]+))?)$"


def ledger_rows(spark: SparkSession, path: str) -> DataFrame:
    """(segment_no, lineno, payload as variant) of a ledger's rotated segments and its current file, oldest first by both
    numbers; lines that don't parse, as a torn last one, are left out. `path` names the current file."""
    lines = numbered_lines(spark, f"{path}*").filter(F.trim("value") != "")
    part = lambda i: F.nullif(F.regexp_extract("path", _ROTATED, i), F.lit(""))
    age = F.when(part(1).isNotNull(), F.struct(F.lit(0).alias("kind"), F.lit("").alias("at"), part(1).cast("long").alias("n")))
    age = age.when(part(2).isNotNull(), F.struct(F.lit(1).alias("kind"), part(2).alias("at"), F.coalesce(part(3).cast("long"), F.lit(0).cast("long")).alias("n")))
    placed = lines.withColumn("age", age.otherwise(F.struct(F.lit(2).alias("kind"), F.lit("").alias("at"), F.lit(0).cast("long").alias("n"))))
    files = placed.select("path", "age").distinct()  # one row a segment
    numbered = files.withColumn("segment_no", F.row_number().over(Window.orderBy("age", "path"))).select("path", "segment_no")
    parsed = placed.join(F.broadcast(numbered), "path").withColumn("payload", F.try_parse_json("value"))
    return parsed.filter("payload is not null").select("segment_no", "lineno", "payload")


def sessions_stream(spark: SparkSession, path: str, files_per_batch: int = 1000, most_age: str | None = None) -> DataFrame:
    """(path, value) of lines of session files as they come, a bounded number of files a batch; the checkpoint of the query
    remembers which files were read, so unchanged ones are never read again."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch)
    reader = reader.option("maxFileAge", most_age) if most_age else reader
    return reader.load(path).select(F.col("_metadata.file_path").alias("path"), "value")


def scan_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, lineno, value as variant) of lines that parse, and (path, lineno, kind) of those that don't."""
    lines = numbered_lines(spark, path).withColumn("payload", F.try_parse_json("value"))
    full = lines.filter(F.trim("value") != "")
    return full.filter("payload is not null").select("path", "lineno", "payload"), torn_lines(full.filter("payload is null").select("path", "lineno"), full)


@dataclass(frozen=True)
class Provider:
    """A source of sessions: how its files are found and how a line becomes a message."""

    name: str
    pattern: str
    to_messages: Callable[[DataFrame], DataFrame]
    kind: str = "line_stream"
    options: dict = field(default_factory=dict)


def _project_lines(rows: DataFrame) -> DataFrame:
    """One message per user or assistant line; text parts joined, tool parts kept as JSON."""
    get = lambda p, t="string": F.try_variant_get("payload", p, t)
    content = F.coalesce(F.array_join(F.filter(F.transform(get("$.message.content", "array<variant>"), lambda v: F.try_variant_get(v, "$.text", "string")), lambda x: x.isNotNull()), "\n"), get("$.message.content"))
    return rows.select("path", "lineno", get("$.uuid").alias("message_id"), get("$.parentUuid").alias("parent_id"), get("$.sessionId").alias("thread_id"), get("$.type").alias("role"), content.alias("text"), get("$.timestamp").alias("created_at"), get("$.message.model").alias("model"))


def _assembled(lines: DataFrame) -> DataFrame:
    """One message per user's line, and one per run of an assistant's lines between them: (path, lineno, role, text, model,
    created_at); empty messages go, and a model that was declared counts until another is."""
    own = Window.partitionBy("path").orderBy("lineno")
    known = lines.withColumn("model", F.last("model", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spoken = known.filter(F.col("role").isin("user", "assistant"))
    part = spoken.withColumn("run", F.sum(((F.col("role") == "user") | (F.lag("role").over(own) == "user") | F.lag("role").over(own).isNull()).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lineno", "text"))), lambda s: s["text"]), "\n")
    whole = part.groupBy("path", "run").agg(F.min("lineno").alias("lineno"), F.first("role").alias("role"), said.alias("text"), F.max_by("model", "lineno").alias("model"), F.min("created_at").alias("created_at"))
    return whole.filter((F.col("role") == "user") | (F.trim("text") != ""))


def _message(rows: DataFrame, thread: Column) -> DataFrame:
    return rows.select("path", "lineno", F.concat_ws(":", "path", "lineno").alias("message_id"), F.lit(None).cast("string").alias("parent_id"), thread.alias("thread_id"), "role", "text", "created_at", "model")


def _envelope_lines(rows: DataFrame) -> DataFrame:
    """Envelopes {type, timestamp, payload}: one assistant's message spans its lines between two of the user."""
    get = lambda p: F.try_variant_get("payload", p, "string")
    role = F.when(get("$.payload.type") == "user_message", "user").when(get("$.payload.type").isin("agent_message", "agent_reasoning"), "assistant").otherwise(get("$.type"))
    return _message(_assembled(rows.select("path", "lineno", role.alias("role"), F.coalesce(get("$.payload.message"), get("$.payload.text")).alias("text"), get("$.payload.model").alias("model"), get("$.timestamp").alias("created_at"))), F.col("path"))


def _role_lines(rows: DataFrame) -> DataFrame:
    """Lines typed by role: reasoning goes with the assistant's line after it, results with the one before; ids are positions,
    so equal turns stay apart."""
    get = lambda p: F.try_variant_get("payload", p, "string")
    role = F.when(get("$.type").isin("assistant", "reasoning", "tool_result"), "assistant").otherwise(get("$.type"))
    lines = rows.select("path", "lineno", role.alias("role"), F.coalesce(get("$.content"), get("$.summary")).alias("text"), get("$.model").alias("model"), F.coalesce(get("$.created_at"), get("$.timestamp")).alias("created_at"))
    others = lines.filter(~F.col("role").isin("user", "assistant"))
    return _message(_assembled(lines).select(lines.columns).unionByName(others), F.col("path"))


def _step_lines(rows: DataFrame) -> DataFrame:
    """Steps {step_index, source, type, content}: a user's request comes out of its tag, the n-th result pairs with the n-th
    call."""
    get = lambda p: F.try_variant_get("payload", p, "string")
    kind = F.when(get("$.source").ilike("%user%"), "user").when(get("$.type").ilike("%tool_result%"), "tool").otherwise("assistant")
    text = F.coalesce(F.nullif(F.regexp_extract(get("$.content"), "(?s)<user_request>(.*?)</user_request>", 1), F.lit("")), get("$.content"))
    lines = rows.select("path", F.coalesce(get("$.step_index").cast("int") + 1, F.col("lineno")).alias("lineno"), kind.alias("role"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"), get("$.model").alias("model"), get("$.created_at").alias("created_at"))
    return _message(lines, F.col("path"))


def paired_results(steps: DataFrame, thread: str = "thread_id", order: str = "event_id") -> DataFrame:
    """(thread, order, call_id) of calls and results (`kind`): calls are agtool-1, -2, ... in order, the n-th result of a
    thread belongs to its n-th call; one without a call before it keeps an orphan's id."""
    own = Window.partitionBy(thread).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = steps.withColumn("__c", F.count(F.when(F.col("kind") == "call", 1)).over(own)).withColumn("__r", F.count(F.when(F.col("kind") == "result", 1)).over(own))
    name = F.when(F.col("kind") == "call", F.concat(F.lit("agtool-"), "__c")).when(F.col("__r") <= F.col("__c"), F.concat(F.lit("agtool-"), "__r")).otherwise(F.concat(F.lit("orphan-"), "__r"))
    return counted.filter(F.col("kind").isin("call", "result")).select(thread, order, "kind", name.alias("call_id"))


#: The line shapes read so far; others are added with `register`.
PROVIDERS: dict[str, Provider] = {p.name: p for p in (Provider("project", "*.jsonl", _project_lines), Provider("envelope", "*.jsonl", _envelope_lines), Provider("roles", "*.jsonl", _role_lines), Provider("steps", "*.jsonl", _step_lines))}


def register(provider: Provider) -> None:
    if provider.name in PROVIDERS:
        raise ValueError(f"provider {provider.name} is there already")
    PROVIDERS[provider.name] = provider


def read_sessions(spark: SparkSession, provider: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Messages of a provider's files, and their damaged lines."""
    good, bad = scan_sessions(spark, path)
    return PROVIDERS[provider].to_messages(good), bad


def read_tree_export(spark: SparkSession, path: str) -> DataFrame:
    """(conversation_id, message_id, parent_id, role, text, is_active) of account exports: an array of conversation trees."""
    node = "struct<parent:string,message:struct<author:struct<role:string>,content:struct<parts:array<string>>>>"
    schema = f"array<struct<id:string,title:string,current_node:string,mapping:map<string,{node}>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("c")).select("c.*")
    nodes = whole.select(F.col("id").alias("conversation_id"), "current_node", F.explode("mapping").alias("message_id", "node"))
    rows = nodes.select("conversation_id", "current_node", "message_id", F.col("node.parent").alias("parent_id"), F.col("node.message.author.role").alias("role"), F.array_join("node.message.content.parts", "\n").alias("text"))
    rows.createOrReplaceTempView("export_nodes")
    active = spark.sql("""
      with recursive up(conversation_id, message_id, path) as (
        select distinct conversation_id, current_node, array(current_node) from export_nodes where current_node is not null
        union all select n.conversation_id, n.parent_id, array_append(up.path, n.parent_id) from up join export_nodes n on n.conversation_id = up.conversation_id and n.message_id = up.message_id
        where n.parent_id is not null and not array_contains(up.path, n.parent_id))
      select distinct conversation_id, message_id, true as is_active from up""")
    return rows.join(active, ["conversation_id", "message_id"], "left").withColumn("is_active", F.coalesce("is_active", F.lit(False))).drop("current_node")
