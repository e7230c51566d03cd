"""From normalised messages to events: builders by role, chains of one turn, deltas, and the checks around them.

Messages: thread_id, message_id, parent_id, role, content_text, blocks (array of BLOCK), model, created_at. An event is
(event_type, block_index, payload map, occurred_at); `ordinal` is its place within its message.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.shared import checkpointed
from lumenlog.operators.ingest import injected_by

#: A content block; fields that its type doesn't have are null.
BLOCK = """struct<type:string,text:string,name:string,tool_call_id:string,tool_use_id:string,input:string,content:string,is_error:boolean,seq:int,start_at:timestamp,
 context_type:string,raw_content:string,file_path:string,to_model:string,trigger:string,repo:string,number:string,url:string,summarizes:string,data:string>"""
#: Texts that only confirm that tools were loaded, and block types of users that have events of their own.
TOOL_LOADED = ("Tool loaded.",)
USER_BLOCKS = ("text", "tool_result", "ide_context", "model_change", "image")


def _event(kind: Column | str, at: Column, index: Column | None = None, **payload: Column) -> Column:
    given = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in payload.items()]
    none = F.expr("cast(map() as map<string,string>)")
    said = F.map_filter(F.map_from_entries(F.array(*given)), lambda k, v: v.isNotNull()) if given else none
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"), (F.lit(None) if index is None else index).cast("int").alias("block_index"), said.alias("payload"), at.alias("occurred_at"))


def _tool_result(b: Column, at: Column) -> Column:
    """The event of a tool's result: errors have a type of their own, and a result without an id says so."""
    error = F.coalesce(b["is_error"], F.lit(False))
    return _event(
        F.when(error, "tool_execution_error").otherwise("tool_execution_completed"), at, tool_call_id=b["tool_use_id"], tool_name=F.coalesce(b["name"], F.lit("unknown")),
        error=F.when(error, F.coalesce(b["content"], F.lit(""))), output=F.when(~error, F.coalesce(b["content"], F.lit(""))), unpaired=F.when(F.coalesce(b["tool_use_id"], F.lit("")) == "", F.lit(True)),
    )


def _chosen(condition: Column, events: Column) -> Column:
    return F.filter(events, lambda _: condition)


def user_events(text: Column, blocks: Column, at: Column) -> Column:
    """Array of events of a user's message: its text or images, tool results, editor context, changes of model, and any
    other block as it is; a confirmation of loaded tools is one event, and an empty message none."""
    of = lambda kind: F.filter(blocks, lambda b: b["type"] == kind)
    said, images = F.trim(text) != "", F.exists(blocks, lambda b: b["type"] == "image")
    sent = _event("user_message_sent", at, content=text, content_type=F.when(images, "multimodal"), source=F.when(said, injected_by(text)))
    parts = [
        _chosen(said | images, F.array(sent)),
        F.transform(of("tool_result"), lambda b: _tool_result(b, at)),
        F.transform(of("ide_context"), lambda b: _event("ide_context", at, b["seq"], context_type=b["context_type"], content=F.coalesce(b["raw_content"], F.lit("")), file_path=b["file_path"])),
        F.transform(of("model_change"), lambda b: _event("model_change", at, to=b["to_model"], trigger=F.coalesce(b["trigger"], F.lit("user")))),
        F.filter(F.transform(blocks, lambda b, i: F.when(~b["type"].isin(*USER_BLOCKS), _event("content_block", at, F.coalesce(b["seq"], i), block_type=b["type"], data=F.to_json(b)))), lambda e: e.isNotNull()),
    ]
    loaded = F.exists(blocks, lambda b: b["type"].isin("tool_result", "tool_reference")) & F.trim(text).isin(*TOOL_LOADED)
    return F.when(loaded, F.array(_event("tool_loaded", at, content=text))).otherwise(F.concat(*parts))


def assistant_events(text: Column, blocks: Column, model: Column, at: Column) -> Column:
    """Array of events of an assistant's message: the request, its blocks in order, the request's end with the number of
    blocks, the stream's end. Times of blocks move events forward, never back."""
    reached = lambda i: F.greatest(at, F.array_max(F.transform(F.slice(blocks, 1, i + 1), lambda b: b["start_at"])))
    last = F.when(F.size(blocks) > 0, reached(F.size(blocks) - 1)).otherwise(at)

    def block(b: Column, i: Column) -> Column:
        when = reached(i)
        tool = F.coalesce(b["tool_call_id"], F.lit(""))
        use = _event("tool_use_complete", when, i, tool_call_id=b["tool_call_id"], tool_name=F.coalesce(b["name"], F.lit("unknown")), input=F.coalesce(b["input"], F.lit("{}")), unpaired=F.when(tool == "", F.lit(True)))
        plain = lambda kind: _event(kind, when, i, text=F.coalesce(b["text"], F.lit("")))
        other = _event("content_block", when, i, block_type=b["type"], data=F.to_json(b))
        return F.when(b["type"] == "thinking", plain("thinking_complete")).when(b["type"] == "text", plain("text_complete")).when(b["type"] == "tool_use", use).when(b["type"] == "tool_result", _tool_result(b, when)).otherwise(other)

    alone = (F.size(blocks) == 0) & (text != "")
    shown = F.size(F.filter(blocks, lambda b: b["type"] != "tool_result")) + alone.cast("int")
    ends = F.array(_event("api_request_completed", last, blocks=shown, model=model), _event("stream_completed", last))
    return F.concat(F.array(_event("api_request_started", at, model=model)), F.transform(blocks, block), _chosen(alone, F.array(_event("text_complete", at, F.lit(0), text=text))), ends)


def system_events(text: Column, blocks: Column, at: Column) -> Column:
    """Array of the event that a system message's first block makes; none without blocks."""
    first = F.get(blocks, F.lit(0))
    kinds = {
        "context_summary": _event("context_summary", at, content=F.coalesce(first["text"], text), summarizes=first["summarizes"]), "file_snapshot": _event("file_snapshot", at, files=first["data"]),
        "queue_operation": _event("queue_operation", at, data=first["data"]), "progress": _event("progress", at, data=first["data"], tool_use_id=first["tool_use_id"]),
        "pr_link": _event("pr_link", at, repo=first["repo"], number=first["number"], url=first["url"]),
    }
    event = reduce(lambda e, k: F.when(first["type"] == k, kinds[k]).otherwise(e), kinds, _event("context_summary", at, content=text, system_type=first["type"]))
    return _chosen(F.size(blocks) > 0, F.array(event))


def generic_events(role: Column, text: Column, blocks: Column, at: Column) -> Column:
    """A message of another role as one event, none if it is empty."""
    event = _event("message", at, role=F.coalesce(F.nullif(role, F.lit("")), F.lit("unknown")), content=text, content_blocks=F.when(F.size(blocks) > 0, F.to_json(blocks)))
    return _chosen((F.trim(text) != "") | (F.size(blocks) > 0), F.array(event))


def build_events(messages: DataFrame, order: str = "event_id", thread: str = "thread_id") -> DataFrame:
    """One row per event of each message: its thread, id and `order`, ordinal, event_type, block_index, payload, occurred_at,
    and timestamp_source where the message had no time and took that of the one before it in its thread."""
    text, blocks = F.coalesce("content_text", F.lit("")), F.coalesce("blocks", F.expr(f"cast(array() as array<{BLOCK}>)"))
    before = F.last("created_at", ignorenulls=True).over(Window.partitionBy(thread).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    timed = messages.withColumn("__at", before).withColumn("timestamp_source", F.when(F.col("created_at").isNotNull(), None).when(F.col("__at").isNotNull(), F.lit("inferred_prev_turn")).otherwise(F.lit("no_source")))
    at, role = F.col("__at"), F.col("role")
    built = F.when(role == "user", user_events(text, blocks, at)).when(role == "assistant", assistant_events(text, blocks, F.coalesce("model", F.lit("unknown")), at)).when(role == "system", system_events(text, blocks, at)).otherwise(generic_events(role, text, blocks, at))
    return timed.select(thread, order, "message_id", "timestamp_source", F.posexplode(built).alias("ordinal", "e")).select(thread, order, "message_id", "ordinal", "e.*", "timestamp_source")


def trails(links: DataFrame) -> DataFrame:
    """(node, trail) of links (node, parent): the nodes from the root down to each one, a join a level; a link back into the
    trail ends it. A null parent, or one that is no node, makes a root."""
    links = checkpointed(links.select("node", "parent"))
    known = links.select(F.col("node").alias("__p"))
    level = links.join(known, F.col("parent") == F.col("__p"), "left_anti").select("node", F.array("node").alias("trail"))
    found = []
    while not level.isEmpty():
        found.append(level)
        below = links.join(level.withColumnRenamed("node", "__up"), F.col("parent") == F.col("__up")).filter(~F.array_contains("trail", F.col("node")))
        level = checkpointed(below.select("node", F.array_append("trail", F.col("node")).alias("trail")))
    return reduce(DataFrame.unionAll, found) if found else level


def coalesced_chains(messages: DataFrame, order: str = "event_id", thread: str = "thread_id") -> DataFrame:
    """Messages with each chain of an assistant's lines (linked by parent_id) folded into its first: `blocks` are those of
    the whole chain, level by level and in order within one. `order` is unique; ids are unique within a thread."""
    said = messages.filter("role = 'assistant'")
    parents = said.select(F.col(thread).alias("__t"), F.col("message_id").alias("__id"), F.col(order).alias("parent"))
    links = said.join(parents, (F.col(thread) == F.col("__t")) & (F.col("parent_id") == F.col("__id")), "left").select(F.col(order).alias("node"), "parent")
    placed = said.join(trails(links), F.col(order) == F.col("node")).select(F.col("trail")[0].alias("__root"), F.size("trail").alias("depth"), "trail", "blocks")
    whole = placed.groupBy("__root").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("depth", "trail", "blocks"))), lambda s: s["blocks"])).alias("__blocks"))
    kept = messages.join(whole, F.col(order) == F.col("__root"), "left").filter((F.col("role") != "assistant") | F.col("__root").isNotNull() | F.col("role").isNull())
    return kept.withColumn("blocks", F.coalesce("__blocks", "blocks")).drop("__root", "__blocks")


def absorbed_deltas(events: DataFrame, thread: str = "thread_id", order: str = "event_id", call: str = "call") -> DataFrame:
    """Events without raw deltas (event_type `delta`): a call without a `complete` gets one, of its deltas' texts in order,
    at the last of them."""
    deltas = events.filter("event_type = 'delta'")
    done = events.filter("event_type = 'complete'").select(thread, call).distinct()
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]), "")
    made = deltas.join(done, [thread, call], "left_anti").groupBy(thread, call).agg(F.max(order).alias(order), text.alias("text")).withColumn("event_type", F.lit("complete"))
    return events.filter("event_type != 'delta'").select(thread, call, order, "text", "event_type").unionByName(made)


def with_inferences(events: DataFrame, thread: str = "thread_id", order: str = "event_id") -> DataFrame:
    """inference_no: a new one begins where the role changes and at each `api_request_started`."""
    own = Window.partitionBy(thread).orderBy(order)
    begins = ~F.col("role").eqNullSafe(F.lag("role").over(own)) | (F.col("event_type") == "api_request_started")
    marked = events.withColumn("__b", begins.cast("int"))
    return marked.withColumn("inference_no", F.sum("__b").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def residual(line: Column, known: Column) -> Column:
    """Sorted keys of a JSON object that aren't known; null where nothing is declared for its role, or it is no object."""
    return F.when(known.isNotNull(), F.sort_array(F.array_except(F.json_object_keys(line), known)))


def sanitized(text: Column) -> Column:
    """A text without NUL characters and halves of surrogate pairs."""
    return F.regexp_replace(text, r"[\x00\x{D800}-\x{DFFF}]", "")


def title_of(text: Column, most: int = 100) -> Column:
    """A title from a first message: its first line, cut, with dots where something is left out."""
    line = F.substring(F.split_part(text, F.lit("\n"), F.lit(1)), 1, most)
    return F.when((F.length(text) > most) | F.contains(text, F.lit("\n")), F.concat(F.rtrim(line), F.lit("..."))).otherwise(line)


def resolved(refs: DataFrame, threads: DataFrame) -> DataFrame:
    """(ref, thread_id) of references: a thread's id, its old number, or its source's id, whole or after a separator; the
    first kind that matches counts, of several threads the newest. threads: id, legacy_id, source_id, at."""
    ids = threads.select(F.col("id").alias("key"), F.lit(0).alias("kind"), "id", "at")
    old = threads.select(F.col("legacy_id").cast("string").alias("key"), F.lit(1).alias("kind"), "id", "at")
    tails = F.array_distinct(F.array(F.col("source_id"), F.element_at(F.split("source_id", "[:/]"), -1)))
    own = threads.select(F.explode(tails).alias("key"), F.lit(2).alias("kind"), "id", "at")
    met = refs.join(ids.unionAll(old).unionAll(own).filter("key is not null"), F.col("ref") == F.col("key"))
    best = met.groupBy("ref").agg(F.min(F.struct("kind", (-F.unix_micros(F.col("at").cast("timestamp"))).alias("age"), "id")).alias("best"))
    return best.select("ref", F.col("best.id").alias("thread_id"))
