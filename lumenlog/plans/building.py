"""Building of events from messages, over messages made of the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.operators import building
from lumenlog.plans.base import MESSAGES, messages, registry, table

QUERIES, query = registry()

_FIELDS = ["type", "text", "name", "tool_call_id", "tool_use_id", "input", "content", "is_error", "seq", "start_at", "context_type", "raw_content", "file_path", "to_model", "trigger", "repo", "number", "url", "summarizes", "data"]
_START = "2024-01-01 00:00:00"


def _block(**given):
    return F.struct(*[(given[k] if hasattr(given.get(k), "alias") else F.lit(given.get(k))).alias(k) for k in _FIELDS]).cast(building.BLOCK)


def _blocks():
    later = lambda s: F.lit(_START).cast("timestamp") + F.expr(f"interval {s} seconds")
    k = F.col("event_id") % 5
    result, failed = _block(type="tool_result", tool_use_id="t1", content="out"), _block(type="tool_result", is_error=True, content="boom")
    third = F.when(F.col("role") == "system", _block(type="pr_link", number="7", repo="o/r")).otherwise(_block(type="model_change", to_model="big"))
    return (
        F.when(k == 1, F.array(result)).when(k == 2, F.array(failed, _block(type="ide_context", raw_content="sel", file_path="/a.py", seq=1))).when(k == 3, F.array(third, _block(type="document")))
        .when(k == 4, F.array(_block(type="thinking", text="hm"), _block(type="text", text="hi", start_at=later(2)), _block(type="tool_use", name="Bash", start_at=later(1))))
    )


def _messages(spark, d):
    """Messages with blocks of every kind: by the rest of the id, with and without text, of every role."""
    m = messages(spark, d).withColumn("role", F.when(F.col("event_id") % 11 == 0, "developer").otherwise(F.col("role")))
    text = F.when((F.col("event_id") % 65 == 1) & (F.col("role") == "user"), "Tool loaded.").when(F.col("event_id") % 3 == 0, "").otherwise(F.lit("some words"))
    return m.select("thread_id", "event_id", F.concat(F.lit("m"), "event_id").alias("message_id"), "role", text.alias("content_text"), _blocks().alias("blocks"), F.lit("big").alias("model"), F.lit(_START).cast("timestamp").alias("created_at"))


#: What each message makes, written out: role, blocks, text (1), none (0) or a confirmation (2), then the events in order,
#: each as type, block index, what it names, seconds after the message.
_MADE = [
    ("user", 0, 1, "user_message_sent:::0"), ("user", 1, 1, "user_message_sent:::0 tool_execution_completed::t1:0"), ("user", 1, 0, "tool_execution_completed::t1:0"), ("user", 1, 2, "tool_loaded:::0"),
    ("user", 2, 1, "user_message_sent:::0 tool_execution_error::unpaired:0 ide_context:1:/a.py:0"), ("user", 2, 0, "tool_execution_error::unpaired:0 ide_context:1:/a.py:0"),
    ("user", 3, 1, "user_message_sent:::0 model_change::big:0 content_block:1:document:0"), ("user", 3, 0, "model_change::big:0 content_block:1:document:0"),
    ("user", 4, 1, "user_message_sent:::0 content_block:0:thinking:0 content_block:2:tool_use:0"), ("user", 4, 0, "content_block:0:thinking:0 content_block:2:tool_use:0"),
    ("assistant", 0, 1, "api_request_started:::0 text_complete:0:some words:0 api_request_completed::1:0 stream_completed:::0"), ("assistant", 0, 0, "api_request_started:::0 api_request_completed::0:0 stream_completed:::0"),
    *[("assistant", 1, t, "api_request_started:::0 tool_execution_completed::t1:0 api_request_completed::0:0 stream_completed:::0") for t in (0, 1)],
    *[("assistant", 2, t, "api_request_started:::0 tool_execution_error::unpaired:0 content_block:1:ide_context:0 api_request_completed::1:0 stream_completed:::0") for t in (0, 1)],
    *[("assistant", 3, t, "api_request_started:::0 content_block:0:model_change:0 content_block:1:document:0 api_request_completed::2:0 stream_completed:::0") for t in (0, 1)],
    *[("assistant", 4, t, "api_request_started:::0 thinking_complete:0:hm:0 text_complete:1:hi:2 tool_use_complete:2:unpaired:2 api_request_completed::3:2 stream_completed:::2") for t in (0, 1)],
    *[("system", k, t, f"{e}:0") for k, e in ((1, "context_summary::tool_result"), (2, "context_summary::tool_result"), (3, "pr_link::7"), (4, "context_summary::thinking")) for t in (0, 1)],
    *[("developer", k, t, "message::developer:0") for k in range(5) for t in (0, 1) if k or t],
]
_EXPECTED = ", ".join(f"('{r}', {k}, {t}, {i}, '{e.split(':')[0]}', {e.split(':')[1] or 'null'}, {repr(e.split(':')[2]) if e.split(':')[2] else 'null'}, {e.split(':')[3]})" for r, k, t, made in _MADE for i, e in enumerate(made.replace("some words", "some_words").split(" "))).replace("some_words", "some words")


@query(f"""
with m as (select event_id, case when event_id % 11 = 0 then 'developer' else role end as role from {MESSAGES}), n as (select event_id, role, case when event_id % 65 = 1 and role = 'user' then 2 when event_id % 3 = 0 then 0 else 1 end as said from m),
     x(role, k, said, ordinal, event_type, block_index, names, later) as (values {_EXPECTED})
select n.event_id, x.ordinal::int as ordinal, x.event_type, x.block_index::int as block_index, x.names, x.later::bigint as later from n join x on x.role = n.role and x.k = n.event_id % 5 and x.said = n.said""")
def build_events(spark, d):
    """Events of users, assistants, systems and other roles, against the table above."""
    p = F.col("payload")
    names = F.coalesce(F.when(p["unpaired"] == "true", "unpaired"), p["tool_call_id"], p["file_path"], p["to"], p["block_type"], p["system_type"], p["number"], p["blocks"], p["role"], F.when(F.col("event_type").isin("text_complete", "thinking_complete"), p["text"]))
    made = building.build_events(_messages(spark, d))
    return made.select("event_id", F.col("ordinal").cast("int").alias("ordinal"), "event_type", "block_index", names.alias("names"), F.unix_timestamp("occurred_at").cast("bigint").alias("end")).select("event_id", "ordinal", "event_type", "block_index", "names", (F.col("end") - F.unix_timestamp(F.lit(_START).cast("timestamp"))).alias("later"))


@query(f"""
with m as (select event_id, thread_id, turn, case when turn = 0 then 'user' else 'assistant' end as role, case turn when 0 then null when 1 then 0 when 2 then 1 when 3 then 1 when 4 then 2 when 5 then 3 when 6 then 99 else 6 end as up from {MESSAGES}),
     r as (select thread_id, turn, event_id, case when turn in (1, 2, 3, 4, 5) then 1 when turn in (6, 7) then 6 else turn end as root, case turn when 1 then 0 when 2 then 1 when 3 then 1 when 4 then 2 when 5 then 2 when 7 then 1 else 0 end as depth from m),
     s as (select thread_id, root, string_agg('b' || turn, ',' order by depth, turn) as said from r where turn > 0 group by 1, 2)
select m.event_id, coalesce(s.said, '') as said from m left join s on s.thread_id = m.thread_id and s.root = m.turn where m.turn = 0 or s.said is not null""")
def coalesce_chains(spark, d):
    """Trees of an assistant's lines, with two branches, below a user's message and below one that isn't there."""
    up = F.create_map(*[F.lit(x) for pair in ((1, 0), (2, 1), (3, 1), (4, 2), (5, 3), (6, 99), (7, 6)) for x in pair])
    m = messages(spark, d)
    role = F.when(F.col("turn") == 0, "user").otherwise("assistant")
    parent = F.when(F.col("turn") > 0, F.concat(F.lit("m"), up[F.col("turn").cast("int")].cast("string")))
    block = F.when(F.col("turn") > 0, F.array(_block(type="text", text=F.concat(F.lit("b"), F.col("turn").cast("string")))))
    made = m.select("thread_id", "event_id", F.concat(F.lit("m"), F.col("turn").cast("string")).alias("message_id"), parent.alias("parent_id"), role.alias("role"), block.alias("blocks"))
    # Where the thread lacks a line, what hangs on it begins a chain of its own; here every thread has all up to its last.
    return building.coalesced_chains(made).select("event_id", F.coalesce(F.array_join(F.transform("blocks", lambda b: b["text"]), ","), F.lit("")).alias("said"))


@query(f"""
with e as (select thread_id, event_id, event_id // 3 as call, case when event_id % 7 = 0 then 'complete' when role = 'user' then 'user' else 'delta' end as event_type, text from {MESSAGES}), done as (select distinct thread_id, call from e where event_type = 'complete'),
     s as (select thread_id, call, max(event_id) as event_id, string_agg(text, '' order by event_id) as text from e where event_type = 'delta' and (thread_id, call) not in (select thread_id, call from done) group by 1, 2)
select event_id, event_type, sha256(text) as digest from e where event_type <> 'delta' union all select event_id, 'complete', sha256(text) from s""")
def absorb_deltas(spark, d):
    m = messages(spark, d)
    kind = F.when(F.col("event_id") % 7 == 0, "complete").when(F.col("role") == "user", "user").otherwise("delta")
    e = m.select("thread_id", "event_id", F.floor(F.col("event_id") / 3).alias("call"), kind.alias("event_type"), "text")
    return building.absorbed_deltas(e).select("event_id", "event_type", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query(f"""
with e as (select event_id, thread_id, role, event_id % 5 = 3 as begins from {MESSAGES}), f as (select *, (role is distinct from lag(role) over (partition by thread_id order by event_id) or begins)::int as b from e)
select event_id, sum(b) over (partition by thread_id order by event_id)::bigint as inference_no from f""")
def inference_split(spark, d):
    e = messages(spark, d).withColumn("event_type", F.when(F.col("event_id") % 5 == 3, "api_request_started").otherwise("other"))
    return building.with_inferences(e).select("event_id", "inference_no")


@query("""
select event_id, case when event_type = 'view' then null else list_sort(list_filter(['k', 'zeta', 'alpha'], lambda x: not list_contains(case when event_type = 'click' then ['k', 'alpha'] else ['k'] end, x))) end as residual from events""")
def unmodeled_residual(spark, d):
    """Keys of lines that their type doesn't declare; a type without declarations has none."""
    line = F.concat(F.lit('{"zeta": 1, "alpha": {"x": 2}, '), F.substring("props", 2, 1000))
    known = F.when(F.col("event_type") == "view", None).when(F.col("event_type") == "click", F.array(F.lit("k"), F.lit("alpha"))).otherwise(F.array(F.lit("k")))
    return table(spark, d, "events").select("event_id", building.residual(line, known).alias("residual"))


@query(f"select event_id, replace(text, 'th', '') as clean from {MESSAGES}")
def sanitize(spark, d):
    """NUL characters, put into texts, are scrubbed."""
    return messages(spark, d).select("event_id", building.sanitized(F.replace("text", F.lit("th"), F.lit("\0"))).alias("clean"))


@query("""
with r as (select user_id, event_id % 4 as k from events where event_id < 1000000), t as (select user_id, min(event_id) as first_id from events group by 1)
select distinct case k when 0 then 'T' || r.user_id when 1 then (10000 + r.user_id)::varchar when 2 then 's-' || r.user_id else 'claude:s-' || r.user_id end as ref, 'T' || r.user_id as thread_id from r""")
def resolve_ref(spark, d):
    """References to threads by id, old number, and source's id, whole or without its prefix."""
    users = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("at"))
    u = F.col("user_id").cast("string")
    threads = users.select(F.concat(F.lit("T"), u).alias("id"), (F.lit(10000) + F.col("user_id")).alias("legacy_id"), F.concat(F.lit("claude:s-"), u).alias("source_id"), "at")
    # An older thread with the same source's id never counts.
    older = users.select(F.concat(F.lit("Z"), u).alias("id"), F.lit(None).cast("long").alias("legacy_id"), F.concat(F.lit("claude:s-"), u).alias("source_id"), (F.col("at") - F.expr("interval 1 day")).alias("at"))
    k = F.col("event_id") % 4
    ref = F.when(k == 0, F.concat(F.lit("T"), u)).when(k == 1, (F.lit(10000) + F.col("user_id")).cast("string")).when(k == 2, F.concat(F.lit("s-"), u)).otherwise(F.concat(F.lit("claude:s-"), u))
    return building.resolved(table(spark, d, "events").select(ref.alias("ref")).distinct(), threads.unionAll(older))


@query(f"select event_id, case when length(text) > 100 or contains(text, chr(10)) then rtrim(substr(split_part(text, chr(10), 1), 1, 100), ' ') || '...' else text end as title from {MESSAGES} where role = 'user'")
def derived_titles(spark, d):
    return messages(spark, d).filter("role = 'user'").select("event_id", building.title_of(F.col("text")).alias("title"))
