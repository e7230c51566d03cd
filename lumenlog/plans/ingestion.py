"""Ingest and integrity queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenlog.functions import ids
from lumenlog.operators import ingest, reading
from lumenlog.plans.base import MESSAGES, messages, registry, table

QUERIES, query = registry()


_ROLES = ["User", "human", "assistant", "TOOL", "system", "developer", "weird", "", None]
_SENDERS = ["human", "Assistant", "bot", None]


@query("""
with n as (select conv_id, turn, role, (conv_id * 7 + turn) % 9 as i, (conv_id * 3 + turn) % 4 as j from conversations),
     g as (select conv_id, turn, case i when 0 then 'User' when 1 then 'human' when 2 then 'assistant' when 3 then 'TOOL' when 4 then 'system' when 5 then 'developer' when 6 then 'weird' when 7 then '' end as given, case j when 0 then 'human' when 1 then 'Assistant' when 2 then 'bot' end as sender from n)
select conv_id, turn, given, sender, case when lower(given) in ('user', 'human') then 'user' when lower(given) in ('assistant', 'system', 'tool') then lower(given) when lower(sender) = 'human' then 'user' when lower(sender) = 'assistant' then 'assistant' when given <> '' then given else 'unknown' end as role from g""")
def role_normalize(spark, d):
    """Every kind of role and sender, dealt over the messages."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    n = table(spark, d, "conversations").select("conv_id", "turn", pick(_ROLES, (F.col("conv_id") * 7 + F.col("turn")) % 9).alias("given"), pick(_SENDERS, (F.col("conv_id") * 3 + F.col("turn")) % 4).alias("sender"))
    return n.withColumn("role", ingest.normalized_role(F.col("given"), F.col("sender")))


_HEADS = ["", "Warmup", "Warmup text that is a long one", "This session is being continued from", "Caveat: x", "[Request interrupted by", "[Image: 1]", "Base directory for this skill: /", "# Update Config Skill", "# Keybindings Skill", "<steward_checkin id=1>", "say <session_briefing>", "a <task-notification> b", "a <bash-notification> b"]


@query(f"""
with h(i, head) as (values {", ".join(f"({i}, '{h}')" for i, h in enumerate(_HEADS))}),
     m as (select event_id, case when i = 1 then head when i = 11 and event_id % 2 = 0 then repeat('x', 190) || head || text else head || text end as content from {MESSAGES} m join h on m.event_id % 14 = h.i)
select event_id, case when starts_with(content, 'Warmup') and length(content) < 20 then 'warmup' when starts_with(content, 'This session is being continued') then 'context_continuation' when starts_with(content, 'Caveat:') then 'caveat'
 when starts_with(content, '[Request interrupted') then 'request_interrupted' when starts_with(content, '[Image:') then 'image_placeholder' when starts_with(content, 'Base directory for this skill') or starts_with(content, '# Update Config Skill') or starts_with(content, '# Keybindings Skill') then 'skill_doc'
 when starts_with(content, '<steward_checkin') then 'steward_checkin' when contains(substr(content, 1, 200), '<session_briefing') then 'session_briefing' when contains(content, '<task-notification>') then 'task_notification' when contains(content, '<bash-notification>') then 'bash_notification' end as source from m""")
def detect_injected(spark, d):
    """Messages behind each marker, and behind none; a late briefing doesn't count."""
    i = (F.col("event_id") % 14).cast("int")
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), i + 1)
    content = F.when(i == 1, head).when((i == 11) & (F.col("event_id") % 2 == 0), F.concat(F.lit("x" * 190), head, "text")).otherwise(F.concat(head, "text"))
    return messages(spark, d).select("event_id", ingest.injected_by(content).alias("source"))


@query("""
with e as (select *, row_number() over (partition by user_id, event_type, floor(value) order by event_id) as r from events where event_id >= 500)
select event_id from e where r = 1 and not exists (select 1 from events s where s.event_id < 500 and s.user_id = e.user_id and s.event_type = e.event_type and floor(s.value) = floor(e.value))""")
def dedup_antijoin(spark, d):
    e = table(spark, d, "events").withColumn("bin", F.floor("value"))
    return ingest.fresh(e.filter("event_id >= 500"), e.filter("event_id < 500"), ["user_id", "event_type", "bin"], "event_id").select("event_id")


@query("""
select event_id, user_id, last_value(case when value > 15 then ts end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as at from events""")
def forward_fill_ts(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("value") > 15, F.col("ts")).alias("at"))
    return reading.forward_filled(e, "at", thread="user_id")


@query("select event_id, sum((event_type = 'click')::int) over (partition by user_id order by event_id)::bigint as stream_no from events")
def stream_assign(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.sum((F.col("event_type") == "click").cast("int")).over(w).alias("stream_no"))


@query(f"select min(event_id) as event_id from {MESSAGES} where role in ('user', 'assistant') group by thread_id, role, text")
def replay_dedup(spark, d):
    return messages(spark, d).filter(F.col("role").isin("user", "assistant")).groupBy("thread_id", "role", F.sha2(F.col("text").cast("binary"), 256)).agg(F.min("event_id").alias("event_id")).select("event_id")


@query("""
with recursive l as (select event_id as c, case when event_id % 8 = 0 then null else event_id - 1 - event_id % 3 end as p from events),
 up as (select c, p, c as root, 0 as depth from l union all select up.c, l.p, l.c, up.depth + 1 from up join l on up.p = l.c)
select c as event_id, arg_max(coalesce(p, root), depth) as root, max(depth)::int as depth from up group by c""")
def active_path(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 8 != 0, F.col("event_id") - 1 - F.col("event_id") % 3).alias("parent_id"))
    return ingest.roots_of(e, "event_id", "parent_id")


@query("select distinct conv_id, substr(sha256(conv_id::varchar), 1, 2) || '/' || substr(sha256(conv_id::varchar), 3, 2) as path from conversations")
def shard_path(spark, d):
    return table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", ids.shard(F.col("conv_id"), 2).alias("path"))


@query("select o_custkey, arg_max(o_orderkey, o_orderkey) as o_orderkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus from orders group by o_custkey")
def last_wins(spark, d):
    return ingest.last_wins(table(spark, d, "orders"), "o_custkey", F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""
select user_id, count(*)::bigint as raw, count(distinct event_id)::bigint as ids, count(distinct coalesce(case when event_type <> 'view' then event_type || floor(value)::bigint end, event_id::varchar))::bigint as effective from events group by user_id""")
def scan_counts_effective(spark, d):
    e = table(spark, d, "events")
    key = F.coalesce(F.when(F.col("event_type") != "view", F.concat("event_type", F.floor("value").cast("string"))), F.col("event_id").cast("string"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("raw"), F.count_distinct("event_id").alias("ids"), F.count_distinct(key).alias("effective"))


@query("select page_id, sha256(encode(html)) as blob_hash, octet_length(encode(html))::bigint as blob_bytes, true as restored from pages")
def blob_extract(spark, d):
    """Payloads in base64 go out by hash, and come back as they were."""
    from lumenlog.sources.sinks import extract_blobs, restore_blobs

    p = table(spark, d, "pages").select("page_id", F.base64(F.col("html").cast("binary")).alias("data"))
    named, blobs = extract_blobs(p, "data", "page_id")
    back = restore_blobs(named, blobs, "data").select("page_id", F.col("data").alias("back"))
    return named.join(back, "page_id").join(p, "page_id").select("page_id", "blob_hash", F.col("blob_bytes").cast("long").alias("blob_bytes"), (F.col("back") == F.col("data")).alias("restored"))


_TIMES = ["2024-03-01T10:00:00Z", "1709287200", "20240301", "nonsense", "2024-03-01 10:00:00", "2024-03-01T12:00:00+02:00", "2024", "2024-03-01T10:00:00.250", "2024-13-01", ""]


@query(f"""
with t(i, s) as (values {", ".join(f"({i}, '{x}')" for i, x in enumerate(_TIMES))}), e as (select event_id, value, case event_id % 4 when 0 then 1709287200 + event_id when 1 then (1709287200 + event_id) * 1000.0 + 250 when 2 then 'nan'::double else 1e300 end::double as number from events)
select event_id, i, case when i in (0, 4, 5) then timestamp '2024-03-01 10:00:00' when i = 7 then timestamp '2024-03-01 10:00:00.25' when i = 2 then timestamp '2024-03-01' end as at,
 case event_id % 4 when 0 then make_timestamp((1709287200 + event_id) * 1000000) when 1 then make_timestamp((1709287200 + event_id) * 1000000 + 250000) end as epoch_at from e, t""")
def parse_ts(spark, d):
    """ISO texts and what only looks like one, next to seconds, milliseconds and what is no time at all."""
    n = F.col("event_id") % 4
    second = F.lit(1709287200) + F.col("event_id")
    number = F.when(n == 0, second.cast("double")).when(n == 1, second * 1000.0 + 250).when(n == 2, F.lit(float("nan"))).otherwise(F.lit(1e300))
    e = table(spark, d, "events").select("event_id", number.alias("number"), F.posexplode(F.array(*[F.lit(x) for x in _TIMES])).alias("i", "s"))
    return e.select("event_id", "i", ids.parsed_timestamp(F.col("s")).cast("timestamp_ntz").alias("at"), ids.epoch_timestamp(F.col("number")).cast("timestamp_ntz").alias("epoch_at"))


@query("""
select user_id, string_agg(event_type, ',' order by first_id) as models from (select user_id, event_type, min(event_id) as first_id from events where event_type <> 'error' group by all) group by user_id""")
def models_of_thread(spark, d):
    first = table(spark, d, "events").filter("event_type != 'error'").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_id", "event_type"))), lambda s: s["event_type"]), ",").alias("models"))


@query("select user_id, event_type, sum(greatest(floor(value)::bigint - json_extract_string(props, '$.k')::bigint, 0))::bigint as fresh_tokens, sum(json_extract_string(props, '$.k')::bigint)::bigint as cached from events group by all")
def coalesce_usage(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum(F.greatest(F.floor("value").cast("bigint") - k, F.lit(0).cast("bigint"))).alias("fresh_tokens"), F.sum(k).alias("cached"))


@query(f"""
with d as (select event_id, thread_id, case role when 'user' then 'user' when 'assistant' then 'text' else role end as content_type, case when role in ('user', 'assistant') then text else substr(text, 1, 2000) end as content from {MESSAGES})
select event_id, thread_id, content_type, length(content)::bigint as chars from d where trim(content) <> '' and content_type <> 'tool_result'""")
def docs_extract(spark, d):
    m = messages(spark, d)
    content = F.when(F.col("role").isin("user", "assistant"), F.col("text")).otherwise(F.substring("text", 1, 2000))
    kind = F.when(F.col("role") == "assistant", "text").otherwise(F.col("role"))
    return m.select("event_id", "thread_id", kind.alias("content_type"), F.length(content).cast("long").alias("chars")).filter((F.trim(content) != "") & (F.col("content_type") != "tool_result"))


@query(f"""
with t as (select thread_id, min(event_id) as event_id, substr(arg_min(text, event_id), 1, 100) as title from {MESSAGES} where role = 'user' group by thread_id)
select t.event_id, t.title from t where t.title <> ''""")
def title_docs(spark, d):
    return messages(spark, d).filter("role = 'user'").groupBy("thread_id").agg(F.min("event_id").alias("event_id"), F.substring(F.min_by("text", "event_id"), 1, 100).alias("title")).filter("title != ''").select("event_id", "title")


@query(f"""
with m as (select thread_id, string_agg(text, '' order by event_id) as text, max(event_id) as anchor from {MESSAGES} where role = 'assistant' group by thread_id)
select thread_id, anchor, length(text)::bigint as chars, sha256(encode(text)) as digest from m""")
def stitch_deltas(spark, d):
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "text"))), lambda s: s["text"]), "")
    m = messages(spark, d).filter("role = 'assistant'").groupBy("thread_id").agg(parts.alias("text"), F.max("event_id").alias("anchor"))
    return m.select("thread_id", "anchor", F.length("text").cast("long").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query(f"""
with b as (select thread_id, event_id, event_id // 2 as call, role, case when event_id % 5 < 2 then 'the same reply' else text end as text from {MESSAGES}), c as (select * from b where event_id % 2 = 1), t as (select * from b where event_id % 2 = 0 and event_id % 3 = 0)
select c.thread_id, c.event_id from c where not exists (select 1 from t where t.thread_id = c.thread_id and t.call = c.call) and not exists (select 1 from t where t.thread_id = c.thread_id and t.text = c.text)""")
def twin_gate(spark, d):
    """Blocks of call summaries whose call has no complete twin, and whose text no twin of the thread holds."""
    text = F.when(F.col("event_id") % 5 < 2, "the same reply").otherwise(F.col("text"))
    b = messages(spark, d).select("thread_id", "event_id", F.floor(F.col("event_id") / 2).alias("call"), text.alias("text"))
    return ingest.untwinned(b.filter("event_id % 2 = 1"), b.filter("event_id % 2 = 0 and event_id % 3 = 0"), "thread_id", "call", "text").select("thread_id", "event_id")


@query("""
with a as (select event_id, event_type, floor(value)::bigint as v from events where event_id % 5 <> 0), b as (select event_id, event_type, floor(value)::bigint + (event_id % 11 = 0)::int as v from events where event_id % 7 <> 0)
select coalesce(a.event_id, b.event_id) as event_id, case when b.event_id is null then 'index_only' when a.event_id is null then 'missing' else 'mismatch' end as kind
from a full outer join b on a.event_id = b.event_id where a.event_id is null or b.event_id is null or a.v <> b.v""")
def id_diff(spark, d):
    e = table(spark, d, "events").select("event_id", F.floor("value").cast("bigint").alias("v"))
    a, b = e.filter("event_id % 5 != 0"), e.filter("event_id % 7 != 0").select("event_id", (F.col("v") + (F.col("event_id") % 11 == 0).cast("int")).alias("w"))
    kind = F.when(F.col("w").isNull(), "index_only").when(F.col("v").isNull(), "missing").when(F.col("v") != F.col("w"), "mismatch")
    return a.join(b, "event_id", "full_outer").select("event_id", kind.alias("kind")).filter("kind is not null")


@query("select 'labels' as part, count(*)::bigint as n from labels l where not exists (select 1 from documents x where x.doc_id = l.doc_id and x.lang = 'en') union all select 'orders', count(*) from orders o where not exists (select 1 from customer c where c.c_custkey = o.o_custkey and c.c_nationkey < 20)")
def dangling_refs(spark, d):
    a = table(spark, d, "labels").join(table(spark, d, "documents").filter("lang = 'en'").select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("labels").alias("part"), "n")
    b = table(spark, d, "orders").join(table(spark, d, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("orders").alias("part"), "n")
    return a.unionAll(b)


@query("select source, text_hash, copies from (select source, sha256(encode(text)) as text_hash, count(*)::bigint as copies from documents group by all) where copies > 1")
def dup_groups(spark, d):
    return table(spark, d, "documents").groupBy("source", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


@query("""
with s as (select source, count(*) as stored, max(doc_id) as newest from documents group by 1), h as (select d.source, count(*) as history, max(l.doc_id) as newest from labels l join documents d on d.doc_id = l.doc_id where l.quality = 1 group by 1)
select s.source, case when stored < 8 and coalesce(history, 0) >= 5 then 'went_dark' when coalesce(history, 0) > 0 and s.newest - h.newest > 6 then 'stale_ingest' when coalesce(history, 0) = 0 then 'never_ingested' else 'ok' end as verdict
from s left join h on s.source = h.source""")
def coverage_rules(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    stored = docs.groupBy("source").agg(F.count(F.lit(1)).alias("stored"), F.max("doc_id").alias("newest"))
    history = docs.join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("history"), F.max("doc_id").alias("seen"))
    h = F.coalesce("history", F.lit(0))
    rule = F.when((F.col("stored") < 8) & (h >= 5), "went_dark").when((h > 0) & (F.col("newest") - F.col("seen") > 6), "stale_ingest").when(h == 0, "never_ingested").otherwise("ok")
    return stored.join(history, "source", "left").select("source", rule.alias("verdict"))


@query(f"""
with s as (select thread_id, turn, text from {MESSAGES} where role = 'user' and thread_id % 2 = 0 and turn < 4), m as (select m.*, case when role = 'user' then s.turn is not null end as seen from {MESSAGES} m left join s on s.thread_id = m.thread_id and s.turn = m.turn and s.text = m.text),
     f as (select event_id, last_value(seen ignore nulls) over (partition by thread_id order by event_id rows unbounded preceding) as skipped from m)
select event_id from f where not coalesce(skipped, false)""")
def cross_pass_skip(spark, d):
    """A merge of whole threads into what holds some of their first turns."""
    m = messages(spark, d)
    stored = m.filter("thread_id % 2 = 0 and turn < 4")
    return ingest.without_seen_turns(m, stored, ["turn", "text"]).select("event_id")


@query("""
with s as (select event_id, user_id, event_type, floor(value) as v from events where event_id % 11 <> 4)
select e.event_id from events e where not exists (select 1 from s where s.event_id = e.event_id) and not exists (select 1 from s where s.user_id = e.user_id and s.event_type = e.event_type and s.event_type <> 'view' and s.v = floor(e.value))""")
def anti_theta(spark, d):
    """Events that a store lost: neither their id is there nor, but for views, their key."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor("value").alias("v"))
    kept = e.filter("event_id % 11 != 4")
    lost = e.join(kept.select("event_id"), "event_id", "left_anti")
    return lost.join(kept.filter("event_type != 'view'").select("user_id", "event_type", "v"), ["user_id", "event_type", "v"], "left_anti").select("event_id")


@query(f"""
with u as (select thread_id, turn, text from {MESSAGES} where role = 'user' union all select thread_id + 1000000, turn, case when thread_id % 4 = 1 and turn > 1 then text || '!' else text end from {MESSAGES} where role = 'user' and thread_id % 4 < 3 and (turn < 4 or thread_id % 4 = 2)),
     l as (select thread_id, list(text order by turn) as said from u group by 1)
select a.thread_id, min(b.thread_id) as continues from l a join l b on a.thread_id <> b.thread_id and list_slice(a.said, 1, len(b.said)) = b.said group by 1""")
def continuation_match(spark, d):
    """Threads and copies of them: cut short, changed on the way, or whole."""
    u = messages(spark, d).filter("role = 'user'").select("thread_id", "turn", "text")
    copy = u.filter("thread_id % 4 < 3 and (turn < 4 or thread_id % 4 = 2)").select((F.col("thread_id") + 1_000_000).alias("thread_id"), "turn", F.when((F.col("thread_id") % 4 == 1) & (F.col("turn") > 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return ingest.continuations(u.unionAll(copy), "turn")


@query("select c.conv_id, case when length(c.text) = length(o.text) and c.text = o.text then 'unchanged' when starts_with(c.text, o.text) then 'append' else 'rewind' end as verdict from (select conv_id, string_agg(text, chr(10) order by turn) as text from conversations group by 1) c join (select conv_id, string_agg(text, chr(10) order by turn) as text from conversations where turn < 2 or conv_id % 3 = 0 group by 1) o on c.conv_id = o.conv_id")
def cursor_resolve(spark, d):
    def whole(rows, name):
        return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias(name))

    c = table(spark, d, "conversations")
    both = whole(c, "now").join(whole(c.filter("turn < 2 or conv_id % 3 = 0"), "then"), "conv_id")
    return both.select("conv_id", F.when(F.col("now") == F.col("then"), "unchanged").when(F.startswith("now", "then"), "append").otherwise("rewind").alias("verdict"))


@query("select c.conv_id, c.turn from conversations c where length(c.text) < 40 or c.text is null or c.role not in ('user', 'assistant', 'system')")
def validate_content(spark, d):
    return table(spark, d, "conversations").filter((F.length("text") < 40) | F.col("text").isNull() | ~F.col("role").isin("user", "assistant", "system")).select("conv_id", "turn")


@query()
def content_hashes(spark, d):
    """Keys of messages: some with an id, some with the call of a tool, some with the place of a block."""
    payload = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("who")))
    m = messages(spark, d).withColumn("h", ids.content_hash(payload))
    known = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("m"), F.col("event_id").cast("string")))
    part = ids.key_part(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("t"), F.col("turn").cast("string"))), F.when(F.col("turn") % 3 == 1, F.col("turn")))
    return m.select("event_id", ids.dedup_key(known, F.col("role"), part, F.col("h")).alias("dedup_key"))
