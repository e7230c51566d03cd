"""Reading views over the conversation log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenlog.operators import reading
from lumenlog.plans.base import MESSAGES, messages, registry

QUERIES, query = registry()

TURNS = f"(select *, sum((role = 'user')::int) over (partition by thread_id order by event_id) as turn_no from {MESSAGES})"


@query(f"select event_id, thread_id, turn_no::bigint as turn_no from {TURNS}")
def turns(spark, d):
    return reading.with_turns(messages(spark, d)).select("event_id", "thread_id", "turn_no")


@query(f"""
with a as (select *, coalesce(lag(length(text) > 300) over (partition by thread_id order by event_id), false) or role is distinct from lag(role) over (partition by thread_id order by event_id) as fresh from {MESSAGES})
select event_id, sum(fresh::int) over (partition by thread_id order by event_id)::bigint as step_no from a""")
def steps(spark, d):
    return reading.with_steps(messages(spark, d), F.length("text") > 300).select("event_id", "step_no")


@query(f"""
with p as (select *, row_number() over (partition by thread_id order by event_id) as place from {MESSAGES}), h as (select * from p where contains(text, 'hat'))
select h.event_id as hit_id, (p.place - h.place)::int as distance, p.event_id, substr(p.text, 1, 500) as preview from h join p on p.thread_id = h.thread_id and p.place between h.place - 2 and h.place + 2""")
def neighbours(spark, d):
    m = messages(spark, d)
    return reading.neighbours(m, m.filter(F.contains("text", F.lit("hat"))), 2).select("hit_id", "distance", "event_id", F.substring("text", 1, 500).alias("preview"))


@query(f"select thread_id, event_id, row_number() over (partition by thread_id order by event_id)::int as step, case when trim(text) = '' then '[tool use]' else substr(text, 1, 70) end as preview from {MESSAGES}")
def toc(spark, d):
    w = Window.partitionBy("thread_id").orderBy("event_id")
    return messages(spark, d).select("thread_id", "event_id", F.row_number().over(w).alias("step"), F.when(F.trim("text") == "", "[tool use]").otherwise(F.substring("text", 1, 70)).alias("preview"))


@query(f"""
select thread_id, event_id from (select thread_id, event_id, row_number() over (partition by thread_id order by event_id) as a, row_number() over (partition by thread_id order by event_id desc) as z from {MESSAGES}) where a <= 2 or z <= 2""")
def ends(spark, d):
    return reading.ends(messages(spark, d), 2).select("thread_id", "event_id")


@query(f"select thread_id, arg_max(event_id, event_id) as event_id, substr(arg_max(text, event_id), 1, 200) as text from {MESSAGES} where role = 'assistant' and trim(text) <> '' group by thread_id")
def last_assistant(spark, d):
    said = messages(spark, d).filter((F.col("role") == "assistant") & (F.trim("text") != ""))
    return said.groupBy("thread_id").agg(F.max("event_id").alias("event_id"), F.substring(F.max_by("text", "event_id"), 1, 200).alias("text"))


@query(f"""
with t as {TURNS}, x as (select thread_id, max(turn_no) as at_turn from t where thread_id = 1 and event_id <= 1000004 group by thread_id)
select t.event_id, t.turn_no::bigint as turn_no from t join x on t.thread_id = x.thread_id where t.turn_no between x.at_turn - 1 and x.at_turn + 1""")
def around_event(spark, d):
    t = reading.with_turns(messages(spark, d).filter("thread_id = 1"))
    at = t.filter("event_id <= 1000004").groupBy("thread_id").agg(F.max("turn_no").alias("at_turn"))
    return t.join(at, "thread_id").filter(F.abs(F.col("turn_no") - F.col("at_turn")) <= 1).select("event_id", "turn_no")


@query(f"""
with t as {TURNS}, x as (select thread_id, max(turn_no) as at_turn from t where event_id <= thread_id * 1000000 + 1 group by thread_id)
select t.event_id from t join x on t.thread_id = x.thread_id where t.turn_no > x.at_turn""")
def after_event(spark, d):
    """Every thread from the turn after the one that renders its second event."""
    t = reading.with_turns(messages(spark, d))
    at = t.filter("event_id <= thread_id * 1000000 + 1").groupBy("thread_id").agg(F.max("turn_no").alias("at_turn"))
    return t.join(at, "thread_id").filter("turn_no > at_turn").select("event_id")


@query(f"""
select thread_id, event_id from (select thread_id, event_id, sum(length(text)) over (partition by thread_id order by event_id) as total, row_number() over (partition by thread_id order by event_id) as a from {MESSAGES}) where total <= 4000 or a = 1""")
def budget_cut(spark, d):
    return reading.budgeted(messages(spark, d), F.length("text"), 4000).select("thread_id", "event_id")


@query(f"select event_id, role from {MESSAGES} where role in ('user', 'assistant') and trim(text) <> ''")
def view_chat(spark, d):
    return messages(spark, d).filter(F.col("role").isin("user", "assistant") & (F.trim("text") != "")).select("event_id", "role")


@query(f"select event_id, text from {MESSAGES} where role = 'user'")
def view_user(spark, d):
    return messages(spark, d).filter("role = 'user'").select("event_id", "text")


@query(f"""
select thread_id, min(event_id) as first_event, max(event_id) as last_event, substr(trim(arg_min(text, event_id) filter (where role = 'user' and trim(text) <> '')), 1, 200) as preview from {MESSAGES} group by thread_id""")
def win_first_last(spark, d):
    return messages(spark, d).groupBy("thread_id").agg(
        F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"),
        F.substring(F.trim(F.min_by("text", F.when((F.col("role") == "user") & (F.trim("text") != ""), F.col("event_id")))), 1, 200).alias("preview"),
    )


@query(f"""
with t as {TURNS}
select thread_id, turn_no::bigint as turn_no, count(*)::bigint as events, string_agg(role, ',' order by event_id) as roles, sum(length(text))::bigint as chars from t group by thread_id, turn_no""")
def view_structured(spark, d):
    t = reading.with_turns(messages(spark, d))
    return t.groupBy("thread_id", "turn_no").agg(
        F.count(F.lit(1)).alias("events"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "role"))), lambda s: s["role"]), ",").alias("roles"), F.sum(F.length("text").cast("long")).alias("chars")
    )


@query(f"""
select thread_id, case when length(line) > 100 then substr(line, 1, 97) || '...' else line end as title
from (select thread_id, string_split(trim(arg_min(text, event_id)), chr(10))[1] as line from {MESSAGES} where role = 'user' group by thread_id)""")
def derive_title(spark, d):
    first = messages(spark, d).filter("role = 'user'").groupBy("thread_id").agg(F.split_part(F.trim(F.min_by("text", "event_id")), F.lit("\n"), F.lit(1)).alias("line"))
    return first.select("thread_id", F.when(F.length("line") > 100, F.concat(F.substring("line", 1, 97), F.lit("..."))).otherwise(F.col("line")).alias("title"))


@query(f"select event_id, case when starts_with(text, 'The ') then '[continued]' else substr(text, 1, 40) end as shown from {MESSAGES} where role = 'user'")
def compaction_marker(spark, d):
    return messages(spark, d).filter("role = 'user'").select("event_id", F.when(F.startswith("text", F.lit("The ")), "[continued]").otherwise(F.substring("text", 1, 40)).alias("shown"))


@query(f"""
select a.thread_id, a.event_id, max(b.event_id) as floor_event from {MESSAGES} a left join {MESSAGES} b on a.thread_id = b.thread_id and b.role = 'user' and b.event_id < a.event_id where a.role = 'assistant' group by all""")
def relocate_floor(spark, d):
    before = Window.partitionBy("thread_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = messages(spark, d).withColumn("floor_event", F.max(F.when(F.col("role") == "user", F.col("event_id"))).over(before))
    return placed.filter("role = 'assistant'").select("thread_id", "event_id", "floor_event")
