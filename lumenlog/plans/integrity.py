"""Scopes, reconciliation, migration and the rest of the statistics, over the driver's tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from lumenlog.operators import integrity, ranking, vectors
from lumenlog.plans.base import MESSAGES, messages, registry, table

QUERIES, query = registry()


@query(f"select event_id, thread_id from {MESSAGES} where event_id > (select max(event_id) from {MESSAGES}) - 5000000")
def scan_window(spark, d):
    return integrity.scan_window(messages(spark, d).select("event_id", "thread_id"), 5_000_000)


_THREADS = "(select user_id as id, 'src' || user_id % 3 as source, case when user_id % 5 = 0 then 'system' else 'chat' end as thread_type, user_id % 7 = 0 as hidden from events group by user_id)"


def _threads(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    return u.select(F.col("user_id").alias("id"), F.concat(F.lit("src"), (F.col("user_id") % 3).cast("string")).alias("source"), F.when(F.col("user_id") % 5 == 0, "system").otherwise("chat").alias("thread_type"), (F.col("user_id") % 7 == 0).alias("hidden"))


def _typed(spark, d):
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("thread_id"), F.col("event_type").alias("content_type"), F.concat(F.lit("tool"), (F.col("event_id") % 4).cast("string")).alias("tool_name"), F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("occurred_at"))


@query(f"""
with t as {_THREADS}, e as (select event_id, user_id as thread_id, event_type as content_type, 'tool' || event_id % 4 as tool_name, case when event_id % 9 <> 0 then ts end as seen from events)
select event_id, 'scoped' as way from e join t on t.id = e.thread_id where not hidden and thread_type <> 'system' and source in ('src0', 'src1') and content_type <> 'view' and tool_name = 'tool1' and seen >= timestamp '2024-01-01 12:00:00' and seen <= timestamp '2024-01-20'
union all select event_id, 'named' from e where thread_id = 7 and content_type in ('view', 'click') union all select event_id, 'agents' from e join t on t.id = e.thread_id where not hidden and thread_type = 'system'""")
def scope_filters(spark, d):
    """Many scopes at once; a named thread that is hidden; agents."""
    e, t, now = _typed(spark, d), _threads(spark, d), datetime(2024, 1, 22, 12, tzinfo=UTC)
    many = integrity.scoped(e, t, sources=["src0", "src1"], without_kinds=["view"], tool="tool1", since="3w", until="2024-01-20", now=now)
    parts = {"scoped": many, "named": integrity.scoped(e, t, thread=7, kinds=["view", "click"]), "agents": integrity.scoped(e, t, types=["system"], agents=True)}
    out = [rows.select("event_id", F.lit(way).alias("way")) for way, rows in parts.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("select event_id from events where event_id % 9 <> 0 and ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20'")
def time_mask(spark, d):
    return integrity.in_time(_typed(spark, d), "occurred_at", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("""
with v as (select vec_id as doc_id from embeddings union all select vec_id * 2 from embeddings), h as (select doc_id, count(*) as have from v group by 1), n as (select doc_id, greatest(1, least(8, ceil(length(text) / 1500.0)::int)) as needed from documents)
select n.doc_id, needed::int as needed, coalesce(have, 0)::bigint as have from n left join h on h.doc_id = n.doc_id where coalesce(have, 0) < needed""")
def missing_vectors(spark, d):
    """Documents with fewer vectors than chunks."""
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("doc_id")).unionAll(e.select((F.col("vec_id") * 2).alias("doc_id")))
    needed = F.greatest(F.lit(1), F.least(F.lit(8), F.ceil(F.length("text") / 1500).cast("int")))
    return integrity.short_of(table(spark, d, "documents").select("doc_id", "text"), v, "doc_id", needed).select("doc_id", "needed", "have")


@query("select source, lang as thread_type, count(*)::bigint as threads from documents where doc_id % 6 <> 0 group by grouping sets ((source), (lang))")
def sources_and_types(spark, d):
    """Threads that aren't archived, by source and by type."""
    docs = table(spark, d, "documents").filter("doc_id % 6 != 0").select("source", F.col("lang").alias("thread_type"))
    return docs.groupingSets([["source"], ["thread_type"]], "source", "thread_type").agg(F.count(F.lit(1)).alias("threads"))


@query("""
with e as (select user_id, user_id % 10 as parent, event_id, event_type from events where user_id >= 10), f as (select user_id, parent, arg_min(event_type, event_id) filter (where event_type <> 'error') as model from e group by 1, 2)
select parent, coalesce(model, 'unknown') as model, count(*)::bigint as runs from f group by all""")
def subagents(spark, d):
    """Runs of subagents below each session, by their first real model."""
    e = table(spark, d, "events").filter("user_id >= 10")
    runs = e.groupBy("user_id").agg(F.min_by("event_type", F.when(F.col("event_type") != "error", F.col("event_id"))).alias("model"))
    return runs.groupBy((F.col("user_id") % 10).alias("parent"), F.coalesce("model", F.lit("unknown")).alias("model")).agg(F.count(F.lit(1)).alias("runs"))


@query("""
with r as (select event_type as provider, user_id % 4 as item, event_id as seen, event_id % 6 = 0 as advisory, event_id % 2 = 1 as additive from events where event_id >= (select max(event_id) // 5 from events)), x as (select event_type as provider, user_id % 4 as item, max(event_id) as through from events where event_id % 17 = 3 group by all),
     m as (select r.*, not advisory as counts, not advisory and coalesce(seen <= through, false) as done from r left join x on x.provider = r.provider and x.item = r.item), f as (select provider, item, min(seen) as first_at from m where counts and not done group by all),
     j as (select m.*, counts and not done and additive and first_at > (select max(event_id) * 4 // 5 from events) as later from m left join f on f.provider = m.provider and f.item = m.item)
select provider, count(*)::bigint as recent, count(*) filter (where counts)::bigint as substantive, count(*) filter (where done)::bigint as resolved, count(*) filter (where later)::bigint as deferred, count(*) filter (where counts and not done and not later)::bigint as due from j group by 1""")
def skip_summary(spark, d):
    """Findings by provider: recent, counting, resolved by a later resolution, deferred within the grace, due."""
    e = table(spark, d, "events").select(F.col("event_type").alias("provider"), (F.col("user_id") % 4).alias("item"), "event_id")
    last = e.agg(F.max("event_id")).first()[0]
    rows = e.withColumn("advisory", F.col("event_id") % 6 == 0).withColumn("additive", F.col("event_id") % 2 == 1)
    resolved = e.filter("event_id % 17 = 3").withColumnRenamed("event_id", "through")
    return integrity.open_findings(rows, resolved, "provider", "item", F.col("event_id"), F.lit(last // 5), F.lit(last * 4 // 5))


@query("""
with t as (select o_orderstatus as op, o_custkey, max(o_orderdate) as last_at from orders where o_orderkey % 3 <> 0 group by all)
select op, o_custkey, last_at, row_number() over (order by case op when 'O' then 0 when 'P' then 1 else 2 end, last_at desc nulls last, o_custkey)::bigint as place from t order by place limit 60""")
def sort_multi_dir(spark, d):
    """The strongest operation first, the latest within one, undated last."""
    t = table(spark, d, "orders").filter("o_orderkey % 3 != 0").groupBy(F.col("o_orderstatus").alias("op"), "o_custkey").agg(F.max("o_orderdate").alias("last_at"))
    strength = F.when(F.col("op") == "O", 0).when(F.col("op") == "P", 1).otherwise(2)
    top = t.withColumn("s", strength).orderBy("s", F.desc_nulls_last("last_at"), "o_custkey").limit(60)
    return ranking.numbered(top.withColumn("later", -F.unix_micros(F.col("last_at").cast("timestamp"))), "s", "later", "o_custkey").select("op", "o_custkey", "last_at", (F.col("position") + 1).alias("place"))


@query("""
with l as (select c_custkey % 50 as a, (c_custkey * 7) % 50 as b from customer), t as (select n_nationkey as id from nation where n_nationkey < 10), c as (select distinct o_custkey % 50 as id from orders where o_orderstatus = 'F' and o_custkey % 9 = 3)
select id from c union select b from l where a = 3 and b not in (select id from t) union select a from l where b = 3 and a not in (select id from t)""")
def topic_scope(spark, d):
    """Threads cited under a topic, and what is linked with it either way and is no topic itself."""
    links = table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("a"), ((F.col("c_custkey") * 7) % 50).alias("b"))
    topics = table(spark, d, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").cast("long").alias("id"))
    cited = table(spark, d, "orders").filter("o_orderstatus = 'F' and o_custkey % 9 = 3").select((F.col("o_custkey") % 50).cast("long").alias("id"))
    ends = links.filter("a = 3").select(F.col("b").cast("long").alias("id")).unionAll(links.filter("b = 3").select(F.col("a").cast("long").alias("id")))
    return cited.unionAll(ends.join(topics, "id", "left_anti")).distinct()


@query("""
with u as (select label, list_transform(embedding::double[], lambda x: x / sqrt(list_inner_product(embedding::double[], embedding::double[]))) as u from embeddings), e as (select label, generate_subscripts(u, 1) as i, unnest(u) as x from u), m as (select label, i, avg(x) as x from e group by all),
     c as (select label, list(x order by i) as v from m group by 1), q as (select embedding::double[] as v from embeddings where vec_id = 0)
select label, round(list_inner_product(c.v, q.v) / sqrt(list_inner_product(c.v, c.v) * list_inner_product(q.v, q.v)), 5) as similarity from c, q""")
def centroid_similarity(spark, d):
    e = table(spark, d, "embeddings")
    probe = e.filter("vec_id = 0").select("embedding").first()[0]
    wanted = vectors.unit(F.array(*[F.lit(float(x)) for x in probe]))
    return vectors.centroids(e, "label").select("label", F.round(vectors.dot(F.col("centroid"), wanted), 5).alias("similarity"))


@query("""
with a as (select user_id, count(*) as n from events where event_id <= (select max(event_id) * 9 // 10 from events) and event_id % 50 <> 7 group by 1), b as (select user_id, count(*) as n from events where event_id <= (select max(event_id) * 9 // 10 from events) and event_id % 70 <> 9 group by 1)
select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.n, 0)::bigint as in_index, coalesce(b.n, 0)::bigint as in_truth, (coalesce(a.n, 0) - coalesce(b.n, 0))::bigint as drift from a full outer join b on a.user_id = b.user_id where coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def drift_of_counts(spark, d):
    """Index and truth by thread, up to a watermark: the newest tenth of ids is still on its way."""
    e = table(spark, d, "events").select("event_id", "user_id")
    return integrity.drift_counts(e.filter("event_id % 50 != 7"), e.filter("event_id % 70 != 9"), "user_id", "event_id", F.lit(e.agg(F.max("event_id")).first()[0] * 9 // 10))


@query("""
select coalesce(a.event_id, b.event_id) as event_id, case when b.event_id is null then 'only_left' when a.event_id is null then 'only_right' else 'changed' end as kind
from (select event_id, event_type, props from events where event_id % 23 <> 4) a full outer join (select event_id, case when event_id % 31 = 5 then 'x' else event_type end as event_type, props from events where event_id % 29 <> 6) b on a.event_id = b.event_id
where a.event_id is null or b.event_id is null or a.event_type <> b.event_type or a.props <> b.props""")
def cross_fingerprint(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "props")
    other = e.filter("event_id % 29 != 6").withColumn("event_type", F.when(F.col("event_id") % 31 == 5, "x").otherwise(F.col("event_type")))
    return integrity.differing(e.filter("event_id % 23 != 4"), other, "event_id", ["event_type", "props"])


_GATE = "(select event_id, user_id, case when event_id % 3 > 0 then event_type || floor(value)::bigint end as k from events)"


@query(f"""
with a as {_GATE}, b as (select * from a where event_id % 13 <> 5)
select count(*)::bigint as lost, count(*) = 0 as publish from a where event_id not in (select event_id from b) and not exists (select 1 from b where b.user_id = a.user_id and b.k = a.k)""")
def regression_gate(spark, d):
    """Whether a rebuilt store, which lacks some ids, may take the old one's place."""
    a = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 > 0, F.concat("event_type", F.floor("value").cast("string"))).alias("k"))
    return integrity.may_publish(a, a.filter("event_id % 13 != 5"), "event_id", "user_id", "k")


@query("""
with l as (select event_id, props, event_id % 19 = 2 as damaged from events where event_id % 41 <> 3), m as (select event_id, props from events where event_id % 5 <> 1), g as (select event_id, props from l where not damaged)
select event_id, props as payload from g union all select event_id, props from m where event_id not in (select event_id from g)""")
def truth_repair(spark, d):
    """Damaged and missing lines come back from a mirror, where it has them."""
    e = table(spark, d, "events").select("event_id", F.col("props").alias("payload"))
    lines = e.filter("event_id % 41 != 3").withColumn("damaged", F.col("event_id") % 19 == 2)
    return integrity.repaired(lines, e.filter("event_id % 5 != 1"), "event_id")[0]


@query("""
with t as (select user_id, min(ts) as first_at from events group by 1)
select e.event_id, t.user_id as legacy_id, 26::int as digits, (epoch_us(t.first_at) // 1000)::bigint as at_ms from events e left join t on t.user_id = e.user_id""")
def id_migration(spark, d):
    """Threads with new ids that sort by time, and their rows, which follow; the time is read back out of the id."""
    e = table(spark, d, "events")
    threads, rows = integrity.migrated(e.groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("at")), e.select("event_id", F.col("user_id").alias("thread_id")), "at")
    back = F.conv(F.translate(F.substring("thread_id", 1, 10), integrity.CROCKFORD, "0123456789ABCDEFGHIJKLMNOPQRSTUV"), 32, 10).cast("bigint")
    aliased = rows.join(threads.select(F.col("id").alias("thread_id"), "legacy_id"), "thread_id")
    return aliased.select("event_id", "legacy_id", F.length("thread_id").alias("digits"), back.alias("at_ms"))


@query("""
with r as (select conv_id % 4 as thread, lower(trim(regexp_replace(regexp_replace(case when turn % 2 = 0 then 'run ' || turn || ' done' else text end, '\\s+', ' ', 'g'), '[0-9]+', '#', 'g'))) as what from conversations),
     n as (select thread, count(distinct what) as n from r group by 1), p as (select ln(1 + max(n) - 1) as peak from n)
select thread, round(case when peak > 0 then ln(1 + n - 1) / peak else 0 end, 6) as evidence from n, p""")
def evidence(spark, d):
    """Distinct contents of each thread of a pool, runs of digits folded, against the thread with most."""
    m = messages(spark, d).select((F.col("thread_id") % 4).alias("thread"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("run "), F.col("turn").cast("string"), F.lit(" done"))).otherwise(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    return ranking.evidence(m, "thread", "text").select("thread", F.round("evidence", 6).alias("evidence")).distinct()


@query()
def files_on_disk(spark, d):
    """Files and bytes by kind of table, from file metadata."""
    return integrity.files_by(spark, d, F.regexp_extract("path", "/([a-z]+)[.]parquet", 1)).select("kind", "files", "bytes")
