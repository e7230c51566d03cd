"""Operational reports, integrity checks and the whole search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenlog.functions.paths import TOOLS, commits_in, pr_reference, pull_request, tool_operation, touches
from lumenlog.functions.stemming import stems
from lumenlog.functions.text import tokens
from lumenlog.operators import evaluation, ingest, metrics, search
from lumenlog.operators.index import index_of
from lumenlog.plans.base import MESSAGES, messages, registry, table

QUERIES, query = registry()


@query("""
with c as (select event_id, event_type, user_id, floor(value)::bigint as v from events), r as (select *, row_number() over (partition by event_type, user_id, v order by event_id desc) as r from c)
select event_id, event_type, user_id, v from r where r = 1""")
def replay_distinct(spark, d):
    c = table(spark, d, "events").select("event_id", "event_type", "user_id", F.floor("value").cast("bigint").alias("v"))
    return c.groupBy("event_type", "user_id", "v").agg(F.max("event_id").alias("event_id")).select("event_id", "event_type", "user_id", "v")


@query("""
with m as (select user_id, avg(value) as v from events group by 1), b as (select user_id, avg(value) as v from events where event_id % 3 <> 0 group by 1)
select m.user_id, round(m.v, 6) as observed, round(b.v, 6) as baseline, m.v - b.v < -greatest(5.0 / 10, 0.25) as breach from m join b on m.user_id = b.user_id""")
def gate_compare(spark, d):
    e = table(spark, d, "events")
    base = e.filter("event_id % 3 != 0").groupBy("user_id").agg(F.avg("value").alias("b"))
    both = e.groupBy("user_id").agg(F.avg("value").alias("m")).join(base, "user_id")
    return both.select("user_id", F.round("m", 6).alias("observed"), F.round("b", 6).alias("baseline"), (F.col("m") - F.col("b") < -0.5).alias("breach"))


_SHAPED = """(select o_custkey as qid, case o_custkey % 7 when 0 then 'alpha|beta' when 1 then '"a phrase" x' when 2 then 'one AND two' when 3 then 'get_session' when 4 then 'a.b in c' when 5 then 'how it works.' else 'word' end as text from (select distinct o_custkey from orders))"""


@query(f"""
with s as (select qid, case when contains(text, '|') then 'pipe-or' when contains(text, '"') or list_has_any(string_split(text, ' '), ['AND', 'OR', 'NOT']) then 'boolean/phrase' when contains(text, '_') or contains(text, '::') or len(list_filter(string_split(text, ' '), lambda w: contains(w, '.') and not ends_with(w, '.'))) > 0 then 'code'
 when len(string_split(text, ' ')) >= 2 then 'natural' else 'single-term' end as shape from {_SHAPED}),
 r as (select o_custkey as qid, o_orderstatus = 'F' as gold, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders), m as (select qid, max(case when gold then 1.0::double / rank end) as rr, bool_or(gold and rank <= 5)::int as success from r group by 1 having bool_or(gold))
select shape, count(*)::bigint as queries, round(avg(rr), 6) as mrr, round(avg(success), 6) as success_5 from m join s on s.qid = m.qid group by 1""")
def ir_per_shape(spark, d):
    """Mean reciprocal rank and success at five, by the shape of the query's text."""
    texts = ["alpha|beta", '"a phrase" x', "one AND two", "get_session", "a.b in c", "how it works.", "word"]
    o = table(spark, d, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    run = o.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("doc_id"), rank.alias("rank"))
    rels = o.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("doc_id"), (F.col("o_orderstatus") == "F").cast("int").alias("rel"))
    gold = evaluation.first_gold(run, rels, (5,))
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("qid") % 7 + 1).cast("int"))
    return gold.groupBy(evaluation.query_shape(text).alias("shape")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("success_5"), 6).alias("success_5"))


@query("""
with p as (select label, avg(m) as m from (select label, vec_id % 5 as domain, avg(list_sum(embedding::double[])) as m from embeddings group by all) group by label) select label, round(m, 6) as macro from p""")
def mean_metrics(spark, d):
    e = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 5).alias("domain"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("m"))
    return e.groupBy("label", "domain").agg(F.avg("m").alias("m")).groupBy("label").agg(F.round(F.avg("m"), 6).alias("macro"))


@query("""
with u as (select event_id, unnest(['total', 'half', 'cold']) as stage, unnest([value, value / 2, case when event_id % 7 = 0 then value end]) as ms from events)
select stage, count(ms)::bigint as n, quantile_disc(ms, 0.5) as p50, quantile_disc(ms, 0.95) as p95, max(ms) as top from u where ms is not null group by stage""")
def latency_profile(spark, d):
    u = table(spark, d, "events").select(F.expr("stack(3, 'total', value, 'half', value / 2, 'cold', case when event_id % 7 = 0 then value end) as (stage, ms)")).filter("ms is not null")
    return u.groupBy("stage").agg(F.count("ms").alias("n"), metrics.nearest_rank("ms", 0.5).alias("p50"), metrics.nearest_rank("ms", 0.95).alias("p95"), F.max("ms").alias("top"))


@query("""
with a as (select count(*) as n, count(distinct doc_id) as ids from documents), b as (select count(*) as n from documents where doc_id % 10 <> 3)
select round(b.n::double / a.ids, 6) as coverage, b.n::double / a.ids < 0.95 as shrunk from a, b""")
def mirror_coverage(spark, d):
    return table(spark, d, "documents").agg(F.count_distinct("doc_id").alias("ids"), F.count(F.when(F.col("doc_id") % 10 != 3, 1)).alias("n")).select(F.round(F.col("n") / F.col("ids"), 6).alias("coverage"), (F.col("n") / F.col("ids") < 0.95).alias("shrunk"))


@query("""
with f as (select event_type, user_id, max(event_id) as failed from events where value > 40 group by all), g as (select event_type, user_id, max(event_id) as green from events where value <= 20 group by all)
select f.event_type, f.user_id, case when green > failed then 'recovered' when failed - coalesce(green, -1000000) < 500 then 'tolerated' else 'failed' end as verdict from f left join g on f.event_type = g.event_type and f.user_id = g.user_id""")
def pipeline_verdict(spark, d):
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.max(F.when(F.col("value") > 40, F.col("event_id"))).alias("failed"), F.max(F.when(F.col("value") <= 20, F.col("event_id"))).alias("green")).filter("failed is not null")
    grace = F.col("failed") - F.coalesce("green", F.lit(-1_000_000))
    return e.select("event_type", "user_id", F.when(F.col("green") > F.col("failed"), "recovered").when(grace < 500, "tolerated").otherwise("failed").alias("verdict"))


@query("""
with n as (select 1 as priority, 'slow:' || event_type as fingerprint, count(*) as n from events where value > 50 group by event_type union all select 2, 'busy:' || user_id, count(*) from events group by user_id having count(*) > 60)
select priority, fingerprint, n::bigint as n from n where not exists (select 1 from (select 'slow:' || event_type as fingerprint from events where event_id % 997 = 5) s where s.fingerprint = n.fingerprint)""")
def notices(spark, d):
    e = table(spark, d, "events")
    slow = e.filter("value > 50").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(1).alias("priority"), F.concat(F.lit("slow:"), "event_type").alias("fingerprint"), "n")
    busy = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 60").select(F.lit(2).alias("priority"), F.concat(F.lit("busy:"), F.col("user_id").cast("string")).alias("fingerprint"), "n")
    silenced = e.filter("event_id % 997 = 5").select(F.concat(F.lit("slow:"), "event_type").alias("fingerprint"))
    return slow.unionAll(busy).join(silenced, "fingerprint", "left_anti").select("priority", "fingerprint", "n")


@query("select event_id, 'k=' || substr(json_extract_string(props, '$.k'), 1, 80) || ', type=' || event_type as args from events where event_type = 'click'")
def render_tool_args(spark, d):
    return table(spark, d, "events").filter("event_type = 'click'").select("event_id", F.concat(F.lit("k="), F.substring(F.get_json_object("props", "$.k"), 1, 80), F.lit(", type="), "event_type").alias("args"))


@query("""
with t as (select event_id, min(event_id) over (partition by user_id, event_type, floor(value)) as survivor from events), c as (select event_id % 40 as topic, event_id as cited from events)
select distinct c.topic, t.survivor as cited from c join t on t.event_id = c.cited""")
def citation_repoint(spark, d):
    e = table(spark, d, "events")
    twins = e.select("event_id", F.min("event_id").over(Window.partitionBy("user_id", "event_type", F.floor("value"))).alias("survivor"))
    return e.select((F.col("event_id") % 40).alias("topic"), "event_id").join(twins, "event_id").select("topic", F.col("survivor").alias("cited")).distinct()


@query("""
with p as (select event_id, 'en' as lang, event_type as kind from events), x as (select event_id, event_id % 3 as how, floor(value)::bigint as v from events where event_id % 4 > 0)
select p.event_id, kind, case when how = 0 then 'x' || v else lang end as lang, case when how = 0 then v::varchar end as cost, case when how = 0 then 2 else 0 end::int as changed from p left join x on x.event_id = p.event_id""")
def amend_merge(spark, d):
    """Two patches an event, the later one counts; those of a content key are refused, a value that is there changes nothing."""
    e = table(spark, d, "events")
    payload = e.select("event_id", F.create_map(F.lit("lang"), F.lit("en"), F.lit("kind"), F.col("event_type")).alias("payload"))
    v = F.floor("value").cast("string")
    how, patched = F.col("event_id") % 3, e.filter("event_id % 4 > 0")
    made = F.when(how == 0, F.create_map(F.lit("lang"), F.concat(F.lit("x"), v), F.lit("cost"), v)).when(how == 1, F.create_map(F.lit("text"), v, F.lit("cost"), v)).otherwise(F.create_map(F.lit("lang"), F.lit("en")))
    first = patched.select("event_id", F.lit(1).alias("seq"), F.create_map(F.lit("lang"), F.lit("en")).alias("patch"))
    done = ingest.amended(payload, first.unionAll(patched.select("event_id", F.lit(2).alias("seq"), made.alias("patch"))))
    return done.select("event_id", F.col("payload")["kind"].alias("kind"), F.col("payload")["lang"].alias("lang"), F.col("payload")["cost"].alias("cost"), "changed")


@query(f"""
select case when length(trim(text)) < 60 then 'empty_extract' else 'unindexed' end as kind, count(*)::bigint as n from {MESSAGES} m where not exists (select 1 from {MESSAGES} i where i.event_id = m.event_id and i.event_id % 7 <> 0) group by 1""")
def dq_unindexed(spark, d):
    m = messages(spark, d)
    lost = m.join(m.filter("event_id % 7 != 0").select("event_id"), "event_id", "left_anti")
    return lost.groupBy(F.when(F.length(F.trim("text")) < 60, "empty_extract").otherwise("unindexed").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with k as (select doc_id, substr(sha256(encode(text)), 1, 16) as tail, case when doc_id % 9 = 0 then null when doc_id % 13 = 0 then 'stale' else substr(sha256(encode(text)), 1, 16) end as key from documents)
select case when key is null then 'no_key' when key <> tail then 'mismatch' else 'match' end as verdict, count(*)::bigint as n from k group by 1""")
def hash_selfcheck(spark, d):
    tail = F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16)
    k = table(spark, d, "documents").select(tail.alias("tail"), F.when(F.col("doc_id") % 9 == 0, None).when(F.col("doc_id") % 13 == 0, F.lit("stale")).otherwise(tail).alias("key"))
    return k.groupBy(F.when(F.col("key").isNull(), "no_key").when(F.col("key") != F.col("tail"), "mismatch").otherwise("match").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


_TOOL_ROWS = [(tool, op) for op, names in TOOLS.items() for tool in names.split()] + [("threads", None), ("concatenate", None), ("tools_call", None), ("webfetch", None)]
_TOOLS_SQL = ", ".join(f"({i}, '{t}', {op and repr(op) or 'null'})" for i, (t, op) in enumerate(_TOOL_ROWS))


@query(f"""
with t(i, tool, op) as (values {_TOOLS_SQL})
select event_id, case event_id % 3 when 0 then upper(tool) when 1 then 'mcp__My-Server__' || tool else 'mcp_server_' || tool end as name, op from events join t on t.i = event_id % {len(_TOOL_ROWS)}""")
def tool_op(spark, d):
    """Every known tool and some unknown ones, in other cases and behind servers' prefixes."""
    tool = F.element_at(F.array(*[F.lit(t) for t, _ in _TOOL_ROWS]), (F.col("event_id") % len(_TOOL_ROWS) + 1).cast("int"))
    name = F.when(F.col("event_id") % 3 == 0, F.upper(tool)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("mcp__My-Server__"), tool)).otherwise(F.concat(F.lit("mcp_server_"), tool))
    return table(spark, d, "events").select("event_id", name.alias("name")).withColumn("op", tool_operation(F.col("name")))


@query("""
with p as (select page_id, regexp_replace(split_part(url, '?', 1), '^https?://[^/]*', '') as path from pages), c as (select page_id, path, page_id % 4 as k, ltrim(path, '/') || '.py' as file from p)
select page_id, case k when 3 then '/srv/' || file when 0 then '/work/' || file when 1 then '/tmp/' || file else '/work/' || file end as path, case k when 0 then 'edit' when 1 then 'run' when 2 then 'read' else 'write' end as op from c where k <> 1 or not contains(path, '#')""")
def extract_paths(spark, d):
    """Paths that tool calls touch: a patch, a command line that changes its folder, a keyed input, a list."""
    plain = F.regexp_replace(F.split_part("url", F.lit("?"), F.lit(1)), "^https?://[^/]*", "")
    file = F.concat(F.ltrim(plain, F.lit("/")), F.lit(".py"))
    k = F.col("page_id") % 4
    patch = F.concat(F.lit("*** Update File: "), file, F.lit("\n@@"))
    command = F.concat(F.lit("cd /tmp && cat "), file, F.lit(" e.g. https://x.org/ node_modules/b.py | head"))
    given = F.when(k == 0, F.to_json(F.struct(patch.alias("patch")))).when(k == 1, F.to_json(F.struct(command.alias("command")))).when(k == 2, F.to_json(F.struct(F.concat(F.lit("./x/../"), file).alias("file_path")))).otherwise(F.to_json(F.struct(F.array(F.concat(F.lit("/srv/"), file), F.lit(".git/config")).alias("paths"))))
    tool = F.when(k == 0, "apply_patch").when(k == 1, "Bash").when(k == 2, "mcp__fs__Read").otherwise("write_file")
    found = table(spark, d, "pages").select("page_id", touches(tool, given, F.lit("/work")).alias("t"))
    return found.select("page_id", F.inline("t"))


@query("""
select event_id, substr(sha256(event_id::varchar), 1, 9) as sha, 'subject ' || event_type as subject from events where event_id % 3 <> 1""")
def extract_commits(spark, d):
    """Commits that a tool's output made; a log of others, without git's own summary, makes none."""
    sha = F.substring(F.sha2(F.col("event_id").cast("string").cast("binary"), 256), 1, 9)
    line = F.concat(F.lit("[main "), F.when(F.col("event_id") % 3 == 0, "").otherwise("(root-commit) "), sha, F.lit("] subject "), "event_type")
    output = F.concat(F.lit("noise [x]\n"), line, F.lit("\n"), line, F.when(F.col("event_id") % 3 == 1, "\n").otherwise("\n 1 file changed, 2 insertions(+)"))
    output = F.when(F.col("event_id") % 3 == 1, F.replace(output, F.lit("(root-commit) "), F.lit(""))).otherwise(output)
    return table(spark, d, "events").select("event_id", F.inline(commits_in(output)))


@query("""
select event_id, case event_id % 5 when 0 then event_id::varchar when 1 then event_id::varchar when 2 then event_id::varchar when 3 then event_id::varchar end as number, case event_id % 5 when 1 then 'own/re-po' when 2 then 'a.b/c' when 3 then 'g/r' end as repo,
 case when event_id % 2 = 0 then event_id::varchar end as linked, case when event_id % 2 = 0 and event_id % 3 = 0 then 'own/repo' end as linked_repo from events""")
def pull_requests(spark, d):
    """References as typed, and payloads of links; what is neither gives nulls."""
    n, k = F.col("event_id").cast("string"), F.col("event_id") % 5
    ref = F.when(k == 0, F.concat(F.lit("#"), n)).when(k == 1, F.concat(F.lit("own/re-po#"), n)).when(k == 2, F.concat(F.lit("https://h.org/a.b/c/pull/"), n, F.lit("/"))).when(k == 3, F.concat(F.lit("https://h.org/g/r/-/merge_requests/"), n)).otherwise(F.concat(n, F.lit(" or so")))
    payload = F.concat(F.lit('{"number": "'), F.when(F.col("event_id") % 2 == 0, n).otherwise("x"), F.lit('", "repo": "'), F.when(F.col("event_id") % 3 == 0, "own/repo").otherwise("not a repo"), F.lit('"}'))
    return table(spark, d, "events").select("event_id", pr_reference(ref)["number"].alias("number"), pr_reference(ref)["repo"].alias("repo"), pull_request(payload)["number"].alias("linked"), pull_request(payload)["repo"].alias("linked_repo"))


@query()
def bm25_stemmed(spark, d):
    """Stemmed mode: stems are made once per distinct word, and joined back to the postings."""
    posted = search.postings(messages(spark, d), doc_id="event_id")
    vocabulary = posted.select("term").distinct().select("term", stems(F.array("term"))[0].alias("stem"))
    return posted.join(vocabulary, "term").filter(F.col("stem").isin("that", "from", "licens")).groupBy("stem").agg(F.count_distinct("doc_id").alias("df"), F.sum("tf").alias("tf"))


@query("""
with t as (select doc_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where lang = 'en'), h as (select doc_id, text from t where list_contains(w, 'license'))
select doc_id, substr(text, 1, 300) as snippet from h""")
def snippets(spark, d):
    hit = table(spark, d, "documents").filter("lang = 'en'").filter(F.array_contains(tokens(F.col("text")), "license"))
    return hit.select("doc_id", F.substring("text", 1, 300).alias("snippet"))


_END = "(?:s|es|ed|d|ing|ion|ions|ly)?"


@query(f"""
with w as (select doc_id, lower(text) as l, length(text) as chars, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') as words from documents), r as (select doc_id, l, chars, len(words) as dl, len(list_filter(words, lambda x: x = 'license')) as a, len(list_filter(words, lambda x: x = 'version')) as b, len(list_filter(words, lambda x: x = 'the')) as c from w),
 n as (select count(*) as n, avg(dl) as avgdl, count(*) filter (where a > 0) as da, count(*) filter (where b > 0) as db, count(*) filter (where c > 0) as dc from r),
 s as (select r.*, greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) as sa, greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)) as sb, greatest(ln((n - dc + 0.5) / (dc + 0.5)), 1e-6) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * dl / avgdl)) as sc from r, n),
 p0 as (select *, round(sc + sa + sb, 6) as s0 from s where a > 0 and b > 0 and c > 0 order by s0 desc, doc_id limit 200), p1 as (select *, round(sa + sb, 6) as s0 from s where a > 0 or b > 0 order by s0 desc, doc_id limit 200),
 u as (select *, 0 as pass from p0 union all select *, 1 from p1 where (select count(*) from p0) < 200 and doc_id not in (select doc_id from p0)), k as (select *, row_number() over (order by pass, s0 desc, doc_id) - 1 as place, max(s0) over () as peak from u),
 f as (select *, regexp_matches(l, '\\blicense{_END}\\b')::int + regexp_matches(l, '\\bversion{_END}\\b')::int as present, length(regexp_extract(l, '(?s)^(.*?)\\blicense{_END}\\b', 1)) as x, length(regexp_extract(l, '(?s)^(.*?)\\bversion{_END}\\b', 1)) as y from k),
 g as (select *, case when contains(l, 'license version') then 3.0 when present < 2 then 0.0 when abs(x - y) < 100 then 2.0 when abs(x - y) < 300 then 1.0 else 0.0 end as bonus from f),
 h as (select doc_id, present, round(100 * (present / greatest(1.0::double, chars / 500.0::double)) + 50 * bonus + 100 * round(61.0::double / (61 + place), 6) + 100 * round(greatest(s0, 0) / peak, 6), 6) as score, place from g),
 o as (select *, row_number() over (order by score desc, place) as position, count(*) over () as total from h)
select doc_id, score, case when present >= 2 then 'strong' when present = 0 then 'weak' else 'partial' end as verdict, position::bigint as position, total::bigint as total, ceil(total / 20.0)::bigint as pages from o where position <= 20""")
def search_full(spark, d):
    """A plain query from its text to a page: strict pass, looser pass, features, score, verdict."""
    docs = table(spark, d, "documents")
    hits = search.search(index_of(docs, "documents"), docs, "the License, version?", now="2024-02-01")
    return hits.select("doc_id", "score", "verdict", "position", "total", "pages")
