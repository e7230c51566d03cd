"""Vectors and graph, code provenance, knowledge graph, evaluation and relational queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenlog.functions.text import tokens
from lumenlog.operators import evaluation, provenance, ranking, vectors
from lumenlog.plans.base import registry, table

QUERIES, query = registry()


def _probe(spark, d):
    return table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


_DOT = "round(list_inner_product(embedding::double[], q.v::double[]), 5)"
_Q = "(select embedding as v from embeddings where vec_id = 0) q"


@query(f"select vec_id, {_DOT} as score from embeddings, {_Q} order by score desc, vec_id limit 10")
def knn_top10(spark, d):
    return vectors.knn(table(spark, d, "embeddings"), _probe(spark, d), 10)


@query(f"select vec_id, {_DOT} as score from embeddings, {_Q} where label in (1, 2) order by score desc, vec_id limit 10")
def knn_scoped(spark, d):
    return vectors.knn(table(spark, d, "embeddings").filter(F.col("label").isin(1, 2)), _probe(spark, d), 10)


@query(f"select vec_id % 50 as doc, max({_DOT}) as score from embeddings, {_Q} group by 1 order by score desc, doc limit 10")
def knn_maxpool(spark, d):
    return vectors.knn_pooled(table(spark, d, "embeddings"), _probe(spark, d), 10, F.col("vec_id") % 50)


_UNIT = "(select label, vec_id, list_transform(embedding::double[], lambda x: x / sqrt(list_inner_product(embedding::double[], embedding::double[]))) as u from embeddings)"


@query(f"""
with e as (select label, generate_subscripts(u, 1) as i, unnest(u) as x from {_UNIT}), m as (select label, i, avg(x) as x from e group by all), n as (select label, sqrt(sum(x * x)) as n from m group by 1)
select m.label, m.i::int as i, round(m.x / n.n, 5) as x from m join n on m.label = n.label""")
def centroid_by_label(spark, d):
    c = vectors.centroids(table(spark, d, "embeddings"), "label")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), F.round("x", 5).alias("x"))


@query(f"""
with p as (select a.vec_id as q, b.vec_id as b, round(list_inner_product(a.u, b.u), 6) as weight from {_UNIT} a join {_UNIT} b on a.vec_id <> b.vec_id),
 r as (select *, row_number() over (partition by q order by weight desc, b) as r from p where weight >= 0.3)
select least(q, b) as a, greatest(q, b) as b, max(weight) as weight from r where r <= 10 group by 1, 2""")
def knn_graph_edges(spark, d):
    return vectors.knn_edges(table(spark, d, "embeddings"), 10, 0.3)


@query()
def communities(spark, d):
    return vectors.communities(vectors.knn_edges(table(spark, d, "embeddings"), 10, 0.3))


@query(f"""
with r as (select vec_id, label, row_number() over (order by {_DOT} desc, vec_id) as rank from embeddings, {_Q}), m as (select label, sum(1.0::double / rank) as mass from r where rank <= 10 group by 1)
select r.vec_id, round(1.0::double / (60 + r.rank) + 0.005 * coalesce(m.mass, 0), 6) as score from r left join m on r.label = m.label where r.rank <= 50""")
def coherence_order(spark, d):
    e = table(spark, d, "embeddings")
    pool = ranking.ranked(vectors.knn(e, _probe(spark, d), 50, key="vec_id"), "sem", key="vec_id").join(e.select("vec_id", "label"), "vec_id")
    mass = pool.filter("rank <= 10").groupBy("label").agg(F.sum(1.0 / F.col("rank")).alias("mass"))
    return pool.join(mass, "label", "left").select("vec_id", F.round(1.0 / (60 + F.col("rank")) + 0.005 * F.coalesce("mass", F.lit(0.0)), 6).alias("score"))


_TOUCH = """(select page_id as event_id, page_id % 9 as thread_id, regexp_replace(split_part(url, '?', 1), '^https?://[^/]*', '') as path, regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1) as basename,
 case page_id % 4 when 0 then 'edit' when 1 then 'write' when 2 then 'delete' else 'read' end as op from pages)"""


def _touches(spark, d):
    plain = F.split_part("url", F.lit("?"), F.lit(1))
    op = F.element_at(F.array(*[F.lit(x) for x in provenance.OPERATIONS[:4]]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select(F.col("page_id").alias("event_id"), (F.col("page_id") % 9).alias("thread_id"), F.regexp_replace(plain, "^https?://[^/]*", "").alias("path"), F.regexp_extract(plain, "([^/]*)$", 1).alias("basename"), op.alias("op"))


@query(f"""
with t as (select *, case op when 'edit' then 0 when 'write' then 1 when 'delete' then 2 else 3 end as r from {_TOUCH} where starts_with(path, '/fr/') or starts_with(path, '/en/'))
select thread_id, count(*)::bigint as touches, count(distinct path)::bigint as paths, min(event_id) as first_event, max(event_id) as last_event, arg_min(event_id, r::bigint * 1000000000 - event_id) as anchor from t group by thread_id""")
def path_blame(spark, d):
    t = _touches(spark, d)
    t = t.filter(provenance.path_predicate(F.col("path"), F.col("basename"), "/fr") | provenance.path_predicate(F.col("path"), F.col("basename"), "/en"))
    whole = t.groupBy("thread_id").agg(F.count(F.lit(1)).alias("touches"), F.count_distinct("path").alias("paths"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
    return whole.join(provenance.anchor(t, ["thread_id"]), "thread_id")


@query(f"select event_id, path from {_TOUCH} where regexp_full_match(path, '/(en|de)/[0-9]*5')")
def path_glob(spark, d):
    t = _touches(spark, d)
    return t.filter(provenance.path_predicate(F.col("path"), F.col("basename"), "/en/*5") | provenance.path_predicate(F.col("path"), F.col("basename"), "/de/*5")).select("event_id", "path")


_REPO_TOUCH = """(select page_id as event_id, case page_id % 6 when 0 then '/repo/_search/Rank.py' when 1 then '/other/rank.py' when 2 then '/repo/_search/rank.py/x.py' when 3 then '/repo/_search/rank.py' when 4 then 'rank.py' else '/repo/docs/_search/notes' end as path from pages)"""


@query(f"""
with t as (select event_id, path, regexp_extract(path, '([^/]*)$', 1) as basename, lower(path) as l from {_REPO_TOUCH})
select event_id, 'part' as shape from t where basename = 'rank.py' and (ends_with(l, '/_search/rank.py') or contains(l, '/_search/rank.py/')) union all select event_id, 'folder' from t where ends_with(l, '/docs/_search') or contains(l, '/docs/_search/')
union all select event_id, 'name' from t where basename = 'rank.py' union all select event_id, 'absolute' from t where path = '/repo/_search/rank.py' or starts_with(path, '/repo/_search/rank.py/') union all select event_id, 'glob' from t where regexp_full_match(path, '.*rank.p.')""")
def path_shapes(spark, d):
    """Each form of a path pattern, over paths that tell them apart."""
    paths = ["/repo/_search/Rank.py", "/other/rank.py", "/repo/_search/rank.py/x.py", "/repo/_search/rank.py", "rank.py", "/repo/docs/_search/notes"]
    t = table(spark, d, "pages").select(F.col("page_id").alias("event_id"), F.element_at(F.array(*[F.lit(p) for p in paths]), (F.col("page_id") % 6 + 1).cast("int")).alias("path"))
    t = t.withColumn("basename", F.regexp_extract("path", "([^/]*)$", 1))
    shapes = {"part": "_search/rank.py", "folder": "docs/_search", "name": "rank.py", "absolute": "/repo/_search/rank.py", "glob": "*rank.p?"}
    found = F.filter(F.array(*[F.when(provenance.path_predicate(F.col("path"), F.col("basename"), p), F.lit(s)) for s, p in shapes.items()]), lambda s: s.isNotNull())
    return t.select("event_id", F.explode(found).alias("shape"))


@query(f"select thread_id, string_agg(op || ':' || n, ',' order by op) as ops, sum(n)::bigint as touches from (select thread_id, op, count(*) as n from {_TOUCH} group by all) group by thread_id")
def thread_files(spark, d):
    t = provenance.tally(_touches(spark, d), ["thread_id"])
    return t.select("thread_id", F.array_join(F.transform("ops", lambda s: F.concat_ws(":", s["op"], s["n"].cast("string"))), ",").alias("ops"), "touches")


def _commit_share(lineitem, orders):
    f = lineitem.select((F.col("l_orderkey") % 200).alias("commit_id"), (F.col("l_partkey") % 50).alias("path")).distinct()
    t = orders.select((F.col("o_custkey") % 20).alias("thread_id"), (F.col("o_orderkey") % 50).alias("path")).distinct()
    n = f.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n"))
    return f.join(t, "path").groupBy("commit_id", "thread_id").agg(F.count(F.lit(1)).alias("matched")).join(n, "commit_id").select("commit_id", "thread_id", "matched", F.round(F.col("matched") / F.col("n"), 3).alias("share"))


@query("""
with f as (select distinct l_orderkey % 200 as commit_id, l_partkey % 50 as path from lineitem), t as (select distinct o_custkey % 20 as thread_id, o_orderkey % 50 as path from orders), n as (select commit_id, count(*) as n from f group by 1)
select f.commit_id, t.thread_id, count(*)::bigint as matched, round(count(*)::double / max(n.n), 3) as share from f join t on f.path = t.path join n on n.commit_id = f.commit_id group by 1, 2""")
def commit_share(spark, d):
    return _commit_share(table(spark, d, "lineitem"), table(spark, d, "orders"))


@query("select o_custkey % 40 as thread_id, o_orderpriority as ref, min(o_orderdate) as first_at, max(o_orderdate) as last_at, max(o_orderkey) as last_event from orders where o_orderstatus = 'F' group by 1, 2")
def pr_sessions(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return o.groupBy((F.col("o_custkey") % 40).alias("thread_id"), F.col("o_orderpriority").alias("ref")).agg(F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), F.max("o_orderkey").alias("last_event"))


@query("""
with c as (select o_orderkey as commit_id, o_custkey as path, o_orderdate as ceiling, lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as floor from orders where o_orderstatus = 'P'), t as (select o_orderkey as event_id, o_custkey as path, o_orderdate as at from orders where o_orderstatus = 'F')
select c.commit_id, count(*)::bigint as touches from c join t on c.path = t.path and t.at <= c.ceiling and (c.floor is null or t.at > c.floor) group by 1""")
def interval_window(spark, d):
    o = table(spark, d, "orders")
    rows = lambda status, *more: o.filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("path"), F.col("o_orderdate").alias("at"), *more)
    found = provenance.by_next(rows("F"), rows("P", F.col("o_orderkey").alias("commit_id")), "path", "at", "commit_id")
    return found.groupBy("commit_id").agg(F.count(F.lit(1)).alias("touches"))


def _join_prefix(customer, orders):
    sha = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256)
    a = customer.select("c_custkey", sha("c_custkey").alias("full_sha"))
    b = orders.select("o_orderkey", F.substring(sha("o_custkey"), 1, 7).alias("short"))
    return provenance.prefix_either_way(a, b, "full_sha", "short").select("c_custkey", "o_orderkey")


@query("""
with a as (select c_custkey, sha256(c_custkey::varchar) as full_sha from customer), b as (select o_orderkey, substr(sha256((o_custkey)::varchar), 1, 7) as short from orders)
select a.c_custkey, b.o_orderkey from a join b on starts_with(a.full_sha, b.short)""")
def join_prefix(spark, d):
    return _join_prefix(table(spark, d, "customer"), table(spark, d, "orders"))


@query("select doc_id, regexp_extract(text, '(License|Licence)[, ]+[Vv]ersion ([0-9.]+)', 2) as version from documents where regexp_matches(text, '(License|Licence)[, ]+[Vv]ersion [0-9.]+')")
def extract_refs(spark, d):
    pattern = "(License|Licence)[, ]+[Vv]ersion ([0-9.]+)"
    return table(spark, d, "documents").filter(F.col("text").rlike(pattern)).select("doc_id", F.regexp_extract("text", pattern, 2).alias("version"))


@query("""
with l as (select o_custkey as a, (o_custkey * 7 + o_orderkey % 5) % 100 as b, o_orderkey as id, o_orderstatus = 'F' as gone from orders)
select a, b, arg_max(id, id) as id from l group by a, b having not arg_max(gone, id)""")
def link_fold(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 5) % 100).alias("b"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("gone"))
    return o.groupBy("a", "b").agg(F.max("id").alias("id"), F.max_by("gone", "id").alias("gone")).filter("not gone").select("a", "b", "id")


@query("select c.c_nationkey as topic, o.o_custkey as member, count(*)::bigint as citations from orders o join customer c on c.c_custkey = o.o_custkey group by all")
def topic_members(spark, d):
    return _topic_members(table(spark, d, "customer"), table(spark, d, "orders"))


def _topic_members(customer, orders):
    c = customer.select(F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("topic"))
    return orders.select(F.col("o_custkey").alias("member")).groupBy("member").agg(F.count(F.lit(1)).alias("citations")).join(c, "member").select("topic", "member", "citations")


@query("""
with recursive e as (select distinct n_nationkey as child, (n_nationkey - 1) // 3 as parent from nation where n_nationkey > 0),
 t as (select 0::int as node, 0 as depth, [0::int] as path union all select e.child::int, t.depth + 1, list_append(t.path, e.child::int) from t join e on e.parent = t.node where not list_contains(t.path, e.child::int))
select node, depth::int as depth, array_to_string(path, '/') as path from t""")
def topic_tree(spark, d):
    table(spark, d, "nation").filter("n_nationkey > 0").select(F.col("n_nationkey").cast("int").alias("child"), F.floor((F.col("n_nationkey") - 1) / 3).cast("int").alias("parent")).createOrReplaceTempView("tree_edges")
    return spark.sql("""
      with recursive t(node, depth, path) as (select 0, 0, array(0) union all
        select e.child, t.depth + 1, array_append(t.path, e.child) from t join tree_edges e on e.parent = t.node where not array_contains(t.path, e.child))
      select node, depth, array_join(path, '/') as path from t""")


@query(f"""
with r as (select vec_id, label, row_number() over (order by {_DOT} desc, vec_id) as rank from embeddings, {_Q}), s as (select label, count(*) as hits, sum(1.0::double / (rank + 1)) as weight from r where rank <= 40 group by 1), n as (select label, count(*) as breadth from embeddings group by 1)
select s.label, round(hits / (1 + ln(1 + breadth)), 6) as subject, round(weight, 6) as weight from s join n on s.label = n.label order by subject desc, weight desc, label limit 6""")
def subjects(spark, d):
    e = table(spark, d, "embeddings")
    seed = ranking.ranked(vectors.knn(e, _probe(spark, d), 40), "s", key="vec_id").join(e.select("vec_id", "label"), "vec_id")
    s = seed.groupBy("label").agg(F.count(F.lit(1)).alias("hits"), F.sum(1.0 / (F.col("rank") + 1)).alias("weight"))
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("breadth"))
    return s.join(n, "label").select("label", F.round(F.col("hits") / (1 + F.log(1 + F.col("breadth"))), 6).alias("subject"), F.round("weight", 6).alias("weight")).orderBy(F.desc("subject"), F.desc("weight"), "label").limit(6)


_RUN = "(select o_custkey as qid, o_orderkey as doc_id, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders)"
_RELS = "(select o_custkey as qid, o_orderkey as doc_id, case o_orderstatus when 'F' then 2 when 'P' then 1 else 0 end as rel from orders)"


def _run(spark, d):
    o = table(spark, d, "orders")
    run = o.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))
    return run, o.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("rel"))


@query(f"""
with g as (select r.qid, sum((2.0::double ** rel - 1) / log2(rank + 1)) as dcg from {_RUN} r join {_RELS} q on r.qid = q.qid and r.doc_id = q.doc_id where rank <= 10 group by 1),
 i as (select qid, sum((2.0::double ** rel - 1) / log2(r + 1)) as idcg from (select qid, rel, row_number() over (partition by qid order by rel desc, doc_id) as r from {_RELS}) where r <= 10 group by 1)
select i.qid, round(case when idcg > 0 then coalesce(dcg, 0) / idcg else 0 end, 6) as ndcg from i left join g on i.qid = g.qid""")
def ndcg(spark, d):
    return evaluation.ndcg(*_run(spark, d), 10).withColumn("ndcg", F.round("ndcg", 6))


@query(f"""
with j as (select q.qid, r.rank from {_RELS} q left join {_RUN} r on r.qid = q.qid and r.doc_id = q.doc_id where rel > 1)
select qid, round(1.0::double / min(rank), 6) as rr, (count(*) filter (where rank <= 5) > 0)::int as success_5, round(count(*) filter (where rank <= 5) / count(*)::double, 6) as recall_5, (count(*) filter (where rank <= 5) = count(*))::int as all_5 from j group by 1""")
def mrr_recall(spark, d):
    run, rels = _run(spark, d)
    return evaluation.first_gold(run, rels.withColumn("rel", F.col("rel") - 1), (5,)).withColumn("rr", F.round("rr", 6)).withColumn("recall_5", F.round("recall_5", 6))


@query("""
with e as (select event_id, user_id, event_type, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as search from events)
select user_id, count(*)::bigint as reads, count(distinct search)::bigint as clicked from e where event_type = 'click' and search is not null group by 1""")
def behavior_rates(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    reads = evaluation.attributed(e, "user_id", "event_id", F.col("event_type") == "view", F.col("event_type") == "click")
    return reads.groupBy("user_id").agg(F.count(F.lit(1)).alias("reads"), F.count_distinct("search").alias("clicked"))


@query("""
with a as (select user_id as qid, round(avg(value), 6) as v from events where event_id % 2 = 0 group by 1), b as (select user_id as qid, round(avg(value), 6) as v from events where event_id % 2 = 1 group by 1)
select a.qid, round(b.v - a.v, 6) as moved from a join b on a.qid = b.qid where a.v <> b.v order by moved, qid limit 20""")
def bench_compare(spark, d):
    e = table(spark, d, "events")
    one = lambda r, n: e.filter(F.col("event_id") % 2 == r).groupBy(F.col("user_id").alias("qid")).agg(F.round(F.avg("value"), 6).alias(n))
    return one(0, "a").join(one(1, "b"), "qid").filter("a != b").select("qid", F.round(F.col("b") - F.col("a"), 6).alias("moved")).orderBy("moved", "qid").limit(20)


@query("""
with q as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from benchmark), d as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' as t from documents)
select q.item_id, count(*)::bigint as holders from q join d on contains(d.t, ' ' || array_to_string(q.w, ' ') || ' ') group by 1""")
def passage_holders(spark, d):
    """Documents that hold all words of a passage: an equi-join of runs of eight words, or of all words of shorter passages,
    finds candidates, and the whole passage is verified in the text."""
    documents, benchmark = table(spark, d, "documents"), table(spark, d, "benchmark")
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    items = benchmark.filter("text is not null").select("item_id", tokens(F.col("text")).alias("w")).select("item_id", spaced(F.col("w")).alias("passage"), F.slice("w", 1, 8).alias("head"))
    lengths = sorted(r[0] for r in items.select(F.size("head")).distinct().collect())  # 0 to 8

    def runs(n):
        places = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        made = F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(n)), " "))) if n else F.array(F.xxhash64(F.lit("")))
        return F.when(F.size("w") >= n if n else F.size("w") == 0, made).otherwise(F.expr("cast(array() as array<bigint>)"))

    # A row is known by its file and its place there, which are the same at every read.
    at = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    words = documents.filter("text is not null").select(at.alias("row"), tokens(F.col("text")).alias("w"))
    grams = words.select("row", F.explode(F.array_distinct(F.concat(*[runs(n) for n in lengths or [8]]))).alias("h"))
    held = grams.join(items.withColumn("h", F.xxhash64(F.array_join("head", " "))), "h")
    held = held.join(words.select("row", spaced(F.col("w")).alias("t")), "row").filter(F.contains("t", "passage"))
    return held.groupBy("item_id").agg(F.count(F.lit(1)).alias("holders"))


@query("""
select n.n_name, r.r_name, count(*)::bigint as orders, round(sum(o.o_totalprice), 2) as total from orders o join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey join region r on r.r_regionkey = n.n_regionkey group by all""")
def join_inner_dim(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c.c_custkey, count(o.o_orderkey)::bigint as orders, max(o.o_orderdate) as newest from customer c left join orders o on o.o_custkey = c.c_custkey group by 1")
def join_left_counts(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderdate").alias("newest"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "newest")


@query("""
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*)::bigint as n from lineitem where l_shipdate <= timestamp '2001-01-01' group by all""")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("2001-01-01").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("select o_orderstatus, o_orderpriority, count(*)::bigint as n, grouping(o_orderpriority)::int as whole from orders group by rollup (o_orderstatus, o_orderpriority)")
def rollup_counts(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping("o_orderpriority").cast("int").alias("whole"))


@query("select c.c_custkey, last_day.o_orderkey from customer c join (select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by 1) last_day on last_day.o_custkey = c.c_custkey")
def browse_threads(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("last"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey").select("c_custkey", F.col("last.o_orderkey").alias("o_orderkey"))


@query("select p_partkey, p_name from part where lower(p_name) like '%ed%' order by p_partkey desc limit 30 offset 10")
def list_threads(spark, d):
    return table(spark, d, "part").filter(F.col("p_name").ilike("%ED%")).select("p_partkey", "p_name").orderBy(F.desc("p_partkey")).offset(10).limit(30)


@query("select source, list_slice(list_sort(list_distinct(list(lang))), 1, 25) as langs, count(distinct lang)::bigint as n from documents group by 1")
def cap_sample(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.slice(F.sort_array(F.collect_set("lang")), 1, 25).alias("langs"), F.count_distinct("lang").alias("n"))


@query("select o_orderkey, o_orderdate, o_totalprice from orders where o_orderstatus = 'O' order by o_orderdate asc nulls last, o_orderkey limit 100")
def sort_oldest(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.asc_nulls_last("o_orderdate"), "o_orderkey").limit(100)


