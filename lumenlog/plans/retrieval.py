"""Lexical retrieval, fusion and ranking over documents and the conversation log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenlog.functions.query import Both, Either, Phrase, Without, any_of
from lumenlog.functions.text import ascii_lower, context_lines as lines_around, tokens
from lumenlog.operators import ranking, search
from lumenlog.operators.index import index_of
from lumenlog.plans.base import MESSAGES, messages, registry, table

QUERIES, query = registry()

TERMS = ["that", "from", "thation"]
WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _bm25_sql(source: str, key: str, terms: list[str], keep: str, k: int) -> str:
    tf = ", ".join(f"len(list_filter(words, lambda w: w = '{t}')) as tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) filter (where tf{i} > 0) as df{i}" for i in range(len(terms)))
    part = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    return f"""
with d as (select {key} as doc_id, {WORDS} as words from {source} t), r as (select doc_id, words, len(words) as dl, {tf} from d),
     s as (select count(*) as n, avg(dl) as avgdl, {df} from r), x as (select doc_id, round({part}, 6) as score from r, s where {keep})
select doc_id, score from x order by score desc, doc_id limit {k}"""


_PHRASES = [Phrase((t,)) for t in TERMS]


def _documents(spark, d):
    """The documents and their index, which is built once for the files."""
    docs = table(spark, d, "documents")
    return docs, index_of(docs, "documents")


def _any(terms):
    return " or ".join(f"tf{i} > 0" for i in range(len(terms)))


def _top(scored, k):
    return search.top(scored.withColumn("score", F.round("score", 6)), k)


@query(_bm25_sql(MESSAGES, "event_id", ["that", "avec", "from"], _any("abc"), 20))
def bm25_topk(spark, d):
    return _top(search.bm25(index_of(messages(spark, d), "messages", "event_id"), any_of(["that", "avec", "from"])), 20)


@query(_bm25_sql("documents", "doc_id", TERMS, "tf0 > 0 and tf1 > 0", 50))
def bm25_and(spark, d):
    return _top(search.bm25(_documents(spark, d)[1], Both(_PHRASES[0], _PHRASES[1]), _PHRASES), 50)


@query(_bm25_sql("documents", "doc_id", TERMS, _any(TERMS), 50))
def bm25_or(spark, d):
    return _top(search.bm25(_documents(spark, d)[1], any_of(TERMS)), 50)


@query(_bm25_sql("documents", "doc_id", TERMS, "tf0 > 0 and tf1 = 0", 50))
def bm25_not(spark, d):
    return _top(search.bm25(_documents(spark, d)[1], Without(_PHRASES[0], _PHRASES[1]), _PHRASES), 50)


@query(f"select term, count(*)::bigint as df from (select unnest(list_distinct({WORDS})) as term from documents) group by term having count(*) >= 20")
def tokenize_df(spark, d):
    return search.document_frequencies(table(spark, d, "documents")).filter("df >= 20")


@query(f"select term, doc_id, count(*)::bigint as tf from (select doc_id, unnest({WORDS}) as term from documents) where term in ('the', 'token', 'licensed') group by all")
def postings_of_terms(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.filter(tokens(F.col("text")), lambda w: w.isin("the", "token", "licensed")).alias("words"))
    return docs.select(F.explode("words").alias("term"), "doc_id").groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


@query(f"select doc_id from (select doc_id, {WORDS} as w from documents) where list_has_any(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), ['of the', 'in the'])")
def phrase_match(spark, d):
    return search.matched(_documents(spark, d)[1], Either(Phrase(("of", "the")), Phrase(("in", "the"))))


@query(f"select doc_id from documents where contains({LOWER}, 'license, version')")
def substring_scan(spark, d):
    return table(spark, d, "documents").filter(search.contains(F.col("text"), "License, Version")).select("doc_id")


@query(f"select doc_id from documents where contains({LOWER}, 'license, version')")
def substring_trigram(spark, d):
    return search.contains_indexed(*_documents(spark, d), "License, Version").select("doc_id")


@query(f"select doc_id from documents where contains({LOWER}, 'token = ') or contains({LOWER}, '@mail') or contains({LOWER}, '100%_')")
def substring_union(spark, d):
    return table(spark, d, "documents").filter(search.contains_any(F.col("text"), ["TOKEN = ", "@mail", "100%_"])).select("doc_id")


@query(f"select doc_id from documents where starts_with({LOWER}, 'the ')")
def startswith_scan(spark, d):
    return table(spark, d, "documents").filter(search.starts_with(F.col("text"), "The ")).select("doc_id")


@query("""
with a as (select doc_id, row_number() over (order by doc_id desc) as rank from documents where contains(text, 'Apache License') order by doc_id desc limit 40),
     b as (select doc_id, row_number() over (order by doc_id desc) as rank from documents where contains(text, 'License') order by doc_id desc limit 40),
     c as (select doc_id, row_number() over (order by doc_id desc) as rank from documents where contains(text, 'the') order by doc_id desc limit 40),
     ab as (select doc_id, 0 as pass_no, rank from a union all select doc_id, 1, rank from b where (select count(*) from a) < 40 and doc_id not in (select doc_id from a)),
     abc as (select * from ab union all select doc_id, 2, rank from c where (select count(*) from ab) < 40 and doc_id not in (select doc_id from ab))
select doc_id, pass_no::bigint as pass_no, rank::bigint as rank from abc""")
def match_ladder(spark, d):
    """Three passes of ever looser literals: a later one only while the pool is short, and then whole."""
    docs = table(spark, d, "documents")

    def newest(needle):
        return lambda n: docs.filter(F.contains("text", F.lit(needle))).select("doc_id", F.lit(None).cast("double").alias("score")).orderBy(F.desc("doc_id")).limit(n)

    pool = search.ladder([(newest("Apache License"), True), (newest("License"), False), (newest("the"), False)], 40)
    return spark.createDataFrame([x[:3] for x in pool], "doc_id long, pass_no long, rank long")


@query("""
select doc_id, lang, source from documents where doc_id in (select doc_id from labels where quality = 1)""")
def scope_semi(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("select doc_id, lang, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) and source <> 'src0'")
def scope_anti(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source").filter("source != 'src0'").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("select event_id, user_id, event_type from events where ts >= timestamp '2024-01-10' - interval 36 hour and ts <= timestamp '2024-01-10'")
def scope_time(spark, d):
    until = F.lit("2024-01-10").cast("timestamp")
    return table(spark, d, "events").filter(F.col("ts").between(until - F.expr("interval 36 hours"), until)).select("event_id", "user_id", "event_type")


@query("select min(doc_id) as doc_id, count(*)::bigint as copies from documents group by source, trim(text, chr(10) || chr(32))")
def dedup_content(spark, d):
    return table(spark, d, "documents").groupBy("source", F.trim(F.col("text"), F.lit("\n ")).alias("t")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query("""
with t as (select event_id, user_id, event_type, row_number() over (order by event_id desc) as rank from events order by event_id desc limit 5000), p as (select * from t where rank <= 200),
     f as (select count(distinct (user_id, event_type)) * 2 < count(*) and count(*) = 200 as flooded from p), r as (select arg_min(event_id, rank) as event_id, min(rank) as rank from t group by user_id, event_type)
select event_id, rank::bigint as rank from p union select r.event_id, r.rank::bigint from r, f where flooded""")
def flood_fold(spark, d):
    """The newest 200 events as a pool; where copies fill most of it, the best of each content among the newest 5000 joins."""
    newest = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return search.flood_rescan(newest, [F.desc("event_id")], ["user_id", "event_type"], "event_id", 200)


_A = _bm25_sql("documents", "doc_id", TERMS, _any(TERMS), 100)


@query(f"""
with lex as (select doc_id, row_number() over (order by score desc, doc_id) as rank from ({_A})),
     q as (select embedding as v from embeddings where vec_id = 0),
     sem as (select vec_id as doc_id, row_number() over (order by round(list_inner_product(embedding::double[], q.v::double[]), 5) desc, vec_id) as rank from embeddings, q),
     arms as (select * from lex union all select * from sem where rank <= 100), f as (select doc_id, sum(1.0::double / (60 + rank)) as raw from arms group by doc_id)
select doc_id, round(raw / max(raw) over (), 6) as rrf from f""")
def rrf_two_arms(spark, d):
    from lumenlog.operators.vectors import knn

    vectors = table(spark, d, "embeddings")
    probe = vectors.filter("vec_id = 0").select("embedding").first()[0]
    semantic = knn(vectors, probe, 100, key="vec_id").select(F.col("vec_id").alias("doc_id"), "score")
    return ranking.rrf([ranking.ranked(_top(search.bm25(_documents(spark, d)[1], any_of(TERMS)), 100), "lex"), ranking.ranked(semantic, "sem")])


@query("select doc_id, round(case when max(n_chars) over () = min(n_chars) over () then 0 else (n_chars - min(n_chars) over ())::double / (max(n_chars) over () - min(n_chars) over ()) end, 6) as spread from documents where lang = 'es'")
def minmax_spread(spark, d):
    pool = table(spark, d, "documents").filter("lang = 'es'").select("doc_id", "n_chars")
    sums = pool.agg(F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))  # one row, instead of a window over all
    return pool.crossJoin(F.broadcast(sums)).select("doc_id", F.round(F.when(F.col("high") == F.col("low"), 0.0).otherwise((F.col("n_chars") - F.col("low")) / (F.col("high") - F.col("low"))), 6).alias("spread"))


def _hits(t):
    tail = "(?:s|es|ed|d|ing|ion|ions|ly)?" if len(t) >= 4 else ""
    return f"len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: regexp_full_match(w, '{t}{tail}')))"


_PRESENT = " + ".join(f"({_hits(t)} > 0)::int" for t in TERMS)
_DENSITY = f"(({_PRESENT}) / greatest(1.0::double, length(text) / 500.0::double))"


@query(f"select doc_id, case when present >= 2 then 'strong' when present = 0 then 'weak' else 'partial' end as verdict from (select doc_id, {_PRESENT} as present from documents)")
def verdict_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", ranking.verdict(ranking.terms_present(F.col("text"), TERMS), len(TERMS)).alias("verdict"))


@query(f"""
with x as (select doc_id, round(100 * {_DENSITY} + greatest(1, floor(20 * exp(-(doc_id % 500) / 72.0::double)))::int, 6) as score from documents where lang = 'en')
select doc_id, score from x order by score desc, doc_id limit 100""")
def score_rank(spark, d):
    docs = table(spark, d, "documents").filter("lang = 'en'")
    made = ranking.score({"density": ranking.density(F.col("text"), TERMS), "recency": ranking.recency((F.col("doc_id") % 500).cast("double")).cast("double")})
    return search.top(docs.select("doc_id", F.round(made, 6).alias("score")), 100)


@query("""
with pool as (select doc_id, n_chars from documents order by n_chars desc, doc_id limit 200), p as (select *, row_number() over (order by n_chars desc, doc_id) as position, count(*) over () as total from pool)
select doc_id, n_chars, position::bigint as position, total::bigint as total, ceil(total / 20.0)::bigint as pages from p where position between 41 and 60""")
def page_slice(spark, d):
    pool = table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(200)
    return ranking.page(pool, [F.desc("n_chars"), F.col("doc_id")], 3, 20).withColumn("position", F.col("position").cast("long"))


@query(f"""
with m as (select event_id, thread_id from {MESSAGES} where contains({LOWER}, 'tion') order by event_id desc limit 200)
select count(*)::bigint as events, count(distinct thread_id)::bigint as threads, count(*) = 200 as capped from m""")
def count_capped(spark, d):
    newest = messages(spark, d).filter(search.contains(F.col("text"), "tion")).select("event_id", "thread_id").orderBy(F.desc("event_id")).limit(200)
    return newest.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("thread_id").alias("threads")).withColumn("capped", F.col("events") == 200)


@query(f"select thread_id, count(*)::bigint as hits from {MESSAGES} where contains({LOWER}, 'the') group by thread_id")
def tally_by_thread(spark, d):
    return messages(spark, d).filter(search.contains(F.col("text"), "the")).groupBy("thread_id").agg(F.count(F.lit(1)).alias("hits"))


@query("select doc_id from documents order by sha256(doc_id::varchar), doc_id limit 100")
def sample_hash(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), "doc_id").limit(100)


@query("""
select doc_id, i::int as chunk, substr(text, (i * 1500 + 1)::int, 1500) as content from (select doc_id, text, unnest(range(0, greatest(1, least(8, ceil(length(text) / 1500.0)::int)))) as i from documents)""")
def chunk_text(spark, d):
    n = F.greatest(F.lit(1), F.least(F.lit(8), F.ceil(F.length("text") / 1500).cast("int")))
    return table(spark, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).select("doc_id", "chunk", F.expr("substring(text, chunk * 1500 + 1, 1500)").alias("content"))


@query("""
with l as (select doc_id, string_split(text, chr(10)) as lines from documents), h as (select doc_id, lines, list_position(list_transform(lines, lambda x: contains(lower(x), 'license') or contains(lower(x), 'version')), true) as hit from l),
     w as (select doc_id, hit, lines, list_transform(range(greatest(1, hit - 1), least(len(lines), hit + 1) + 1), lambda i: (case when i = hit then '>>>' else '   ' end) || ' ' || i || ': ' || lines[i]) as shown from h)
select doc_id, case when hit > 0 then array_to_string(shown, chr(10)) else array_to_string(list_slice(lines, 1, 3), chr(10)) end as context from w""")
def context_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", lines_around(F.col("text"), "how is the License version", 1).alias("context"))


@query("""
with p as (select doc_id, length(text)::bigint as length, row_number() over (order by doc_id) - 1 as position from documents)
select doc_id, length, (position // 256)::bigint as block, row_number() over (partition by position // 256 order by length, doc_id)::bigint as place from p""")
def length_window_sort(spark, d):
    """Documents by length within windows of 256 positions."""
    docs = ranking.numbered(table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("length")), "doc_id")
    blocked = docs.select("doc_id", "length", F.floor(F.col("position") / 256).alias("block"))
    return blocked.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("length", "doc_id")).cast("long"))


@query(f"select event_id, {LOWER} as folded from {MESSAGES} where role = 'system'")
def ascii_folding(spark, d):
    return messages(spark, d).filter("role = 'system'").select("event_id", ascii_lower(F.col("text")).alias("folded"))


@query("""
select doc_id from documents where contains(text, 'GNU') union select doc_id from documents where contains(text, 'Apache') except select doc_id from labels where quality = 0""")
def set_scopes(spark, d):
    docs = table(spark, d, "documents")
    either = docs.filter(F.contains("text", F.lit("GNU")) | F.contains("text", F.lit("Apache"))).select("doc_id").distinct()
    return either.join(table(spark, d, "labels").filter("quality = 0").select("doc_id"), "doc_id", "left_anti")


@query("select doc_id from documents where lang = 'en' intersect select doc_id from labels where toxic = 1")
def set_intersect(spark, d):
    return table(spark, d, "documents").filter("lang = 'en'").select("doc_id").intersect(table(spark, d, "labels").filter("toxic = 1").select("doc_id"))
