"""Lexical retrieval: postings, BM25, phrase, substring and prefix predicates, trigram prefilter."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.query import Both, Either, Phrase, alternatives, any_of, classify, cleaned, expression, phrases_of, terms, words_of
from lumenlog.functions.text import ascii_lower, term_pattern, tokens
from lumenlog.operators import ranking
from lumenlog.operators.index import Index

K1, B = 1.2, 0.75


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id, tf): one shuffle, with counts combined before it."""
    words = docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(F.col(text))).alias("term"))
    return words.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df) without a shuffle of postings: terms are made distinct within each document first."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def phrase(words: Column, terms: list[str]) -> Column:
    """Whether the terms stand next to each other in an array of words (which hold no spaces)."""
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(terms)} "))


def _phrase_count(words: tuple[str, ...]) -> Column:
    """How often the words stand side by side, in a row with the places `at` of each term (a map); 0 without words."""
    if not words:
        return F.lit(0)
    first = F.col("at")[words[0]]
    if len(words) == 1:
        return F.coalesce(F.size(first), F.lit(0))
    follows = lambda p: reduce(lambda a, b: a & b, [F.array_contains(F.col("at")[w], p + i) for i, w in enumerate(words[1:], 1)])
    here = reduce(lambda a, b: a & b, [F.col("at")[w].isNotNull() for w in words])
    return F.when(here, F.size(F.filter(first, follows))).otherwise(0)


def matches(tree) -> Column:
    """Whether a row of `_by_document` satisfies an expression."""
    if isinstance(tree, Phrase):
        return F.col(_name(tree)) > 0
    left, right = matches(tree.left), matches(tree.right)
    return left & right if isinstance(tree, Both) else left | right if isinstance(tree, Either) else left & ~right


def _name(phrase: Phrase) -> str:
    return "n_" + hashlib.md5(" ".join(phrase.words).encode()).hexdigest()[:12]


def _all_phrases(tree) -> list[Phrase]:
    return [tree] if isinstance(tree, Phrase) else _all_phrases(tree.left) + _all_phrases(tree.right)


def _by_document(index: Index, trees: list) -> DataFrame:
    """(doc_id, dl, count of each phrase) of documents with any term: one shuffle, of the postings of these terms only."""
    phrases = list(dict.fromkeys(p for t in trees for p in _all_phrases(t)))
    terms = sorted({w for p in phrases for w in p.words})
    if not terms:
        return index.spark.createDataFrame([], "doc_id long, dl int, " + ", ".join(f"{_name(p)} int" for p in phrases))
    rows = index.postings(terms).groupBy("doc_id").agg(F.first("dl").alias("dl"), F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("at"))
    return rows.select("doc_id", "dl", *[_phrase_count(p.words).alias(_name(p)) for p in phrases])


def matched(index: Index, tree) -> DataFrame:
    """(doc_id) of documents that satisfy an expression."""
    return _by_document(index, [tree]).filter(matches(tree)).select("doc_id")


def bm25(index: Index, keep, scored: list[Phrase] | None = None) -> DataFrame:
    """(doc_id, score) of documents that satisfy `keep`, by the phrases `scored` (those of `keep`, if not given).

    Corpus statistics are the index's; a phrase's document frequency is counted from the postings of its terms. Inverse
    frequencies have a small floor.
    """
    phrases = list(dict.fromkeys(scored if scored is not None else phrases_of(keep)))
    rows = _by_document(index, [keep, *phrases])
    docs, size, _ = index.stats()
    df = rows.agg(*[F.count(F.when(F.col(_name(p)) > 0, 1)).alias(f"df{i}") for i, p in enumerate(phrases)])
    part = []
    for i, p in enumerate(phrases):
        tf, n = F.col(_name(p)), F.col(f"df{i}")
        idf = F.greatest(F.log((F.lit(docs) - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        part.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(size / max(docs, 1)))))
    found = rows.filter(matches(keep)).crossJoin(F.broadcast(df))  # one row
    return found.select("doc_id", reduce(lambda a, b: a + b, part).alias("score"))


def top(scored: DataFrame, k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    return scored.orderBy(F.desc(score), tie).limit(k)


def contains(text: Column, needle: str) -> Column:
    """Literal infix, A-Z without case."""
    return F.contains(ascii_lower(text), F.lit(needle.translate({i: i + 32 for i in range(65, 91)})))


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [contains(text, n) for n in needles])


def starts_with(text: Column, prefix: str) -> Column:
    return F.startswith(ascii_lower(text), F.lit(prefix.translate({i: i + 32 for i in range(65, 91)})))


#: Documents up to which candidates of trigrams are looked at one by one; with more, scanning all is cheaper.
MOST_CANDIDATES = 2000


def contains_indexed(docs: DataFrame, index: Index, needle: str, doc_id: str = "doc_id", text: str = "text", most: int = MOST_CANDIDATES) -> DataFrame:
    """Rows that contain `needle`. Candidates hold all its trigrams, then the exact predicate decides; a needle without
    trigrams, or with more than `most` candidates, is looked for in all rows."""
    folded = needle.translate({i: i + 32 for i in range(65, 91)})
    grams = sorted({folded[i : i + 3] for i in range(len(folded) - 2)})
    exact = contains(F.col(text), needle)
    if not grams:
        return docs.filter(exact)
    holding = index.grams(grams).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select("doc_id")
    few = [r[0] for r in holding.limit(most + 1).collect()]
    return docs.filter(exact) if len(few) > most else docs.filter(F.col(doc_id).isin(few) & exact)


def ladder(passes: list, limit: int) -> list[tuple[int, int, int, float | None]]:
    """(doc_id, pass number, rank in it, score) of a pool: passes in order, the first place of a document counts.

    A pass is (build, always): a function that gives (doc_id, score) in order of rank, cut to the pool's size, which bounds what
    comes to the driver. Passes after the first only run while the pool has fewer than `limit` documents, unless `always`.
    """
    pool: dict[int, tuple[int, int, float | None]] = {}
    for number, (build, always) in enumerate(passes):
        if number and not always and len(pool) >= limit:
            continue
        for rank, (doc_id, score) in enumerate(build(limit).collect(), 1):
            pool.setdefault(doc_id, (number, rank, score))
    return [(doc_id, *at) for doc_id, at in pool.items()]


def _newest(docs: DataFrame, condition: Column, doc_id: str):
    """A pass without scores: documents that meet a condition, the newest first."""
    return lambda n: docs.filter(condition).select(F.col(doc_id).alias("doc_id"), F.lit(None).cast("double").alias("score")).orderBy(F.desc("doc_id")).limit(n)


def passes(index: Index, docs: DataFrame, query: str, match: str = "token", oldest: bool = False, prefix: str | None = None, doc_id: str = "doc_id", text: str = "text", scoped: bool = False) -> list:
    """The passes that a query asks for, by its mode; those of fallbacks come last. With `scoped`, `docs` are some of the
    index's documents, and only they are found."""

    def by_rank(tree):
        def build(n: int) -> DataFrame:
            scored = bm25(index, tree).withColumn("score", F.round("score", 6))
            if scoped:
                scored = scored.join(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
            return scored.orderBy("doc_id" if oldest else F.desc("score"), "doc_id").limit(n).select("doc_id", "score")

        return build

    mode, has_operators = classify(query)
    column = F.col(text)
    if prefix is not None:
        return [(_newest(docs, starts_with(column, prefix), doc_id), True)]
    if match == "substring":
        wanted = alternatives(query)
        return [(_newest(docs, contains_any(column, wanted), doc_id), True)] if wanted else []
    if mode == "or":
        parts = [p for p in (cleaned(x) for x in query.split("|")) if p]
        if not parts:
            return []
        return [(by_rank(any_of(parts)), True), (_newest(docs, contains_any(column, parts), doc_id), False)]
    if mode == "code":
        whole = cleaned(query)
        words = words_of(whole)
        out = [(by_rank(Phrase(words)), True)]
        if len(words) > 1:
            out += [(by_rank(reduce(Both, [Phrase((w,)) for w in words])), False), (by_rank(any_of(list(words))), False)]
        return [*out, (_newest(docs, contains(column, whole), doc_id), False)]
    strict = expression(query)
    out = [(by_rank(strict), True)]
    loose = [t for t in terms(query) if " " not in t]
    # The looser pass is for plain words only, and not where it would be the strict one again.
    if loose and not (has_operators or oldest or '"' in query) and any_of(loose) != strict:
        out.append((by_rank(any_of(loose)), False))
    return out


@dataclass(frozen=True)
class Params:
    """One configuration of the search: weights of features, sizes of pools."""

    weights: dict = field(default_factory=lambda: dict(ranking.WEIGHTS))
    recency_hours: float = 72.0
    density_chars: int = 500
    rrf_k: int = 60
    pool_floor: int = 200


def search(
    index: Index, docs: DataFrame, query: str, now: str, limit: int = 20, page: int = 1, match: str = "token", sort: str = "rank", prefix: str | None = None,
    scope: Column | None = None, similar: DataFrame | None = None, params: Params = Params(), doc_id: str = "doc_id", text: str = "text", at: str | None = None, thread: str | None = None,
    content_type: str | None = None,
) -> DataFrame:
    """One page of hits: doc_id, score, verdict, snippet, position, total, pages, exhaustive.

    The pool has max(5 limit, pool_floor) documents a pass, whatever the page, so pages never overlap. `scope` limits what
    is searched; `similar` (doc_id, score) is the semantic arm, fused by reciprocal ranks. Features: share of terms by
    length, phrases, recency at `now`, fusion, reciprocal rank, BM25 by the pool's peak, and similarity spread over the
    pool. With sort `oldest` the pool is ordered by time, undated last. An empty query without `prefix` has no hits:
    browsing is `plans`' business.
    """
    spark = docs.sparkSession
    searched = docs if scope is None else docs.filter(scope)
    over = max(limit * 5, params.pool_floor)
    structural = prefix is not None or sort == "oldest"
    found = [] if classify(query)[0] == "browse" and prefix is None else ladder(passes(index, searched, query, match, sort == "oldest", prefix, doc_id, text, scope is not None), over)
    lexical = {d: (rank, score) for rank, (d, _, _, score) in enumerate(found)}
    near = {} if similar is None or structural else {r[0]: (rank, r[1]) for rank, r in enumerate(similar.orderBy(F.desc("score"), "doc_id").limit(over).collect())}
    pool = list(dict.fromkeys([*lexical, *near]))
    if near:
        raw = {d: sum(1 / (params.rrf_k + 1 + arm[d][0]) for arm in (lexical, near) if d in arm) for d in pool}
        pool = sorted(pool, key=lambda d: (-raw[d], d))[:over]
    peak = max((s or 0 for _, s in lexical.values()), default=0)
    low, high = min((near[d][1] for d in pool if d in near), default=0), max((near[d][1] for d in pool if d in near), default=0)
    top_raw = max((raw[d] for d in pool), default=1) if near else 1
    rows = []
    for place, d in enumerate(pool):
        rank, score = lexical.get(d, (None, None))
        rows.append((d, place, round(raw[d] / top_raw, 6) if near else 0.0, round((params.rrf_k + 1) / (params.rrf_k + 1 + rank), 6) if rank is not None else 0.0, round(max(score, 0) / peak, 6) if score is not None and peak > 0 else 0.0, (near[d][1] - low) / (high - low) if d in near and high > low else 0.0))
    if not rows:
        return spark.createDataFrame([], "doc_id long, score double, verdict string, snippet string, position long, total long, pages long, exhaustive boolean")
    made = spark.createDataFrame(rows, "doc_id long, place int, rrf double, lex double, bm25 double, semantic double")
    wanted = terms(query)
    body, when = F.col(text), F.col(at) if at else F.lit(None).cast("timestamp")
    kinds = F.create_map(*[F.lit(x) for k, w in ranking.TYPE_WEIGHTS.items() for x in (k, w)])
    hits = searched.filter(F.col(doc_id).isin(pool)).withColumn("__id", F.col(doc_id)).join(F.broadcast(made.withColumnRenamed("doc_id", "__pool")), F.col("__id") == F.col("__pool"))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(when.cast("timestamp"))) / 3_600_000_000
    features = {
        "density": ranking.density(body, wanted, params.density_chars), "phrase": ranking.phrase_bonus(body, wanted), "recency": ranking.recency(F.when(age.isNotNull(), F.greatest(age, F.lit(0.0))), params.recency_hours).cast("double"),
        "rrf": F.col("rrf"), "lex": F.col("lex"), "bm25": F.col("bm25"), "semantic": F.col("semantic"),
    }
    total = ranking.score(features, params.weights) * (F.coalesce(kinds[F.col(content_type)], F.lit(1.0)) if content_type else F.lit(1.0))
    scored = hits.select(F.col("__id").alias("doc_id"), "place", F.round(total, 6).alias("score"), ranking.verdict(ranking.terms_present(body, wanted), len(wanted)).alias("verdict"), snippet(body, wanted).alias("snippet"), when.alias("at"), (F.col(thread) if thread else F.col(doc_id)).alias("thread"), F.md5(F.trim(body)).alias("content"))
    first = scored.withColumn("__r", F.row_number().over(Window.partitionBy("thread", "content").orderBy("place"))).filter("__r = 1") if thread else scored
    order = [F.col("at").asc_nulls_last(), F.col("doc_id")] if sort == "oldest" else [F.col("place")] if structural else [F.desc("score"), F.col("place")]
    paged = ranking.page(first, order, page, limit)  # windows over the pool, which is bounded
    return paged.select("doc_id", "score", "verdict", "snippet", F.col("position").cast("long").alias("position"), "total", "pages", F.lit(len(found) < over and len(near) < over).alias("exhaustive"))


def snippet(text: Column, wanted: list[str], words: int = 12, plain: int = 300) -> Column:
    """Some words around the first one that a term begins, between ellipses where more follows; without one, the head."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    starts = [t.split(" ")[0] for t in wanted]
    hit = lambda w: reduce(lambda a, b: a | b, [F.lower(w).rlike(term_pattern(t)) for t in starts], F.lit(False))
    at = F.array_position(F.transform(parts, hit), F.lit(True)).cast("int")
    begin = F.greatest(F.lit(1), F.least(at - words // 2, F.size(parts) - words + 1))
    cut = F.concat(F.when(begin > 1, " … ").otherwise(""), F.array_join(F.slice(parts, begin, words), " "), F.when(begin + words - 1 < F.size(parts), " … ").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, plain))


def flood_rescan(found: DataFrame, order: list[Column], content: list[str], key: str, limit: int, deeper: int = 5000) -> DataFrame:
    """(key, rank) of a pool: the `limit` best rows. If the pool is full and less than half of it is distinct content, the
    best row of each content among the `deeper` best joins it, so that copies don't crowd others out."""
    best = found.orderBy(*order).limit(deeper)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))  # a bounded number of rows
    pool = ranked.filter(F.col("rank") <= limit)
    flooded = pool.agg(((F.count_distinct(*content) * 2 < F.count(F.lit(1))) & (F.count(F.lit(1)) == limit)).alias("flooded"))
    firsts = ranked.groupBy(*content).agg(F.min_by(key, "rank").alias(key), F.min("rank").alias("rank")).select(key, "rank")
    return pool.select(key, "rank").unionAll(firsts.crossJoin(F.broadcast(flooded)).filter("flooded").select(key, "rank")).distinct()
