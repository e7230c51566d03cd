"""The index and the search over it, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from lumenlog.functions.query import Both, Either, Phrase, Without
from lumenlog.operators import search
from lumenlog.operators.index import Index, index_of

TEXTS = [
    "the quick brown fox", "quick quick fox jumps", "Brown bear and the fox", "get_session opens", "megaget_sessionizer", "nothing here", "", None, "brown fox brown fox the", "Naïve CAFÉ fox",
    "session get reversed", "a quick session", "100% of the_fox", "fox " * 40,
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    rows = [(i, t, f"2024-01-{i + 1:02} 00:00:00" if i % 5 else None, f"t{i % 3}") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, at string, thread string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(docs):
    return index_of(docs, "test")


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def holds(text, phrase):
    w = words(text)
    return any(w[i : i + len(phrase)] == list(phrase) for i in range(len(w) - len(phrase) + 1)) if phrase else False


def test_expressions_match_what_texts_hold(index):
    p = lambda *w: Phrase(w)
    trees = {
        p("fox"): lambda t: holds(t, ["fox"]), p("brown", "fox"): lambda t: holds(t, ["brown", "fox"]), p("fox", "fox", "fox"): lambda t: holds(t, ["fox"] * 3), p(): lambda t: False,
        Both(p("brown"), Without(p("fox"), p("bear"))): lambda t: holds(t, ["brown"]) and holds(t, ["fox"]) and not holds(t, ["bear"]), Either(p("jumps"), p("café")): lambda t: holds(t, ["jumps"]) or holds(t, ["café"]),
    }
    for tree, want in trees.items():
        assert {r.doc_id for r in search.matched(index, tree).collect()} == {i for i, t in enumerate(TEXTS) if want(t)}, tree


def test_an_index_that_grows_is_one_that_was_built_whole(spark, docs, index, tmp_path):
    grown = Index(spark, str(tmp_path / "i"))
    assert grown.stats() == (0, 0, None)
    assert grown.refresh(docs.filter("doc_id < 5")) == 5 and grown.refresh(docs.filter("doc_id < 11")) == 6
    assert grown.refresh(docs) == len(TEXTS) - 11 and grown.refresh(docs) == 0
    assert grown.stats() == index.stats() == (len(TEXTS), sum(len(words(t)) for t in TEXTS), len(TEXTS) - 1)
    for tree in (Phrase(("fox",)), Phrase(("brown", "fox"))):
        a, b = ({r.doc_id: round(r.score, 9) for r in search.bm25(i, tree).collect()} for i in (grown, index))
        assert a == b and a
    assert index_of(docs, "test").path == index.path


def test_needles_by_trigrams(docs, index):
    for needle in ("fox", "BROWN f", "%", "_f", "zzz", "get_session", "fo"):
        want = {i for i, t in enumerate(TEXTS) if t and needle.lower() in t.lower()}
        for most in (0, 3, 2000):
            assert {r.doc_id for r in search.contains_indexed(docs, index, needle, most=most).collect()} == want, (needle, most)


def ids(hits):
    return [r.doc_id for r in hits.orderBy("position").collect()]


def test_modes(docs, index):
    run = lambda q, **o: ids(search.search(index, docs, q, now="2024-02-01", limit=50, at="at", **o))
    having = lambda *w: {i for i, t in enumerate(TEXTS) if any(holds(t, [x]) for x in w)}
    assert set(run("quick fox")) == having("quick", "fox") and run("quick AND fox")[0] in (0, 1) and set(run("quick AND fox")) == {0, 1}
    assert set(run('"brown fox"')) == {0, 8} and set(run("brown NOT fox")) == set()
    assert set(run("get_session")) == {3, 4, 10, 11} and run("get_session")[0] == 3
    assert set(run("jumps|bear")) == {1, 2} and set(run("", prefix="the q")) == {0} and run("") == []
    assert run("_FOX OR 100%", match="substring") == [12] and run("|", match="substring") == []
    dated = run("fox", sort="oldest")
    assert set(dated) == having("fox") and [i for i in dated if i % 5] == sorted(i for i in dated if i % 5) and all(i % 5 == 0 for i in dated[len([i for i in dated if i % 5]) :])
    assert set(run("fox", scope=F.col("thread") == "t0")) == {i for i in having("fox") if i % 3 == 0}


def test_pages_are_slices_of_one_order(docs, index):
    whole = ids(search.search(index, docs, "fox", now="2024-02-01", limit=50))
    pages = [search.search(index, docs, "fox", now="2024-02-01", limit=3, page=p) for p in (1, 2, 3, 4)]
    assert [x for p in pages for x in ids(p)] == whole
    first = pages[0].first()
    assert first.total == len(whole) and first.pages == -(-len(whole) // 3) and first.exhaustive


def test_two_arms(spark, docs, index):
    near = spark.createDataFrame([(5, 0.9), (0, 0.8), (7, 0.1)], "doc_id long, score double")
    hits = {r.doc_id: r for r in search.search(index, docs, "quick", now="2024-02-01", similar=near).collect()}
    assert set(hits) == {0, 1, 5, 7, 11} and hits[0].score == max(r.score for r in hits.values()) and hits[5].verdict == "weak" and hits[0].verdict == "strong"


def test_snippets(spark):
    text = " ".join(f"w{i}" for i in range(40)) + " tokens " + " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(text,), ("x" * 400,)], "t string")
    got = [r[0] for r in df.select(search.snippet(F.col("t"), ["token"])).collect()]
    assert "tokens" in got[0] and len(got[0].split()) == 14 and got[1] == "x" * 300
