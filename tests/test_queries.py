"""Every query with SQL is held against DuckDB on the small tables."""

import hashlib
import json
import math
import pathlib
import re
from collections import Counter

import duckdb
import pytest

from lumenlog.plans.catalog import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def flat(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str([flat(x) for x in v]) if isinstance(v, list) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(flat(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(n for n, q in catalog().items() if q.sql))
def test_query_against_sql(spark, con, small, name):
    query = catalog()[name]
    got = query.build(spark, small)
    want = con.execute(query.sql)
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    found = rows(got.columns, got.collect())
    assert found == rows(names, want.fetchall())
    assert found  # an empty result proves nothing


def test_communities_split_clusters(spark):
    from lumenlog.operators.vectors import communities, knn_edges

    vectors = [(i, [1.0, 0.01 * i, 0.0] if i < 10 else [0.0, 0.01 * i, 1.0]) for i in range(20)]
    found = {r.node: r.community for r in communities(knn_edges(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), 4, 0.55, block=7)).collect()}
    assert len(set(found.values())) == 2 and len({found[i] for i in range(10)}) == 1 and len({found[i] for i in range(10, 20)}) == 1


def test_roots_of_a_deep_chain_and_a_cycle(spark):
    """The recursive query stopped at 100 levels."""
    from lumenlog.operators.ingest import roots_of

    links = [(i, i - 1 if i else None) for i in range(105)] + [(1000, 1001), (1001, 1002), (1002, 1001), (2000, 1999)]
    got = {r.c: (r.root, r.depth) for r in roots_of(spark.createDataFrame(links, "c long, p long"), "c", "p").collect()}
    assert got == {i: (0, i) for i in range(105)} | {1000: (1001, 2), 1001: (1001, 1), 1002: (1002, 1), 2000: (1999, 0)}
    assert roots_of(spark.createDataFrame([], "c long, p long"), "c", "p").collect() == []


def test_holders_of_short_and_long_passages(spark, tmp_path):
    name = "passage_holders"
    ten = "one two three four five six seven eight nine ten"
    items = [(1, "one two three"), (2, ten), (3, "Eight, words: that (make) up this one exactly"), (4, "zebra"), (5, ten + " eleven"), (6, ""), (7, None), (8, "six seven")]
    docs = ["x one two three y", "One two; three", "one two three four five six seven eight other", ten, ten + " eleven twelve", "eight words that make up this one exactly", "a zebra", "zebras", "", "...", None, "zebra zebra", "six seven"]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    for t in ("benchmark", "documents"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = {r.item_id: r.holders for r in catalog()[name].build(spark, str(tmp_path)).collect()}
    assert got == dict(c.execute(catalog()[name].sql).fetchall())
    assert got[1] == 5 and got[4] == 2 and got[8] == 4 and got[5] == 1


def test_ties_of_many_copies_go_to_the_least_ids(spark):
    from lumenlog.operators.vectors import knn_edges

    ids = [(i * 37) % 60 for i in range(60)]
    got = {(r.a, r.b) for r in knn_edges(spark.createDataFrame([(i, [1.0, 2.0]) for i in ids], "vec_id long, embedding array<double>").coalesce(1), 3, 0.5).collect()}
    assert got == {(min(q, b), max(q, b)) for q in range(60) for b in sorted(set(range(60)) - {q})[:3]}


def test_communities_settle(spark):
    from lumenlog.operators.vectors import communities

    chain = [(i, i + 1, 1 - 0.01 * i) for i in range(13)]  # the least label moves one node a round
    found = {r.node: r.community for r in communities(spark.createDataFrame(chain, "a long, b long, weight double")).collect()}
    assert found == {i: 0 for i in range(14)}
    assert communities(spark.createDataFrame([], "a long, b long, weight double")).collect() == []


def test_keys_of_messages(spark, small):
    want = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        event_id = r.conv_id * 1_000_000 + r.turn
        digest = hashlib.sha256(json.dumps({"content": r.text}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
        part = ("tool=t" if r.turn % 3 == 0 else "blk=") + str(r.turn) if r.turn % 3 < 2 else ""
        want[event_id] = ":".join([f"m{event_id}" if event_id % 2 == 0 else f"c={digest}", r.role, part, digest])
    assert {r.event_id: r.dedup_key for r in catalog()["content_hashes"].build(spark, small).collect()} == want


def test_stemmed_counts(spark, small):
    from lumenlog.functions.stemming import stem

    df, tf = Counter(), Counter()
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        found = Counter(s for w in re.findall(r"[^\W_]+", r.text.lower()) if (s := stem(w)) in ("that", "from", "licens"))
        tf.update(found), df.update(found.keys())
    assert {r.stem: (r.df, r.tf) for r in catalog()["bm25_stemmed"].build(spark, small).collect()} == {s: (df[s], tf[s]) for s in tf}


def test_files_on_disk(spark, small):
    want = {p.name.removesuffix(".parquet"): p.stat().st_size for p in pathlib.Path(small).glob("*.parquet")}
    assert {r.kind: r.bytes for r in catalog()["files_on_disk"].build(spark, small).collect()} == want


def test_communities_of_cliques(spark):
    """Two cliques and a bridge; merging never lowers modularity below that of the cliques."""
    from lumenlog.operators.vectors import communities

    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 6) for b in range(a + 1, base + 6)] + [(5, 10, 0.5)]
    found = {r.node: r.community for r in communities(spark.createDataFrame(edges, "a long, b long, weight double")).collect()}
    assert found == {i: 0 for i in range(6)} | {i: 10 for i in range(10, 16)}


def test_communities_around_a_hub_merge_in_few_rounds(spark, monkeypatch):
    """One community that is the best of many took one of them a round."""
    from lumenlog.operators import vectors

    edges = [(a, b, 1.0) for a in range(4) for b in range(a + 1, 4)]
    for i in range(200):
        x = 10 + 3 * i
        edges += [(x, x + 1, 1.0), (x, x + 2, 1.0), (x + 1, x + 2, 1.0), (i % 4, x, 0.5)]
    steps, written = [], vectors.checkpointed
    monkeypatch.setattr(vectors, "checkpointed", lambda rows: steps.append(1) or written(rows))
    found = {r.node: r.community for r in vectors.communities(spark.createDataFrame(edges, "a long, b long, weight double")).collect()}
    assert len(steps) <= 30
    assert len({found[i] for i in range(4)}) == 1 and all(found[x] == found[x + 1] == found[x + 2] for x in range(10, 610, 3))
    twice, size, shared = 2 * sum(w for *_, w in edges), Counter(), Counter()
    for a, b, w in edges:
        size.update({found[a]: w}), size.update({found[b]: w})
        shared[found[a], found[b]] += w
    assert all(w / twice <= 0.5 * size[a] * size[b] / twice**2 for (a, b), w in shared.items() if a != b)  # no merge gains
    assert sum(c == 0 for c in found.values()) > 4 + 3 * 10


def test_fault_signatures_of_long_ids(spark, tmp_path):
    """Numbers of six or more digits were folded as ids where the SQL has a number."""
    name, ids = "fault_signatures", [*range(8), *range(99_996, 100_004), *range(1_000_000, 1_000_004), *range(2**53 + 992, 2**53 + 1012)]
    spark.createDataFrame([(i, "error") for i in ids], "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got, want = catalog()[name].build(spark, str(tmp_path)), c.execute(catalog()[name].sql)
    names = [x[0] for x in want.description]
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_references_of_late_events(spark, tmp_path):
    """Events from id 1000000 on count as any others: the SQL's bound leaves them out, the query doesn't."""
    name, ids = "resolve_ref", [*range(8), *range(999_996, 1_000_012), *range(5_999_992, 6_000_000), 2**53]
    made = spark.createDataFrame([(i, i // 2) for i in ids], "event_id long, user_id long")
    made.selectExpr("*", "timestamp_seconds(event_id % 1000) as ts").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = [(r.ref, r.thread_id) for r in catalog()[name].build(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(c.execute(catalog()[name].sql.replace(" where event_id < 1000000", "")).fetchall())
    assert len(got) == len(ids) and set(got) >= set(c.execute(catalog()[name].sql).fetchall())
