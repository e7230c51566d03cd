import random
import re
from collections import Counter

import numpy as np

from lumenlog.llm.components import connected_components
from lumenlog.llm.ngram_join import Trie, least_overlap, ngram_components, op5_ngram_join

from .fixtures import awkward, clashing, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, k=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows, percent=85):
    sets = [grams(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    index: dict = {}
    for i, s in enumerate(sets):
        met = {j for g in s for j in index.get(g, ())}
        for j in met:
            both = len(s & sets[j])
            if 100 * both >= percent * len(s | sets[j]):
                root[find(i)] = find(j)
        for g in s:
            index.setdefault(g, []).append(i)
    ids: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return Counter((r[0], len(s), ids.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))


def got(df):
    return Counter(tuple(r)[:3] for r in df.collect())


def test_all_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert got(op5_ngram_join(spark, small)) == brute(rows)


def test_groups_of_near_copies(spark):
    """Copies at distances around the threshold, chains, a passage that many share, and short texts."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = []

    def add(x):
        rows.append((len(rows), " ".join(x)))

    for size, copies, edits in ((150, 60, 3), (150, 60, 4), (80, 40, 2), (40, 20, 1), (300, 12, 8)):
        base = [r.choice(words) for _ in range(size)]
        add(base)
        for _ in range(copies):
            x = list(base)
            for _ in range(r.randint(0, edits)):
                x[r.randrange(len(x))] = r.choice(words)
            add(x)
    chain = [r.choice(words) for _ in range(120)]
    for i in range(30):
        chain = chain[2:] + [r.choice(words) for _ in range(2)]
        add(chain)
    passage = [r.choice(words) for _ in range(60)]
    for n in (0, 2, 5, 8, 10, 11, 12, 30) * 6:
        add(passage + [r.choice(words) for _ in range(n)])
    for t in ("a", "a b", "A  b", "a b c", "a b c d", "a b c d", "a b c d e"):
        rows.append((len(rows), t))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_components(df)) == brute(rows)


def test_awkward_rows(spark):
    df, rows = awkward(spark, ["Naïve CAFÉ — “quotes” Ñandú", "null id text here", "NULL id text here"])
    assert got(ngram_components(clashing(df))) == brute(rows)
    assert ngram_components(empty(spark)).collect() == []


def test_trie_finds_what_sets_say():
    r = np.random.default_rng(1)
    base = np.sort(r.choice(10_000, 200, replace=False).astype(np.uint64))
    sets = [np.unique(np.concatenate([r.choice(base, r.integers(100, 200), replace=False), r.integers(0, 10_000, r.integers(0, 40)).astype(np.uint64)])) for _ in range(60)] + [base, base, base[:150], base[:1]]
    for probe in (base, sets[0], base[:170], base[:1]):
        want = [i for i, s in enumerate(sets) if len(np.intersect1d(s, probe)) >= least_overlap(len(s), len(probe), 60)]
        assert sorted(Trie(sets).linked(probe, 60)) == want and want


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: y for x, y in root.items() if any(x in e and e[0] != e[1] for e in edges)}
