import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenlog.llm.decontaminate import best_stretch, contaminations, decontaminated, op4_decontamination, words_of

from .fixtures import awkward, clashing, empty


def brute_distance(item, text):
    """Least edit distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        now = [i]
        for j, x in enumerate(text, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (w != x)))
        row = now
    return min(row)


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.lists(st.integers(0, 3), max_size=20))
def test_best_stretch(item, text):
    want = brute_distance(item, text)
    got = best_stretch(np.array(item), np.array(text, int), len(item))
    assert got[0] == want
    assert best_stretch(np.array(item), np.array(text, int), want - 1) is None
    i, a, b = got
    assert brute_distance(item, text[a:b]) == i


def test_all_documents_against_every_pair(spark, small):
    items = [(r.item_id, words_of(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = [(r.doc_id, words_of(r.text)) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {}
    for d, h in docs:
        for i, w in items:
            # A stretch with at most a fifth of edits shares a run of at least three words with the item.
            runs = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
            if any(tuple(h[k : k + 3]) in runs for k in range(len(h) - 2)):
                n = brute_distance(w.tolist(), h.tolist()) if len(h) < 4000 else best_stretch(w, h, len(w))[0]
                if 100 * n <= 20 * len(w):
                    want[d, i] = n
    got = {(r.doc_id, r.item_id): r.n_edits for r in op4_decontamination(spark, small).collect()}
    assert got == want and want


def test_recall_of_edited_items(spark):
    r = random.Random(4)
    items = {x.item_id: x.text for x in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()}
    vocabulary = [w for t in items.values() for w in t.split()]
    rows, planted = [], []
    for share in (0, 5, 10, 15, 20):
        for i, text in items.items():
            words = text.split()
            for _ in range(len(words) * share // 100):
                p = r.randrange(len(words))
                words[p : p + 1] = r.choice([[], [r.choice(vocabulary)], [words[p], r.choice(vocabulary)]])
            n = brute_distance(words_of(text).tolist(), words_of(" ".join(words)).tolist())
            filler = [r.choice(vocabulary) for _ in range(300)]
            at = r.randrange(300)
            rows.append((len(rows), " ".join(filler[:at]) + ' "' + ", ".join(words) + '" ' + " ".join(filler[at:])))
            if 100 * n <= 20 * len(words_of(text)):
                planted.append((share, len(rows) - 1, i, n))
    got = {(x.doc_id, x.item_id): x.n_edits for x in contaminations(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"), per_pass=77).collect()}
    assert all(got.get((d, i), 99) <= n for share, d, i, n in planted if (d, i) in got)
    for share, least in ((0, 1.0), (5, 0.99), (10, 0.97), (15, 0.9), (20, 0.9)):
        own = [(d, i) in got for s, d, i, _ in planted if s == share]
        print(share, sum(own) / len(own), len(own))
        assert sum(own) / len(own) >= least, share
    assert len(got) <= len(rows)


def test_awkward_rows(spark):
    df, rows = awkward(spark, ["a b", "one two three here", "x one two three four five six seven eight y", "One, two; three -- four five six seven eight!"])
    items = spark.createDataFrame([(1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (2, None), (3, ""), (4, "..."), (5, "one two three"), (None, "x"), (6, "word " * 2500), (7, "漢字かな交じり文 🙂🙃")], "item_id long, text string")
    got = contaminations(clashing(df), items)
    found = sorted((x.doc_id, x.item_id) for x in got.collect())
    n = len(rows) - 3
    assert [x for x in found if x[0] in (n - 2, n - 1)] == sorted([(d, i) for d in (n - 2, n - 1) for i in (1, 1, 5)])
    assert (n - 3, 5) in found and (10, 6) in found and (7, 7) in found
    assert contaminations(empty(spark), items).collect() == [] and contaminations(df, items.limit(0)).collect() == []
    kept = decontaminated(clashing(df), items)
    assert kept.columns == clashing(df).columns and kept.count() == len(rows) - len({x[0] for x in found})


def test_recall_at_the_bound_by_item_length(spark):
    """Substitutions, as many as the bound admits, in items at and just above a size class; an item may also begin the
    text with its first word gone."""
    r = random.Random(20)
    word = lambda: f"w{r.randrange(5000)}"
    items, rows = [], []
    for length in (4, 5, 6, 8, 9, 15, 16, 17, 20, 31, 32, 59, 64, 127, 130, 300, 1000):
        for _ in range(40 if length < 100 else 5):
            text = [word() for _ in range(length)]
            edited, edits = list(text), length // 5
            for p in r.sample(range(length), edits):
                edited[p] = word()
            items.append((len(items), " ".join(text)))
            rows.append((len(rows), " ".join([word() for _ in range(30)] + edited + [word() for _ in range(30)]), length))
            if edits:
                rows.append((len(rows), " ".join(text[1:]), length))
                items[-1] += (rows[-2][0], rows[-1][0])
            else:
                items[-1] += (rows[-1][0],)
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").coalesce(1)
    got = {(x.doc_id, x.item_id) for x in contaminations(docs, spark.createDataFrame([x[:2] for x in items], "item_id long, text string")).collect()}
    for length in sorted({x[2] for x in rows}):
        own = [(d, x[0]) in got for x in items if len(x[1].split()) == length for d in x[2:]]
        print(length, sum(own) / len(own), len(own))
        assert all(own), length


def test_recall_of_the_walks_alone(spark, monkeypatch):
    """Without the exact path: what item-sized windows find by themselves at half of the bound."""
    from lumenlog.llm import decontaminate as d

    r = random.Random(21)
    word = lambda: f"w{r.randrange(5000)}"
    found = {}
    for length in (16, 24, 32, 48, 64, 100, 200):
        texts = [[word() for _ in range(length)] for _ in range(40)]
        items = d.Items([(i, " ".join(t)) for i, t in enumerate(texts)])
        assert items.classes == (d.class_of(length),) and length / 3 <= d.class_of(length) <= length * 2 / 3 or length > 192
        items.pieces = {}
        hits = 0
        for i, t in enumerate(texts):
            edited = list(t)
            for p in r.sample(range(length), length // 10):
                edited[p] = word()
            h = np.concatenate([words_of(" ".join([word() for _ in range(30)] + edited + [word() for _ in range(30)])), np.zeros(items.embedding.steps, np.uint32)])
            hits += i in items.candidates(h)[0]
        found[length] = hits / len(texts)
    print(found)
    assert min(found.values()) >= 0.9


def test_equal_hashes_are_no_matches(spark, monkeypatch):
    """Candidates are found by hashes, but verified on the words."""
    from lumenlog.llm import decontaminate as d

    monkeypatch.setattr(d, "zlib", type("crc", (), {"crc32": staticmethod(lambda w: len(w))}))
    items = d.Items([(1, "aa bbb cccc ddddd eeeeee")])
    run = d._found(lambda percent: items, 20)
    texts = ["zz yyy xxxx wwwww vvvvvv", "aa bbb cccc ddddd eeeeee", "aa bbb cccc ddddd xxxxxx", "aa bbb cccc wwwww xxxxxx"]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"row": pa.array([{"file": 1, "place": i} for i in range(4)]), "doc_id": pa.array(range(4), pa.int64()), "text": pa.array(texts)})
    got = [(x["doc_id"], x["n_edits"]) for b in run(iter([batch])) for x in b.to_pylist()]
    assert got == [(1, 0), (2, 1)]
