import zlib

import numpy as np

from lumenlog.llm.quality_classifier import BLOCK_WORDS, Model, op10_quality_classifier, passages, quality_classifier

from .fixtures import awkward, clashing, empty


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op10_quality_classifier(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for d, r in rows.items())
    labels = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in labels]) >= 0.93
    good, bad = [r.score for r, q in labels if q], [r.score for r, q in labels if not q]
    assert np.mean([a > b for a in good for b in bad]) >= 0.95


def test_gradients():
    model, r = Model(), np.random.default_rng(0)
    bags = [passages([bytes(r.integers(97, 123, 3, dtype=np.uint8)) for _ in range(n)]) for n in (10, 70, 200)]
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        total = 0.0
        for bag, y in zip(bags, labels):
            h, _, _, s, _ = model.encode(*bag)
            a = np.exp(s) / np.exp(s).sum()
            p = 1 / (1 + np.exp(-(a @ h @ model.w["out"] + model.w["base"][0])))
            total -= np.log(p if y else 1 - p) / len(bags)
        return total

    grads = model.step(bags, labels)
    for name, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept = model.w[name][at]
        model.w[name][at] = kept + 1e-5
        up = loss()
        model.w[name][at] = kept - 1e-5
        down = loss()
        model.w[name][at] = kept
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6, name


def test_long_texts_in_blocks():
    model = Model()
    model.w["empty"] = np.array([0.25])
    words = [b"w%d" % (i % 977) for i in range(BLOCK_WORDS + 130)]
    h, _, _, s, _ = model.encode(*passages(words))
    z = np.exp(s) @ h / np.exp(s).sum()
    want = 1 / (1 + np.exp(-(z @ model.w["out"] + model.w["base"][0])))
    assert abs(model.score(b" ".join(words).decode()) - want) < 1e-9


def test_awkward_rows(spark):
    df, rows = awkward(spark)
    labels = spark.createDataFrame([(9, 1, 0), (10, 0, 0), (10, 1, None), (None, 1, 0), (11, None, 0), (12, 0, 0), (13, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_classifier(clashing(df), labels)
    assert set(clashing(df).columns) <= set(got.columns)
    scores = [r.quality_score for r in got.collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    assert quality_classifier(empty(spark), labels).collect() == []
    assert {r.quality_score for r in quality_classifier(df, labels.limit(0)).select("quality_score").collect()} <= {0.5, 0.25}


def test_every_passage_is_learned_from(spark):
    """The only difference stands far into long texts, behind dozens of equal passages."""
    filler = " ".join(f"word{i % 50}" for i in range(64))
    rows = [(i, " ".join([filler] * 40 + [("splendid prose " if i % 2 else "dreadful junk ") * 32] + [filler] * 3)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    scores = {r.doc_id: r.quality_score for r in quality_classifier(docs, labels).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert len(scores) > 20 and all((s >= 0.5) == (d % 2 == 1) for d, s in scores.items())


def test_steps_of_passages_are_one(monkeypatch):
    """Lookups and gradients in steps of a few passages equal those in one."""
    from lumenlog.llm import quality_classifier as q

    r = np.random.default_rng(3)
    bags = [passages([bytes(r.integers(97, 123, 2, dtype=np.uint8)) for _ in range(n)]) for n in (1, 64, 65, 1000)]
    labels = np.array([1.0, 0.0, 1.0, 0.0])
    whole = Model().step(bags, labels)
    monkeypatch.setattr(q, "STEP", 3)
    for name, g in Model().step(bags, labels).items():
        assert np.allclose(g, whole[name], atol=1e-12), name
