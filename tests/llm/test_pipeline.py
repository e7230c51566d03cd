from collections import Counter

import public_tokenizers

import corpus_pipeline
from lumenlog.llm.decontaminate import best_stretch, words_of
from lumenlog.llm.quality_classifier import quality_classifier

from .fixtures import SCHEMA, awkward, clashing, empty
from .test_line_dedup import brute as brute_lines
from .test_ngram_join import WORD, grams
from .test_tokens_packing import check_pieces

_ = public_tokenizers


def one_of_each(rows, k=5, percent=80):
    """Row numbers that stay: the least (id, row) of each component; rows without words all stay."""
    sets = [grams(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                root[find(i)] = find(j)
    best: dict = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            best[find(i)] = min(best.get(find(i), (True, 0, 1 << 60)), (d is None, d or 0, i))
    return {x[2] for x in best.values()} | {i for i, s in enumerate(sets) if not s}


def brute(spark, sf_dir, docs):
    """The rows (doc_id, text) that reach packing, each stage by itself on the whole rows."""
    scored = quality_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in scored.orderBy("doc_id").collect() if r.quality_score >= 0.5]
    removed = brute_lines(rows)
    had = Counter(rows)
    rows = sorted(((d, t) for (d, t), n in removed.items() for _ in range(n) if (d, t) in had or WORD.search(t or "")), key=lambda r: (r[0] is not None, r[0] or 0))
    stay = one_of_each(rows)
    rows = [r for i, r in enumerate(rows) if i in stay]
    items = [words_of(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def clean(text):
        h = words_of(text or "")
        present = set(h.tolist())
        return not any(sum(w in present for w in i.tolist()) >= len(i) - len(i) // 5 and best_stretch(i, h, len(i) // 5) for i in items)

    return [r for r in rows if clean(r[1])]


def test_run_against_stages_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pieces = corpus_pipeline.run(spark, small).collect()
    want = brute(spark, small, docs)
    assert check_pieces(pieces, want) == 0 and len(want) > 80
    assert {p.doc_id for p in pieces} == {d for d, _ in want}


def test_stages_take_awkward_rows(spark, small):
    df, _ = awkward(spark)
    for docs in (df, clashing(df), empty(spark)):
        for _name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns
            out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame([], SCHEMA), small).collect() == []
