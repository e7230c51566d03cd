"""Token counts without token ids: pieces are counted once per distinct pre-token and summed per document.

Under a sentencepiece model with an identity normalizer no vocabulary piece holds a space mark after another
character, so merges never cross the start of a word: the pieces of a text are the pieces of its pre-tokens
(a word with the run of spaces before it). Pre-token frequencies are taken per document; the most frequent
pre-tokens of the whole table (at most `hot_pretokens`, each at most 64 characters) are a broadcast of bounded size,
which also takes every hot key off the shuffle; all others are shuffled by pre-token, where each distinct one is
counted once, and the products are summed back per row.
"""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, release, table, text_of, written

MARK = "▁"
HOT_MAX_CHARS = 64
_models: dict[str, object] = {}
_lock = threading.Lock()


def processor(path: str):
    """The sentencepiece processor for a model file, one per Python worker."""
    with _lock:
        if path not in _models:
            import sentencepiece

            _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        return _models[path]


def check_model(path: str) -> None:
    """Refuse models under which pre-tokens are not independent."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("the model normalizes text; pre-tokens can't be counted on their own")
    if any(MARK in p.piece.lstrip(MARK) or (p.type == 4) for p in proto.pieces):
        raise ValueError("the model has pieces that cross words")


def pretokens(text: str) -> list[str]:
    """Pieces of text whose encodings, each with the model's own leading space mark, join to the text's encoding."""
    if MARK in text:
        text = text.replace(MARK, " ")
    words = text.split(" ")
    if "" not in words:
        return words
    if not text.strip(" "):
        return [text] if text else []
    out: list[str] = []
    gap = 0
    for w in words:
        if w:
            out.append(" " * gap + w)
            gap = 0
        else:
            gap += 1
    out[-1] += " " * gap
    return out


def _batches(it: Iterator[pa.RecordBatch], *names: str):
    for batch in it:
        yield [batch.column(n) for n in names]


def _frequent(top: int):
    def run(it):
        counts: Counter = Counter()
        for (texts,) in _batches(it, "text"):
            for t in texts:
                counts.update(pretokens(t.as_py()))
            if len(counts) > 4 * top:  # bounded memory: the rare half goes; it only orders candidates for the broadcast
                counts = Counter(dict(counts.most_common(2 * top)))
        best = [(k, v) for k, v in counts.most_common(top) if len(k) <= HOT_MAX_CHARS]
        yield pa.RecordBatch.from_pydict({"pretoken": pa.array([k for k, _ in best], pa.string()), "n": pa.array([v for _, v in best], pa.int64())})

    return run


def _per_document(hot):
    """Rows (row, doc_id, n_bytes, known, pretoken, freq): one with a null pretoken per document, one per rarer pre-token."""

    def run(it):
        known_of = hot.value
        base = TaskContext.get().partitionId() << 40
        at = 0
        for ids, texts in _batches(it, "doc_id", "text"):
            rows, docs, sizes, knowns, tokens, freqs = [], [], [], [], [], []
            for doc_id, t in zip(ids.to_pylist(), texts):
                text = t.as_py()
                known = 0
                row = base + at
                at += 1
                for w, f in Counter(pretokens(text)).items():
                    n = known_of.get(w)
                    if n is None:
                        rows.append(row), docs.append(None), sizes.append(None), knowns.append(0), tokens.append(w), freqs.append(f)
                    else:
                        known += n * f
                rows.append(row), docs.append(doc_id), sizes.append(len(text.encode())), knowns.append(known), tokens.append(None), freqs.append(0)
                if len(rows) > 200_000:
                    yield _rows(rows, docs, sizes, knowns, tokens, freqs)
                    rows, docs, sizes, knowns, tokens, freqs = [], [], [], [], [], []
            yield _rows(rows, docs, sizes, knowns, tokens, freqs)

    return run


def _rows(rows, docs, sizes, knowns, tokens, freqs) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), "doc_id": pa.array(docs, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(knowns, pa.int64()), "pretoken": pa.array(tokens, pa.string()), "freq": pa.array(freqs, pa.int64())})


def _counted(path: str):
    """Partitions sorted by pre-token: each distinct one is encoded once, its count joined to all rows that hold it."""

    def run(it):
        sp = processor(path)
        last, n = None, 0
        for batch in it:
            tokens = batch.column("pretoken")
            yield batch.filter(tokens.is_null()).select(["row", "doc_id", "n_bytes", "n_tokens"])
            rare = batch.filter(tokens.is_valid())
            words = rare.column("pretoken").to_pylist()
            fresh = [w for i, w in enumerate(words) if w != (words[i - 1] if i else last)]
            counts = iter([len(x) for x in sp.encode(fresh, num_threads=1)] if fresh else [])
            out = []
            for w, f in zip(words, rare.column("freq").to_pylist()):
                if w != last:
                    last, n = w, next(counts)
                out.append(n * f)
            yield pa.RecordBatch.from_pydict({"row": rare.column("row"), "doc_id": rare.column("doc_id"), "n_bytes": rare.column("n_bytes"), "n_tokens": pa.array(out, pa.int64())})

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, hot_pretokens: int = 1 << 17) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs` (doc_id long, text string; other columns are ignored).

    A null text counts as empty: 0 bytes, 0 tokens. Rows with a null or repeated doc_id each give their own row. Texts
    are taken whole. An empty table gives an empty result.
    """
    check_model(model_path)
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    frequent = written(source.select("text").mapInArrow(_frequent(hot_pretokens // 4), "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n")).filter("n > 1"), "frequent")
    # The least count that at most hot_pretokens reach, from a histogram of some hundred levels; only those are collected.
    level = F.floor(8 * F.log2("n")).cast("int")
    reached, floor = 0, None
    for r in frequent.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        reached += r["count"]
        if reached > hot_pretokens:
            break
        floor = r["level"]
    words = [] if floor is None else [r[0] for r in frequent.filter(level >= floor).select("pretoken").collect()]
    release(frequent)
    sp = processor(model_path)
    hot = spark.sparkContext.broadcast({w: len(x) for w, x in zip(words, sp.encode(words, num_threads=1))} if words else {})
    flat = source.mapInArrow(_per_document(hot), "row long, doc_id long, n_bytes long, n_tokens long, pretoken string, freq long")
    n = partitions(spark)
    # One pass over the texts feeds both: rows with no pre-token are dealt by row, the others by pre-token.
    deal = F.when(F.col("pretoken").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("pretoken"))  # not a column, so not shuffled
    counted = flat.repartition(n, deal).sortWithinPartitions(F.col("pretoken").asc_nulls_first()).mapInArrow(_counted(model_path), "row long, doc_id long, n_bytes long, n_tokens long")
    return (
        counted.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
