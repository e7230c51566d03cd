"""Quality rules: base word statistics and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Word unigrams and bigrams are hashed into `buckets`; two multinomials over the buckets, one over the trusted target
documents and one over all documents, are counted over whole texts. A document's score is the mean over its n-grams of
log(p_target / p_raw), so it doesn't grow with length; the verdict is `score >= threshold`, the same for every document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
THRESHOLD = -0.25
BUCKETS = 1 << 16
#: Most ids of target documents that are sent to every executor (8 bytes each).
BROADCAST_IDS = 500_000
SMOOTHING = 2.0


def ngram_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    """Buckets of the unigrams and bigrams of a text, in order."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    grams = np.concatenate([h * np.uint64(0xD6E8FEB86659FD93), pairs * np.uint64(0x9FB21C651E98DF25)])
    return (grams >> np.uint64(64 - int(math.log2(buckets)))).astype(np.int64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    pair = w[:-1] * len(ids) + w[1:]
    if len(ids) < 2_000_000:
        tri = pair[:-1] * len(ids) + w[2:]
    else:
        tri = np.unique(pair[:-1], return_inverse=True)[1] * len(ids) + w[2:]
    order = np.argsort(tri, kind="stable")
    same = tri[order[1:]] == tri[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    hits = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        twice[hits + k] = True
    return int(twice.sum())


def base_statistics(text: str) -> tuple[list[bytes], int, int, int, int]:
    """Words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    raw = text.encode()
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    dup = 0
    if b"\n" in raw:
        lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
        dup = len(lines) - len(set(lines))
    return words, len(text) - spaces, symbols, dup, repeated_words(words)


def _counting(buckets: int):
    def run(it: Iterator[pa.RecordBatch]):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in it:
            for text, trusted in zip(batch.column("text"), batch.column("trusted").to_pylist()):
                words = text.as_py().encode().split()
                if not words:
                    continue
                grams = ngram_buckets(words, buckets)
                np.add.at(raw, grams, 1)
                if trusted:
                    np.add.at(target, grams, 1)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int64()), "n_raw": pa.array(raw[used], pa.int64()), "n_target": pa.array(target[used], pa.int64())})

    return run


def log_ratios(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, counted over all rows of `docs` (text, trusted boolean)."""
    counted = docs.mapInArrow(_counting(buckets), "bucket long, n_raw long, n_target long").groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for b, r, t in counted.collect():  # one row a bucket: bounded by `buckets`
        raw[b], target[b] = r, t
    if not target.sum():
        return np.zeros(buckets)
    # Both multinomials are smoothed by the same counts, so that a rare bucket says little.
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + SMOOTHING) / (expected + SMOOTHING))


def _judging(ratios, threshold: float, buckets: int):
    def run(it: Iterator[pa.RecordBatch]):
        ratio = ratios.value
        for batch in it:
            rows = []
            for doc_id, cell in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words, chars, symbols, dup, repeat = base_statistics(cell.as_py())
                n = len(words)
                failed = n < 50 or 100 * repeat > 50 * n
                score = float(ratio[ngram_buckets(words, buckets)].mean()) if n else 0.0
                rows.append((doc_id, n, chars, symbols, dup, repeat, failed, not failed and score >= threshold, score))
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Base statistics, score and verdict of every row of `docs` (doc_id long, text string; other columns are ignored).

    `trusted` holds the doc_id of target documents; null and repeated ids there count once or not at all. A null text has
    no words: it fails the base rules and scores 0. Rows with a null or repeated doc_id each give their own row. Without
    target documents every score is 0. An empty table gives an empty result. `buckets` is a power of two; the table of
    log ratios (8 bytes a bucket) is broadcast, and target ids while they are at most BROADCAST_IDS.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    marks = trusted.select(F.col("doc_id").cast("long").alias("t_id")).filter("t_id is not null").distinct().withColumn("t", F.lit(True))
    # `trusted` grows with the corpus: it is a broadcast only while it has few ids; beyond, texts are dealt out by id.
    few = marks.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    flagged = source.join(F.broadcast(marks) if few else marks.hint("merge"), F.col("doc_id") == F.col("t_id"), "left").select("text", F.coalesce("t", F.lit(False)).alias("trusted"))
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(flagged, buckets))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return source.mapInArrow(_judging(ratios, threshold, buckets), schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted target: the documents labelled of good quality."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))
