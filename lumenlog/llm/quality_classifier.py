"""Quality classifier by attention-based multiple-instance learning: a document is a bag of passages.

Every passage of 64 words is encoded (learned embeddings of hashed words, averaged, plus a few character and repetition
rates, through tanh); gated attention weights over the passages are learned from document labels alone; the weighted
passage representation is scored by a logistic output. Training takes a bounded sample of labelled documents; scoring
takes every passage of every document, in blocks, so memory doesn't grow with a text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

PASSAGE, BITS, WIDTH, GATE, RATES = 64, 13, 24, 12, 8
#: Documented bound of the training sample: labelled documents. Every passage of theirs is learned from.
SAMPLE = 3000
#: Passages whose words are looked up at a time.
STEP = 2048
BLOCK_WORDS = PASSAGE * 2048
_KIND = np.full(256, 5, np.uint8)  # 0 space, 1 upper, 2 lower, 3 digit, 4 end of sentence, 5 beyond ASCII, 6 other
_KIND[:128] = 6
_KIND[list(b" \t\n\x0b\x0c\r")] = 0
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[list(b".,;:?'\"")] = 4


def passages(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words, the first word of each passage, and the rates of each passage."""
    codes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    first = np.arange(0, len(words), PASSAGE)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    kinds = _KIND[np.frombuffer(b"".join(words), np.uint8)]
    at = np.concatenate([[0], np.cumsum(lengths)])[first]
    counts = np.stack([np.add.reduceat((kinds == k).astype(np.int32), at) for k in (1, 3, 4, 6)], 1)
    chars = np.add.reduceat(lengths, first)
    n = np.minimum(PASSAGE, len(words) - first)
    block = np.arange(len(words)) // PASSAGE
    pairs = np.unique(block.astype(np.uint64) << np.uint64(32) | codes)
    distinct = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=len(first))
    alone = np.add.reduceat((lengths == 1).astype(np.int64), first)
    rates = np.column_stack([4 * counts / chars[:, None], distinct / n, chars / n / 10, alone / n * 4, np.log1p(n) / 5])
    return codes >> np.uint32(32 - BITS), first, rates


def _steps(bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first passage, last, first word, last) of runs of STEP passages."""
    for a in range(0, len(bounds) - 1, STEP):
        b = min(a + STEP, len(bounds) - 1)
        yield a, b, int(bounds[a]), int(bounds[b])


class Model:
    """Weights of the encoder, the gated attention and the output."""

    def __init__(self, seed: int = 10):
        r = np.random.default_rng(seed)
        self.w = {
            "words": r.normal(0, 0.05, (1 << BITS, WIDTH)), "rates": r.normal(0, 0.3, (RATES, WIDTH)), "bias": np.zeros(WIDTH),
            "tanh": r.normal(0, 0.3, (WIDTH, GATE)), "gate": r.normal(0, 0.3, (WIDTH, GATE)), "attend": r.normal(0, 0.3, GATE),
            "out": r.normal(0, 0.3, WIDTH), "base": np.zeros(1),
        }

    def encode(self, buckets, first, rates):
        """Passage representations and their unnormalised attention."""
        w = self.w
        bounds = np.append(first, len(buckets))
        n = np.diff(bounds)
        mean = np.empty((len(first), WIDTH))
        for a, b, lo, hi in _steps(bounds):
            mean[a:b] = np.add.reduceat(w["words"][buckets[lo:hi]], first[a:b] - lo, axis=0)
        mean /= n[:, None]
        h = np.tanh(mean + rates @ w["rates"] + w["bias"])
        v, u = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        return h, v, u, (v * u) @ w["attend"], n

    def score(self, text: str) -> float:
        """Probability of label 1 of a whole text; one without words has an empty representation."""
        words = text.encode().split()
        total, z = 0.0, np.zeros(WIDTH)
        for a in range(0, len(words), BLOCK_WORDS):
            h, _, _, s, _ = self.encode(*passages(words[a : a + BLOCK_WORDS]))
            e = np.exp(s)  # |s| is at most the sum of |attend|, so this can't overflow
            total, z = total + e.sum(), z + e @ h
        if not total:
            return float(self.w["empty"][0])
        return float(1 / (1 + np.exp(-(z @ self.w["out"] / total + self.w["base"][0]))))

    def step(self, bags, labels):
        """Gradients of the mean log loss over a batch of bags."""
        w = self.w
        buckets = np.concatenate([b[0] for b in bags])
        starts = np.cumsum([0] + [len(b[0]) for b in bags])
        first = np.concatenate([b[1] + s for b, s in zip(bags, starts)])
        rates = np.concatenate([b[2] for b in bags])
        bag = np.repeat(np.arange(len(bags)), [len(b[1]) for b in bags])
        h, v, u, s, n = self.encode(buckets, first, rates)
        e = np.exp(s)
        a = e / np.bincount(bag, e)[bag]
        z = np.zeros((len(bags), WIDTH))
        np.add.at(z, bag, a[:, None] * h)
        p = 1 / (1 + np.exp(-(z @ w["out"] + w["base"][0])))
        d = (p - labels) / len(bags)
        dz = (d[:, None] * w["out"])[bag]
        da = (h * dz).sum(1)
        ds = a * (da - np.bincount(bag, a * da, len(bags))[bag])
        dv, du = ds[:, None] * w["attend"] * u * (1 - v * v), ds[:, None] * w["attend"] * v * u * (1 - u)
        dpre = (a[:, None] * dz + dv @ w["tanh"].T + du @ w["gate"].T) * (1 - h * h)
        dwords = np.zeros_like(w["words"])
        for i, j, lo, hi in _steps(np.append(first, len(buckets))):
            np.add.at(dwords, buckets[lo:hi], np.repeat(dpre[i:j] / n[i:j, None], n[i:j], axis=0))
        return {"words": dwords, "rates": rates.T @ dpre, "bias": dpre.sum(0), "tanh": h.T @ dv, "gate": h.T @ du, "attend": (v * u).T @ ds, "out": z.T @ d, "base": np.array([d.sum()])}

    def fit(self, bags, labels, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Model:
        """Adam over shuffled batches; the embeddings decay towards zero."""
        labels = np.asarray(labels, float)
        share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        self.w["base"][0] = np.log(share / (1 - share))
        order, t = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(x) for k, x in self.w.items()}
        s = {k: np.zeros_like(x) for k, x in self.w.items()}
        if len(set(labels)) > 1:
            for epoch in range(epochs):
                shuffled = order.permutation(len(bags))
                for i in range(0, len(bags), batch):
                    part = shuffled[i : i + batch]
                    t += 1
                    for k, g in self.step([bags[j] for j in part], labels[part]).items():
                        g = g + (1e-4 * self.w[k] if k == "words" else 0)
                        m[k] += 0.1 * (g - m[k])
                        s[k] += 0.001 * (g * g - s[k])
                        self.w[k] -= rate * (0.5 if epoch * 2 >= epochs else 1) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        else:
            self.w["out"][:] = 0
        # A text without words has neither passages nor a representation: it takes the lower of the prior and one half.
        self.w["empty"] = np.array([min(share, 0.5) * 0.5])
        self.w["words"] = self.w["words"].astype(np.float32)
        return self


def _training_rows(it: Iterator[pa.RecordBatch]):
    for batch in it:
        out = {"buckets": [], "first": [], "rates": []}
        for cell in batch.column("text"):
            words = cell.as_py().encode().split()
            b, f, r = passages(words) if words else (np.zeros(0, int), np.zeros(0, int), np.zeros((0, RATES)))
            out["buckets"].append(b.astype("<u2").tobytes()), out["first"].append(f.astype("<i4").tobytes()), out["rates"].append(r.astype("<f4").tobytes())
        yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "h": batch.column("h"), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents, chosen by a hash of their id, none of them held out."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("label")).filter("l_id is not null and label is not null")
        .filter(~held_out(F.col("l_id"))).groupBy("l_id").agg(F.min("label").alias("label")).withColumn("h", F.xxhash64("l_id")).orderBy("h", "l_id").limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("label", F.xxhash64("doc_id", "text").alias("h"), "text")
    rows = texts.mapInArrow(_training_rows, "label int, h long, buckets binary, first binary, rates binary").orderBy("h").limit(sample).collect()
    rows = [r for r in rows if len(r.first)]
    bags = [(np.frombuffer(r.buckets, "<u2").astype(np.int64), np.frombuffer(r.first, "<i4").astype(np.int64), np.frombuffer(r.rates, "<f4").astype(float).reshape(-1, RATES)) for r in rows]
    return Model().fit(bags, [r.label for r in rows])


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of each text, as a column; the model is a broadcast of fixed size."""
    weights = spark.sparkContext.broadcast(model.w)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model.__new__(Model)
        own.w = weights.value
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return score(text)


def quality_classifier(docs: DataFrame, labels: DataFrame, score: str = "quality_score") -> DataFrame:
    """All columns of `docs` (doc_id long, text string among them) with the column `score`, for every row.

    Labels (doc_id, quality 0 or 1) with a null id or label are left out; of repeated ids the lower label counts. A null
    text counts as empty; texts without words all get the same low score. With labels of one kind or none, every text
    gets their share (one half without labels). Rows with null or repeated ids are scored like any other. Texts are
    taken whole. An empty table gives an empty result. A column of `docs` that is named as `score` is replaced.
    """
    return docs.withColumn(score, score_column(docs.sparkSession, train(docs, labels), text_of()))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
