"""Packing along a space-filling curve: hashed document vectors, projected to few dimensions, range-sorted by Hilbert key.

Each text becomes a hashed vector (square roots of its 4-byte-gram counts in 4096 buckets), a fixed random projection
brings it to three dimensions, and the Hilbert index of the quantised point is its key. Documents are range-partitioned
and sorted by (key, tie-breakers), so neighbours on the curve are packed one after the other; a document is cut where a
sequence is full, so only the last sequence of a partition can hold padding.
"""

from __future__ import annotations

import json
import re
import threading
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, text_of

SEQUENCE = 2048
END_ID = 1
VECTOR, DIMS, BITS, REACH = 4096, 3, 10, 4.0
#: Fixed value: the pre-tokenizer pattern of byte-level BPE files with `use_regex`.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NOT_PLAIN = re.compile(r"\s | \s|^ | $")
_CACHE, _BLOCK = 250_000, 1 << 20
_lock = threading.Lock()
_tokenizers: dict = {}


class _Words(dict):
    """Token ids (little-endian unsigned 32-bit) of a word with the space before it; emptied when full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHE:
            self.clear()
        ids = np.array(self.encode(" " + word), "<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


class TextTokenizer:
    """The ids of a byte-level BPE tokenizer file, computed word by word.

    A single space between two non-space characters always begins a pre-token, so the ids of a text are those of its
    words, each with its space. Texts with other runs of spaces are encoded whole. Where they count, the file's added
    tokens are cut out of the text first, and what is between them is encoded piece by piece, as the library does.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("not a byte-level BPE file with the usual pre-tokenizer and no normalizer")
        if any(model.get(flag) for flag in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("the model's options change its ids")
        vocab, merges = model["vocab"], model["merges"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        if any(t.get(flag) for t in spec.get("added_tokens", ()) for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens look at what is around them")
        joined = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        if joined != sorted(joined):
            raise ValueError("token ids don't follow the order of merges")
        import tiktoken

        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in letters]
        byte_of = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = _Words(self.encode)
        self.added = {text: np.array([i], "<u4").tobytes() for text, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    @classmethod
    def load(cls, path: str) -> TextTokenizer:
        with _lock:
            if path not in _tokenizers:
                _tokenizers[path] = cls(path)
            return _tokenizers[path]

    def ids(self, text: str, added_tokens: bool = True) -> Iterator[bytes]:
        """Blocks of ids of a whole text; added tokens in it have ids of their own, or count as ordinary text."""
        if added_tokens and self.cut:
            for i, part in enumerate(self.cut.split(text)):
                if i % 2:
                    yield self.added[part]
                else:
                    yield from self.ids(part, False)
            return
        if not text:
            return
        if _NOT_PLAIN.search(text):
            yield np.array(self.encode(text), "<u4").tobytes()
            return
        at = 0
        while len(text) - at > 2 * _BLOCK and (cut := text.find(" ", at + _BLOCK)) > 0:
            yield self._plain(text[at:cut], at == 0)
            at = cut + 1
        yield self._plain(text[at:], at == 0)

    def _plain(self, text: str, first: bool) -> bytes:
        words = text.split(" ")
        head = np.array(self.encode(words.pop(0)), "<u4").tobytes() if first else b""
        return head + b"".join(map(self.words.__getitem__, words))


def _projection() -> np.ndarray:
    return np.random.default_rng(20).choice(np.array([-1.0, 1.0]), (VECTOR, DIMS))


def project(text: str, matrix: np.ndarray) -> np.ndarray:
    """The projected hashed vector of a text."""
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return np.zeros(DIMS)
    grams = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    vector = np.sqrt(np.bincount(grams * np.uint32(0x9E3779B1) >> np.uint32(20), minlength=VECTOR))
    return vector @ matrix / np.sqrt(vector @ vector)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows), by Skilling's transpose form of the curve."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(texts) -> np.ndarray:
    matrix = _projection()
    points = np.array([project(t, matrix) for t in texts]).reshape(-1, DIMS)
    cells = np.clip((points / REACH + 1) / 2, 0, 1) * ((1 << BITS) - 1)
    return hilbert(cells.round().astype(np.int64))


def _key(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(curve_keys(batch), dtype="int64")


def _packing(path: str, length: int, with_ids: bool, added_tokens: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def emitted(pieces):
        """pieces: (doc_id, start, ids, doc_tokens, sequence, offset)."""
        rows = [(d, s, len(ids) // 4, zlib.crc32(ids), n, q, o) for d, s, ids, n, q, o in pieces]
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * len(names))]
        if with_ids:
            columns.append(pa.array([np.frombuffer(p[2], "<u4").astype(np.int32) for p in pieces], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

    def run(it: Iterator[pa.RecordBatch]):
        tokenizer = TextTokenizer.load(path)
        end = np.array([END_ID], "<u4").tobytes()
        sequence, fill = TaskContext.get().partitionId() << 40, 0
        ready, open_pieces = [], []
        for batch in it:
            for doc_id, cell in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = memoryview(b"".join([*tokenizer.ids(cell.as_py(), added_tokens), end]))
                total, start = len(ids) // 4, 0
                while start < total:
                    take = min(length - fill, total - start)
                    open_pieces.append((doc_id, start, ids[4 * start : 4 * (start + take)], total, sequence, fill))
                    start, fill = start + take, fill + take
                    if fill == length:
                        ready += open_pieces
                        open_pieces, sequence, fill = [], sequence + 1, 0
            yield emitted(ready)
            ready = []
        # What is left is cut into sequences whose lengths are powers of two, which need no padding.
        left, room, at = fill, 0, 0
        for doc_id, start, ids, total, _, _ in open_pieces:
            while len(ids):
                if not room:
                    room = 1 << (left.bit_length() - 1)
                    left -= room
                    at, sequence = 0, sequence + 1
                take = min(room, len(ids) // 4)
                ready.append((doc_id, start, ids[: 4 * take], total, sequence, at))
                ids, start, room, at = ids[4 * take :], start + take, room - take, at + take
        yield emitted(ready)

    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE, with_ids: bool = True, added_tokens: bool = True) -> DataFrame:
    """Pieces of all rows of `docs` (doc_id long, text string; other columns are ignored) in sequences of `length` tokens.

    A row's ids are its text's, then END_ID; a null text counts as empty and gives the one id. Rows with a null or
    repeated doc_id are packed like others, equal rows one after the other. Texts are taken whole. Equal keys are dealt
    out by doc_id and a hash of the row, so a large group of copies is spread over partitions. An empty table gives an
    empty result. With `with_ids`, each piece also carries its ids. The file's added tokens in a text have their own ids,
    as with the library's defaults; without `added_tokens` they count as ordinary text (its encode_special_tokens).
    """
    key = F.pandas_udf(_key, "long")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = ["curve", "doc_id", "tie"]
    placed = source.withColumn("curve", key("text")).withColumn("tie", F.xxhash64("doc_id", "text"))
    dealt = placed.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.mapInArrow(_packing(tokenizer_path, length, with_ids, added_tokens), schema + ", ids array<int>" * with_ids)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
