"""Benchmark decontamination: CGK random walks, repeated bit-sampling LSH over item-sized windows, exact verification.

Texts and items are sequences of normalised words. A CGK walk copies a window symbol by symbol and moves on at random
coin flips that depend on step and symbol, so windows at a small edit distance get walks at a small Hamming distance.
Each of several walks is sampled at a few random steps; a window whose sample equals one of an item's windows is a
candidate. Windows are item-sized: their length is the largest power of two of at most two thirds of the item's words
(and at most 128), and they start at places chosen by content (the hash of two neighbouring words), in texts and items
alike, so an item gives several windows and an edit spoils only some. Items also have an exact path: cut into one piece more than it may have edits, an item within the bound has a piece (two to
four words) that stands whole in the text, so every run of words that equals a piece is a candidate too. Words are
hashed to find candidates; each candidate is then verified on the words themselves: the item's exact edit distance to
the best stretch of words of the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_ID, identified, table, text_of

#: Words of the windows of each size class; items with fewer words than the least are compared as a whole.
CLASSES = (4, 8, 16, 32, 64, 128)
WALKS, SAMPLES = 10, 4
#: One of four places is a start of windows of up to 16 words, and fewer of longer ones, which take more steps each.
START_MODULUS, LEAST_STARTS = {c: max(4, c // 4) for c in CLASSES}, 4
MAX_EDITS_PERCENT = 20
#: Items, and characters of them, searched for in one pass over the documents; more are taken in blocks of so many.
ITEMS_PER_PASS, BYTES_PER_PASS = 20_000, 8 << 20
BLOCK_WORDS = 400_000
_STRIP = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain_words(text: str) -> list[bytes]:
    """The lower-case words of a text without ASCII punctuation; words that are all punctuation go."""
    return text.lower().encode().translate(_STRIP, _PUNCTUATION).split()


def words_of(text: str) -> np.ndarray:
    """Hashes of the words of a text."""
    return np.fromiter(map(zlib.crc32, plain_words(text)), np.uint32, -1)


def class_of(length: int) -> int:
    """Words of the windows of an item of so many words: at most two thirds of them, so that it has several windows, and
    the least class for the shortest items; 0 if it only matches whole."""
    return max((c for c in CLASSES if 3 * c <= 2 * length), default=CLASSES[0] if length >= CLASSES[0] else 0)


def _runs(h: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of `q` words."""
    key = np.full(max(len(h) - q + 1, 0), q, np.uint32)
    for j in range(q):
        key = (key ^ h[j : j + len(key)]) * np.uint32(0x9E3779B1)
        key ^= key >> np.uint32(15)
    return key


class Embedding:
    """Coins of the walks and the sampled steps of each size class, for the classes in use."""

    def __init__(self, classes: tuple[int, ...] = CLASSES, seed: int = 4):
        r = np.random.default_rng(seed)
        self.classes = classes
        # Walk and class -> the steps sampled, among those that two flips a word would take.
        sampled = {(w, c): np.sort(r.choice(np.arange(2 * c - c // 2), min(SAMPLES, c), replace=False)) for w in range(WALKS) for c in CLASSES}
        self.chosen = {k: frozenset(x.tolist()) for k, x in sampled.items() if k[1] in classes}
        self.last = {k: max(x) for k, x in self.chosen.items()}
        self.steps = 2 * max(classes, default=0)
        self.salt = r.integers(1, 1 << 32, (WALKS, 2 * CLASSES[-1]), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        #: Pairs of words that are starts besides, by a hash of 20 bits: set for items with few starts of their own.
        self.more = {c: np.zeros(1 << 20, bool) for c in classes}

    def pairs(self, h: np.ndarray) -> np.ndarray:
        """Mixed hash of each word with the next."""
        mixed = (h[:-1] * np.uint32(0x85EBCA6B)) ^ (h[1:] * np.uint32(0xC2B2AE35))
        return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)

    def starts(self, h: np.ndarray, classes: tuple[int, ...] | None = None) -> dict[int, np.ndarray]:
        """For each class the places whose two words hash to a multiple of its modulus, or are a start of it besides."""
        classes = self.classes if classes is None else classes
        if len(h) < 2:
            return {c: np.zeros(0, np.int64) for c in classes}
        mixed = self.pairs(h)
        high, low = mixed >> np.uint32(12), mixed >> np.uint32(8)
        return {c: np.flatnonzero((low % np.uint32(START_MODULUS[c]) == 0) | self.more[c][high]) for c in classes}

    def shared(self, starts: dict[int, np.ndarray], size: int) -> list[tuple]:
        """How classes share their walks over a text of `size` words: for each class in order, its number of windows among
        those that still go on, where its own are among them, and which of them go on after it."""
        order, out, place = sorted(starts), [], np.zeros(size, np.int64)
        going = [np.zeros(size, bool) for _ in order]
        for n, c in enumerate(order):
            for earlier in going[: n + 1]:
                earlier[starts[c]] = True
        active = [np.flatnonzero(g) for g in going] + [np.zeros(0, np.int64)]
        for n, c in enumerate(order):
            place[active[n]] = np.arange(len(active[n]))
            out.append((c, active[n], place[starts[c]], place[active[n + 1]]))
        return out

    def keys(self, h: np.ndarray, shared: list[tuple], walk: int) -> dict[int, np.ndarray]:
        """For each class the sampled keys of the windows at its starts: all windows take the steps of the shortest class,
        then those of longer ones go on. `h` must go on for 2 c words after a start."""
        order, out, step = [c for c, *_ in shared], {}, 0
        if order:
            at = shared[0][1].astype(np.int32)
            key = {c: np.full(len(at), c, np.uint32) for c in order}
        for n, (c, _, own, going_on) in enumerate(shared):
            while step <= self.last[walk, c]:
                symbol = h[at]
                for k in order[n:]:
                    if step in self.chosen[walk, k]:
                        key[k] = (key[k] ^ symbol) * np.uint32(0x9E3779B1)
                        key[k] ^= key[k] >> np.uint32(15)
                at += ((symbol * self.salt[walk, step]) >> np.uint32(31)).astype(np.int32)
                step += 1
            out[c] = key[c][own]
            at, key = at[going_on], {k: key[k][going_on] for k in order[n + 1 :]}
        return out


def _table(rows) -> tuple:
    """Rows (key, item, place) as a filter of 20 bits of the keys, and sorted arrays."""
    r = sorted(rows)
    keys = np.array([x[0] for x in r], np.uint32)
    bits = np.zeros(1 << 20, bool)
    bits[keys >> np.uint32(12)] = True
    return bits, keys, np.array([x[1] for x in r], np.int64), np.array([x[2] for x in r], np.int64)


class Items:
    """The benchmark items of one pass: their words and the window keys that lead to them."""

    def __init__(self, items: list[tuple[int, str]], percent: int = MAX_EDITS_PERCENT):
        self.ids = [i for i, _ in items]
        self.plain = [plain_words(t) for _, t in items]
        self.words = [words_of(t) for _, t in items]
        self.lengths = np.array([len(h) for h in self.words], np.int64)
        self.classes = tuple(sorted({class_of(n) for n in self.lengths.tolist()} - {0}))
        self.embedding = Embedding(self.classes)
        self.short = {}
        pad = np.zeros(self.embedding.steps, np.uint32)
        rows = {(w, c): [] for w in range(WALKS) for c in self.classes}
        for h in self.words:
            c = class_of(len(h))
            if c and (self.embedding.starts(h, (c,))[c] <= len(h) - c).sum() < LEAST_STARTS:
                places = np.linspace(0, len(h) - c, LEAST_STARTS).astype(np.int64)
                self.embedding.more[c][self.embedding.pairs(h)[places] >> np.uint32(12)] = True
        for n, h in enumerate(self.words):
            c = class_of(len(h))
            if not c:
                if len(h):
                    self.short.setdefault(int(h[0]), []).append(n)
                continue
            own = self.embedding.starts(h, (c,))[c]
            own = own[own <= len(h) - c]
            alone = self.embedding.shared({c: own}, len(h))
            for w in range(WALKS):
                keys = self.embedding.keys(np.concatenate([h, pad]), alone, w)[c]
                # A key that repeats within an item leads to its first and last place there.
                last = {int(k): int(s) for k, s in zip(keys, own)}
                first = {int(k): int(s) for k, s in zip(keys[::-1], own[::-1])}
                rows[w, c] += [(k, n, s) for k in first for s in {first[k], last[k]}]
        self.tables = {at: _table(r) for at, r in rows.items()}
        self.pieces = self._pieces(percent)

    def _pieces(self, percent: int) -> dict[int, tuple]:
        """Words of a piece -> its runs as in `tables`, for items of at least the least class: an item that may have e
        edits is cut into e + 1 pieces, each edit spoils one at most, and the first words of each piece are kept."""
        rows: dict[int, set] = {}
        for n, h in enumerate(self.words):
            if len(h) >= CLASSES[0]:
                parts = percent * len(h) // 100 + 1
                q = len(h) // parts
                own = np.arange(parts) * q
                rows.setdefault(q, set()).update((int(k), n, int(s)) for k, s in zip(_runs(h, q)[own], own))
        return {q: _table(found) for q, found in rows.items()}

    def candidates(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place where it would begin, place where it was met) of all windows of `h`, a text that ends with
        `steps` zeros."""
        items, places, met = [], [], []

        def look_up(table, found, own):
            bits, keys, of, offsets = table
            hit = np.flatnonzero(bits[found >> np.uint32(12)])
            lo, hi = np.searchsorted(keys, found[hit]), np.searchsorted(keys, found[hit], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if n.sum() else np.zeros(0, np.int64)
            items.append(of[at])
            met.append(np.repeat(own[hit], n))
            places.append(met[-1] - offsets[at])

        for q, pieces in self.pieces.items():
            runs = _runs(h, q)
            look_up(pieces, runs, np.arange(len(runs)))
        starts = self.embedding.starts(h[: len(h) - self.embedding.steps])
        shared = self.embedding.shared(starts, len(h))
        for w in range(WALKS if self.classes else 0):
            for c, found in self.embedding.keys(h, shared, w).items():
                look_up(self.tables[w, c], found, starts[c])
        for i in np.flatnonzero(np.isin(h, np.array(list(self.short), np.uint32))) if self.short else ():
            items.append(np.array(self.short[int(h[i])]))
            places.append(np.full(len(items[-1]), i))
            met.append(places[-1])
        return tuple(map(np.concatenate, (items, places, met))) if items else (np.zeros(0, np.int64),) * 3


def best_stretch(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the stretch of `text` with the least edit distance to `item`, if at most `most`; of equal
    ones the first to end, and of those the latest to begin."""
    n = len(item)
    cost = np.arange(n + 1)
    begin = np.zeros(n + 1, np.int64)
    best = (n, 0, 0) if n <= most else None
    steps = np.arange(n + 1)
    for j, word in enumerate(text, 1):
        up, diagonal = cost + 1, cost[:-1] + (item != word)
        now, start = np.concatenate([[0], np.minimum(diagonal, up[1:])]), np.concatenate([[j], np.where(diagonal < up[1:], begin[:-1], np.where(diagonal > up[1:], begin[1:], np.maximum(begin[:-1], begin[1:])))])
        # Insertions of item words: the running least of cost minus place; of equal ones the latest to begin.
        order = (now - steps) * (1 << 32) - start
        lowest = np.minimum.accumulate(order)
        value = -((-lowest) >> 32)
        start = value * (1 << 32) - lowest
        cost, begin = value + steps, start
        if cost[n] <= most and (best is None or cost[n] < best[0]):
            best = int(cost[n]), int(begin[n]), j
    return best


def exact_stretch(item: list[bytes], text: list[bytes], most: int) -> tuple[int, int, int] | None:
    """`best_stretch` of the words themselves."""
    number: dict[bytes, int] = {}
    numbered = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in (item, text)]
    return best_stretch(*numbered, most)


_FOUND = ["doc_id", "item_id", "n_edits", "item_words", "start_word", "end_word"]


def _found(shared, percent: int):
    def batch_of(rows, row_type) -> pa.RecordBatch:
        columns = [[r[i] for r in rows] for i in range(len(_FOUND) + 1)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], row_type)] + [pa.array(c, pa.int64()) for c in columns[1:]], names=["row", *_FOUND])

    def searched(held, items: Items):
        """held: (row, doc_id, words, text) of some texts, searched as one with zeros between them."""
        gap = np.zeros(max(items.embedding.steps, max(items.pieces, default=1)), np.uint32)
        h = np.concatenate([x for _, _, words, _ in held for x in (words, gap)])
        ends = np.cumsum([len(words) + len(gap) for _, _, words, _ in held])
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        of, places, met = items.candidates(h)
        most = percent * items.lengths[of] // 100
        # Places a few words apart lead to one stretch: they are verified once, with room on both sides.
        doc = np.searchsorted(ends, met, "right")
        begin = places - np.concatenate([[0], ends])[doc]
        for d, n, cell in np.unique(np.stack([doc, of, np.maximum(begin, 0) // (most + 2)], 1), axis=0).tolist():
            if found.get((d, n), (1,))[0] == 0:
                continue
            item, words = items.words[n], held[d][2]
            most = percent * len(item) // 100
            lo = max(0, cell * (most + 2) - most - 1)
            stretch = words[lo : lo + len(item) + 4 * most + 4]
            # Each edit spoils one word of the item at most, so all others must be there.
            if np.isin(item, stretch).sum() < len(item) - most:
                continue
            # Words with equal hashes can only make the distance look smaller, so those within it are looked at again.
            hit = best_stretch(item, stretch, most) and exact_stretch(items.plain[n], plain_words(held[d][3])[lo : lo + len(stretch)], most)
            if hit and ((d, n) not in found or hit[0] < found[d, n][0]):
                found[d, n] = hit[0], hit[1] + lo, hit[2] + lo
        return [(held[d][0].as_py(), held[d][1], items.ids[n], hit[0], len(items.words[n]), *hit[1:]) for (d, n), hit in sorted(found.items())]

    def run(it: Iterator[pa.RecordBatch]):
        items = shared(percent)
        held, size, row_type = [], 0, None
        for batch in it:
            rows, row_type = [], batch.schema.field("row").type
            for row, doc_id, cell in zip(batch.column("row"), batch.column("doc_id").to_pylist(), batch.column("text")):
                text = cell.as_py()
                held.append((row, doc_id, words_of(text), text))
                size += len(held[-1][2])
                if size > BLOCK_WORDS:
                    rows += searched(held, items)
                    held, size = [], 0
            yield batch_of(rows, row_type)
        if held:
            yield batch_of(searched(held, items), row_type)

    return run


def _shared(broadcast):
    kept: list[Items] = []

    def items(percent: int) -> Items:
        if not kept:
            kept.append(Items(broadcast.value, percent))
        return kept[0]

    return items


def contaminations(docs: DataFrame, items: DataFrame, percent: int = MAX_EDITS_PERCENT, per_pass: int = ITEMS_PER_PASS, bytes_per_pass: int = BYTES_PER_PASS) -> DataFrame:
    """row, doc_id, item_id, n_edits, item_words, start_word, end_word: the best stretch of each item in each row of `docs`.

    docs: doc_id long, text string; items: item_id long, text string; other columns are ignored. A stretch counts if its
    edit distance to the item, in normalised words, is at most `percent` of the item's words. `row` is the row's id (of
    `identified`). Null texts and items without words match nothing; items of under four words only match whole (their
    bound rounds to no edits); items of over 128 words have windows of 128; repeated rows match each; equal items each
    match. Items are taken in blocks of at most `per_pass` items and `bytes_per_pass` of text (or one item), each with
    one pass over all documents. Empty tables give an empty result.
    """
    return _contaminations(identified(docs.select("doc_id", "text"), "row"), items, percent, per_pass, bytes_per_pass)


def _contaminations(docs: DataFrame, items: DataFrame, percent: int = MAX_EDITS_PERCENT, per_pass: int = ITEMS_PER_PASS, bytes_per_pass: int = BYTES_PER_PASS) -> DataFrame:
    spark = docs.sparkSession
    source = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = f"row {ROW_ID}, " + ", ".join(f"{c} long" for c in _FOUND)
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).filter("item_id is not null")
    out, block, size = None, [], 0

    def searched(rows):
        found = source.mapInArrow(_found(_shared(spark.sparkContext.broadcast(rows)), percent), schema)
        return found if out is None else out.unionAll(found)

    for r in wanted.orderBy("item_id", "text").toLocalIterator():
        if block and (len(block) == per_pass or size + len(r.text) > bytes_per_pass):
            out, block, size = searched(block), [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block or out is None:
        out = searched(block)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of `docs` (doc_id long, text string among them) that hold no item, as `contaminations` finds them.

    Null and empty texts hold nothing and stay; repeated rows stay or go together; items with a null id or text aren't
    searched for. All columns stay as they are. Empty tables of documents give an empty result, of items all rows.
    """
    own = identified(docs, "__row")
    hit = _contaminations(own.select(F.col("__row").alias("row"), "doc_id", "text"), items, **options).select(F.col("row").alias("__hit")).distinct()
    return own.join(hit.hint("merge"), F.col("__row") == F.col("__hit"), "left_anti").drop("__row")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")
