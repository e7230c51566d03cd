"""N-gram Jaccard join by prefix trees, to the components of linked documents.

A document is its set of hashed word n-grams in one global order: rarer first, by the levels of a fixed-size count
sketch over the whole corpus. Linked sets must share a gram among their first n - ceil(t n) + 1; these root entries are
dealt out by gram, and where two meet, the positions left of both bound the overlap. Equal sets are one class. Each
class is first verified against the most central one that it meets (the one that has the gram earliest); then, with
classes that are already connected left out, against every other one that the bounds admit. Verification stores the
sets in a trie, walks it with one set, shares the overlap of common paths and prunes subtrees by remaining lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_ID, arrow_batches, identified, partitions, release, table, text_of, written
from .components import connected_components

WORDS, PERCENT = 4, 85
SKETCH_BITS, CHUNKS = 22, 64
BATCH = 2000
SMALL_RUN = 4
TRIE_SETS = 256
_CHUNK = (1 << SKETCH_BITS) // CHUNKS
_HASH = np.uint64((1 << 56) - 1)


def gram_hashes(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word grams of a text (A-Z in lower case); of fewer words, one for all of them."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    x = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + h[i : len(h) - k + 1 + i]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(x ^ (x >> np.uint64(32)))


def least_overlap(n: int, m: int, percent: int) -> int:
    """Least common grams of linked sets of n and m: 100 * both >= percent * (n + m - both)."""
    return -(-percent * (n + m) // (100 + percent))


def _packed(counts: np.ndarray) -> bytes:
    """Counts of a chunk: a small task's as places and counts, others compressed; none as nothing."""
    used = np.flatnonzero(counts)
    if 4 * len(used) > len(counts):
        return b"D" + zlib.compress(counts.tobytes(), 1)
    return b"S" + used.astype("<u4").tobytes() + counts[used].astype("<u4").tobytes() if len(used) else b""


def _unpacked(packed: bytes) -> tuple[np.ndarray | slice, np.ndarray]:
    """Places and counts of a chunk."""
    if packed[:1] == b"D":
        return slice(None), np.frombuffer(zlib.decompress(packed[1:]), "<u4")
    both = np.frombuffer(packed[1:], "<u4")
    return both[: len(both) // 2], both[len(both) // 2 :]


def _sketched(values_of):
    """Partial sketch: how many values of a partition fall in each bucket, as packed chunks."""

    def run(it: Iterator[pa.RecordBatch]):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in it:
            for values in values_of(batch):
                np.add.at(counts, (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        rows = [(i, packed) for i in range(CHUNKS) if (packed := _packed(counts[i * _CHUNK : (i + 1) * _CHUNK]))]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([r[0] for r in rows], pa.int32()), "counts": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _summed(finish):
    """Whole counts of each chunk, finished into as many bytes as the driver needs of it."""

    def run(it: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                places, counts = _unpacked(packed.as_py())
                sums.setdefault(chunk, np.zeros(_CHUNK, np.int64))[places] += counts
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([finish(s).tobytes() for s in sums.values()], pa.binary())})

    return run


def _levels(counts: np.ndarray) -> np.ndarray:
    """One byte a bucket: eight levels for each doubling of its count."""
    return np.minimum(255, 8 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def _bits(counts: np.ndarray) -> np.ndarray:
    """One bit a bucket: whether anything fell into it."""
    return np.packbits(counts > 0)


def sketch(rows: DataFrame, values_of, finish) -> np.ndarray:
    """Counts of all values in 2**SKETCH_BITS buckets, finished on executors: of fixed size however many values there are."""
    size = len(finish(np.zeros(_CHUNK, np.int64)))
    out = np.zeros(CHUNKS * size, np.uint8)
    partial = rows.mapInArrow(_sketched(values_of), "chunk int, counts binary")
    for chunk, finished in partial.repartition(CHUNKS, "chunk").mapInArrow(_summed(finish), "chunk int, counts binary").collect():
        out[chunk * size : (chunk + 1) * size] = np.frombuffer(finished, np.uint8)
    return out


def _ordered(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Grams as numbers whose order is the global one: the level of the gram's bucket, then its hash."""
    return np.sort(levels[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | hashes & _HASH)


def _signature(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _roots(levels, k: int, percent: int):
    """One row with a null gram per document; per new set of a task, a row for each gram of its prefix."""

    def run(it: Iterator[pa.RecordBatch]):
        of = levels.value
        seen: set[int] = set()
        for batch in it:
            sigs, sizes, parts = [], [], []
            for cell in batch.column("text"):
                grams = _ordered(gram_hashes(cell.as_py(), k), of)
                n = len(grams)
                sig = _signature(grams)
                sigs.append(sig), sizes.append(n)
                if n and sig not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(sig)
                    prefix = grams[: n - least_overlap_of_one(n, percent) + 1]
                    parts.append((sig, n, prefix.view(np.int64)))
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "doc_id": batch.column("doc_id"), "sig": pa.array(sigs, pa.int64()), "n": pa.array(sizes, pa.int32()), "gram": pa.nulls(len(sigs), pa.int64()), "pos": pa.nulls(len(sigs), pa.int32())})
            if parts:
                lengths = np.array([len(p[2]) for p in parts])
                yield pa.RecordBatch.from_pydict({
                    "row": pa.nulls(int(lengths.sum()), batch.schema.field("row").type), "doc_id": pa.nulls(int(lengths.sum()), pa.int64()), "sig": np.repeat(np.array([p[0] for p in parts], np.int64), lengths), "n": np.repeat(np.array([p[1] for p in parts], np.int32), lengths),
                    "gram": np.concatenate([p[2] for p in parts]), "pos": np.concatenate([np.arange(x, dtype=np.int32) for x in lengths]),
                })

    return run


def least_overlap_of_one(n: int, percent: int) -> int:
    """Grams of a set of n that any linked set shares at least."""
    return -(-percent * n // 100)


def _admits(n1: int, p1: int, n2: int, p2: int, percent: int) -> bool:
    """Whether two sets whose first common gram stands at p1 and p2 can be linked."""
    return 1 + min(n1 - p1 - 1, n2 - p2 - 1) >= least_overlap(n1, n2, percent)


def _met(percent: int):
    """Rows sorted by (gram, pos, n, sig): pairs of short runs, the pair with the first row of longer ones, and the
    rows of longer runs themselves (b null). Only SMALL_RUN rows are held at a time."""
    names = ["a", "b", "n", "m", "gram", "pos", "star"]

    def run(it: Iterator[pa.RecordBatch]):
        gram, head, size, last = None, [], 0, None
        out: list[tuple] = []

        def pair(x, y, star):
            if x[0] != y[0] and _admits(x[1], x[2], y[1], y[2], percent):
                out.append((x[0], y[0], x[1], y[1], None, None, star))

        def grown(row):
            pair(head[0], row, True)
            out.append((row[0], None, row[1], None, gram, row[2], None))

        def closed():
            if size <= SMALL_RUN:
                for i in range(len(head)):
                    for j in range(i):
                        pair(head[j], head[i], False)

        for batch in it:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "sig", "n", "pos")]
            g = columns[0]
            # Rows whose gram stands alone are most of all; they are passed over without Python objects.
            same = np.zeros(len(g), bool)
            same[1:] = g[1:] == g[:-1]
            same[:-1] |= same[1:]
            if len(g):
                same[0] |= gram == g[0]
                same[-1] = True
            for i in np.flatnonzero(same | (np.arange(len(g)) == 0)):
                row = (int(columns[1][i]), int(columns[2][i]), int(columns[3][i]))
                if g[i] != gram:
                    closed()
                    gram, head, size, last = int(g[i]), [row], 1, row[0]
                    continue
                if row[0] == last:
                    continue
                last = row[0]
                size += 1
                if size <= SMALL_RUN:
                    head.append(row)
                    continue
                if size == SMALL_RUN + 1:
                    out.append((head[0][0], None, head[0][1], None, gram, head[0][2], None))
                    for x in head[1:]:
                        grown(x)
                grown(row)
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _MET)], names=names)
                out = []
        closed()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _MET)], names=names)

    return run


_MET = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]


class Trie:
    """Sets in global order as a radix tree; an edge holds the grams that all sets below it go on with."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())
        self.sets, self.order = sets, order
        # node: (edge, depth after it, least and most grams of the sets below, sets that end here, children)
        self.root = self._node(0, len(order), 0)

    def _node(self, lo: int, hi: int, depth: int):
        first, last = self.sets[self.order[lo]], self.sets[self.order[hi - 1]]
        n = min(len(first), len(last)) - depth
        differ = np.flatnonzero(first[depth : depth + n] != last[depth : depth + n])
        end = depth + (int(differ[0]) if len(differ) else n)
        sizes = [len(self.sets[i]) for i in self.order[lo:hi]]
        ends = [i for i in self.order[lo:hi] if len(self.sets[i]) == end]
        return first[depth:end], end, min(sizes), max(sizes), ends, lo + len(ends), hi

    def children(self, node):
        _, end, _, _, _, lo, hi = node
        while lo < hi:
            gram = self.sets[self.order[lo]][end]
            a, b = lo + 1, hi
            while a < b:
                mid = (a + b) // 2
                if self.sets[self.order[mid]][end] == gram:
                    a = mid + 1
                else:
                    b = mid
            yield self._node(lo, a, end)
            lo = a

    def linked(self, probe: np.ndarray, percent: int) -> list[int]:
        """Sets linked to `probe`, by one walk that shares the overlaps of common paths."""
        found, n = [], len(probe)
        stack = [(self.root, 0, 0)]
        while stack:
            node, at, overlap = stack.pop()
            edge, depth, least, most, ends, _, _ = node
            if len(edge):
                place = at + np.searchsorted(probe[at:], edge)
                overlap += int((probe[np.minimum(place, n - 1)] == edge)[place < n].sum())
                at = at + int(np.searchsorted(probe[at:], edge[-1], "right"))
            if overlap + min(n - at, most - depth) < least_overlap(n, least, percent):
                continue
            found += [i for i in ends if overlap >= least_overlap(n, depth, percent)]
            stack += [(c, at, overlap) for c in self.children(node)]
        return found


def _verified(percent: int):
    """Rows sorted by (a, salt, b): the probe's own set has a null b; the others are stored in tries and walked."""

    def run(it: Iterator[pa.RecordBatch]):
        key, probe, ids, sets = None, None, [], []
        out: list[tuple[int, int]] = []

        def walked():
            if sets:
                out.extend((key[0], ids[i]) for i in Trie(sets).linked(probe, percent))
                ids.clear(), sets.clear()

        for batch in it:
            for a, salt, b, grams in zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist(), batch.column("b").to_pylist(), batch.column("grams")):
                values = np.frombuffer(grams.as_py(), "<u8")
                if (a, salt) != key:
                    if key is not None:
                        walked()
                    key, probe = (a, salt), None
                if b is None:
                    probe = values
                    continue
                ids.append(b), sets.append(values)
                if len(sets) == TRIE_SETS:
                    walked()
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
            out = []
        if key is not None:
            walked()
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _holds(hits: np.ndarray, sig: int) -> bool:
    """Whether the bit of a class's bucket is set."""
    bucket = (sig + (1 << 63)) >> (64 - SKETCH_BITS)
    return bool(hits[bucket >> 3] >> (7 - (bucket & 7)) & 1)


def _sets(levels, wanted, k: int):
    """The whole sets of documents whose class may be among the wanted ones (a bucket filter of fixed size)."""

    def run(it: Iterator[pa.RecordBatch]):
        of, hits = levels.value, wanted.value
        seen: set[int] = set()
        for batch in it:
            rows = []
            for cell in batch.column("text"):
                grams = _ordered(gram_hashes(cell.as_py(), k), of)
                sig = _signature(grams)
                if len(grams) and _holds(hits, sig) and sig not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(sig)
                    rows.append((sig, grams.astype("<u8").tobytes()))
            yield pa.RecordBatch.from_pydict({"sig": pa.array([r[0] for r in rows], pa.int64()), "grams": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _sig_values(batch: pa.RecordBatch):
    yield batch.column("sig").to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


class _Join:
    """What the stages of one join share."""

    def __init__(self, source: DataFrame, k: int, percent: int):
        self.source, self.k, self.percent = source, k, percent
        self.spark: SparkSession = source.sparkSession
        with arrow_batches(self.spark, BATCH):
            levels = sketch(source.select("text"), lambda batch: (gram_hashes(c.as_py(), k) for c in batch.column("text")), _levels)
        self.levels = self.spark.sparkContext.broadcast(levels)

    def roots(self) -> DataFrame:
        with arrow_batches(self.spark, BATCH):
            return written(self.source.select("row", "doc_id", "text").mapInArrow(_roots(self.levels, self.k, self.percent), f"row {ROW_ID}, doc_id long, sig long, n int, gram long, pos int"), "roots")

    def met(self, roots: DataFrame) -> DataFrame:
        dealt = roots.filter("gram is not null").select("gram", "pos", "n", "sig").repartition(partitions(self.spark), "gram").sortWithinPartitions("gram", "pos", "n", "sig")
        return written(dealt.mapInArrow(_met(self.percent), "a long, b long, n int, m int, gram long, pos int, star boolean"), "met")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that are linked."""
        spread = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TRIE_SETS).cast("int").alias("salts"))
        salted = written(pairs.join(spread.hint("merge"), "a").select("a", F.pmod(F.hash("b"), F.col("salts")).alias("salt"), "b"), "wanted")
        wanted = salted.select("a", "salt", "b", F.col("b").alias("sig")).unionAll(salted.select("a", "salt").distinct().select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("sig")))
        with arrow_batches(self.spark, BATCH):
            hits = self.spark.sparkContext.broadcast(sketch(wanted.select("sig"), _sig_values, _bits))
            # Sets are dealt out by class once, for dropping repeats and for the join.
            sets = self.source.select("text").mapInArrow(_sets(self.levels, hits, self.k), "sig long, grams binary").dropDuplicates(["sig"])
            dealt = wanted.join(sets.hint("merge"), "sig").select("a", "salt", "b", "grams").repartition(partitions(self.spark), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
            links = written(dealt.mapInArrow(_verified(self.percent), "a long, b long"), "links")
        release(salted)
        return links


def ngram_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, row, first for every row of `docs` (doc_id long, text string; others are ignored).

    Rows are linked when 100 * common grams >= percent * grams of either. component_id is the least doc_id reachable by
    links; class_id the least doc_id with the same set; row is the row's id (of `identified`), and first marks
    one row of each component: that of the least doc_id, of equal ones the first row, a null id last. A null text counts as empty; rows without words have no grams
    and are linked with nothing. Rows with a null id keep their own row, and take part in links; an id comes from the
    rows that have one, and is null where none has. Repeated rows are equal sets. Texts are taken whole. An empty table
    gives an empty result.
    """
    return _components(identified(docs.select("doc_id", "text"), "row"), words, percent)


def _components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    source = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    join = _Join(source, words, percent)
    roots = join.roots()
    classes = written(roots.filter("gram is null").select("row", "doc_id", "sig", "n"), "classes")
    met = join.met(roots)
    release(roots)
    by_pair = met.filter("b is not null").select("a", "b", "star")
    # Of the pairs with the first of a longer run, each class takes the one with the class that leads most runs' starts.
    stars = by_pair.filter("star").groupBy("b", "a").agg(F.count(F.lit(1)).alias("n")).groupBy("b").agg(F.max(F.struct("n", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    pairs = by_pair.filter("not star").select("a", "b").distinct()
    first = written(pairs.unionAll(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = join.verify(first)
    # Longer runs once more: every pair that the bounds admit and that isn't connected yet.
    parts = connected_components(links)
    runs = met.filter("b is null").select("gram", F.col("a").alias("sig"), "n", "pos").join(parts.hint("merge"), F.col("sig") == F.col("node"), "left").withColumn("part", F.coalesce("root", "sig")).drop("node", "root")
    by_part = runs.groupBy("gram", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"))
    mixed = by_part.groupBy("gram").agg(F.count(F.lit(1)).alias("parts"), F.min("least").alias("least"), F.max(F.struct("rows", "part")).alias("main")).filter("parts > 1").select("gram", "least", F.col("main.part").alias("main"))
    need = lambda n, m: F.ceil((F.lit(percent) * (n + m)) / F.lit(100 + percent))
    open_rows = written(runs.join(mixed.hint("merge"), "gram").filter(F.col("n") - F.col("pos") >= need(F.col("n"), F.col("least"))), "open")
    x, y = open_rows.filter("part != main").select("gram", *[F.col(c).alias(f"x_{c}") for c in ("sig", "n", "pos", "part")]), open_rows.select("gram", *[F.col(c).alias(f"y_{c}") for c in ("sig", "n", "pos", "part")])
    left = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    more = x.join(y.hint("merge"), "gram").filter((F.col("x_part") != F.col("y_part")) & (left >= need(F.col("x_n"), F.col("y_n"))))
    rest = written(more.select(F.least("x_sig", "y_sig").alias("a"), F.greatest("x_sig", "y_sig").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        links = links.unionAll(join.verify(rest))
        parts = connected_components(links)
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    least = classes.groupBy("sig").agg(F.min(at).alias("least"))
    placed = written(least.join(parts.hint("merge"), F.col("sig") == F.col("node"), "left").select("sig", "least", F.coalesce("root", "sig").alias("part")), "parts")
    release(met, first, rest, open_rows)
    named = placed.join(placed.groupBy("part").agg(F.min("least").alias("top")).hint("merge"), "part").drop("part")
    rows = classes.withColumnRenamed("sig", "own").join(named.hint("merge"), F.col("own") == F.col("sig"))
    alone = F.col("n") == 0
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("component_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
        "row", (alone | (F.col("top.row") == F.col("row"))).alias("first"),
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` (doc_id long, text string among them), one of each component of `ngram_components`.

    It is that of the least doc_id, of equal ones the first row, a null id last; so of repeated rows one stays. Rows
    without words (null and empty texts among them) are linked with nothing and all stay. All columns stay as they are.
    An empty table gives an empty result.
    """
    own = identified(docs, "__row")
    kept = _components(own.select(F.col("__row").alias("row"), "doc_id", "text"), words, percent).filter("first").select(F.col("row").alias("__kept"))
    return own.join(kept.hint("merge"), F.col("__row") == F.col("__kept"), "left_semi").drop("__row")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")
