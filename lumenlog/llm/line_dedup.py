"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only; the edit bound is one character.

Equal lines meet by hash. Two lines within one edit agree outside one block of a few hundred characters, so each
distinct line first emits its variants with one whole block deleted; only lines that share such a variant go on. These
emit, inside the block, every variant with one character deleted (and the whole block, for insertions) as hashed keys;
equal variants meet in a window, which names the earliest partner of each line without listing pairs, and the pair's
edit distance is then verified on the texts. The earliest line by (doc_id, row, line number) stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import identified, partitions, release, table, text_of, written

#: Lines this long are also matched within one edit; shorter ones, where one edit changes much, only if equal.
NEAR_CHARS = 20
BLOCK, MOST_BLOCKS = 256, 64


def _lines(docs: DataFrame) -> DataFrame:
    """rid, doc_id, pos, line and its 128-bit hash (h1, h2), for lines with a letter or digit, and for any of at least
    NEAR_CHARS characters. `docs` has rid."""
    rows = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    lines = rows.select("rid", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.filter((F.length("line") >= NEAR_CHARS) | F.col("line").rlike(r"[\p{L}\p{N}]"))
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def _blocks(base: Column) -> Column:
    return F.least(F.greatest(F.lit(2), F.ceil(base / BLOCK).cast("int")), F.lit(MOST_BLOCKS))


def _bounds(base: Column, i: Column, m: Column) -> tuple[Column, Column]:
    """Characters before block i of m, and characters after it, of a line of `base` characters."""
    return F.floor(i * base / m).cast("int"), base - F.floor((i + 1) * base / m).cast("int")


def _block_keys(lines: DataFrame) -> DataFrame:
    """Rows (h1, h2, shorter, i, key): hashes of each line without its block i; `shorter`: 1 to meet lines with one
    character less. Lines of two blocks, which are most, have expressions of their own, which are compiled."""
    line, size = F.col("line"), F.col("size")

    def key(shorter: int, i: Column, before: Column, after: Column) -> Column:
        hashed = F.xxhash64(size - shorter, i, F.substring(line, F.lit(1), before), F.substring(line, size - after + 1, after))
        return F.struct(F.lit(shorter).alias("shorter"), i.alias("i"), hashed.alias("key"))

    def halves(shorter: int) -> list[Column]:
        half = F.floor((size - shorter) / 2).cast("int")
        return [key(shorter, F.lit(0), F.lit(0), size - shorter - half), key(shorter, F.lit(1), half, F.lit(0))]

    def blocks(shorter: int) -> Column:
        base, m = size - shorter, F.col(f"m{shorter}")
        return F.transform(F.sequence(F.lit(0), m - 1), lambda i: key(shorter, i, *_bounds(base, i, m)))

    sized = lines.withColumn("size", F.length("line")).withColumn("m0", _blocks(size)).withColumn("m1", _blocks(size - 1))
    keys = F.when(size <= 2 * BLOCK, F.array(*halves(0), *halves(1))).otherwise(F.concat(blocks(0), blocks(1)))
    return sized.select("h1", "h2", F.explode(keys).alias("k")).select("h1", "h2", "k.*")


def near_lines(docs: DataFrame, distinct: DataFrame, near_chars: int) -> DataFrame:
    """(h1, h2) of distinct lines of at least `near_chars` characters with an earlier such line at edit distance one."""
    lines = _lines(docs).filter(F.length("line") >= near_chars)
    keyed = _block_keys(lines.select("line", "h1", "h2")).repartition(partitions(docs.sparkSession), "key").distinct()
    shared = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1").drop("n")
    placed = shared.join(distinct.select("h1", "h2", "first").hint("merge"), ["h1", "h2"])
    texts = lines.select(F.col("rid").alias("t_rid"), F.col("pos").alias("t_pos"), "line")
    found = written(placed.join(texts.hint("merge"), (F.col("first.rid") == F.col("t_rid")) & (F.col("first.pos") == F.col("t_pos"))).drop("t_rid", "t_pos"), "lines")
    base = F.length("line") - F.col("shorter")
    before, after = _bounds(base, F.col("i"), _blocks(base))
    with_block = found.withColumn("block", F.substring(F.col("line"), before + 1, F.length("line") - before - after)).drop("line")
    block = F.col("block")
    without = lambda p: F.concat(F.substring(block, F.lit(1), p - 1), F.substring(block, p + 1, F.length(block)))
    places = F.when(F.length(block) > 0, F.sequence(F.lit(1), F.length(block))).otherwise(F.expr("cast(array() as array<int>)"))
    # Role 0: the block as it is; 1: one character deleted, to meet a role 0; 2: one character replaced at a place.
    deleted = F.transform(places, lambda p: F.struct(F.xxhash64("key", F.lit(0), without(p)).alias("variant"), F.lit(1).alias("role")))
    replaced = F.transform(places, lambda p: F.struct(F.xxhash64("key", p, without(p)).alias("variant"), F.lit(2).alias("role")))
    whole = F.array(F.struct(F.xxhash64("key", F.lit(0), block).alias("variant"), F.lit(0).alias("role")))
    variants = with_block.select(F.struct("first", "h1", "h2").alias("own"), F.explode(F.when(F.col("shorter") == 1, deleted).otherwise(F.concat(whole, replaced))).alias("v")).select("own", "v.*")
    group = Window.partitionBy("variant")
    earliest = lambda role: F.min(F.when(F.col("role") == role, F.col("own"))).over(group)
    met = variants.withColumn("partner", F.when(F.col("role") == 0, earliest(1)).when(F.col("role") == 1, earliest(0)).otherwise(earliest(2)))
    pairs = met.filter("partner.first < own.first").select("own", "partner").distinct()
    lines = found.select("h1", "h2", "line").distinct()
    x, y = lines.toDF("x1", "x2", "x_line"), lines.toDF("y1", "y2", "y_line")
    verified = (
        pairs.join(x, (F.col("partner.h1") == F.col("x1")) & (F.col("partner.h2") == F.col("x2"))).join(y, (F.col("own.h1") == F.col("y1")) & (F.col("own.h2") == F.col("y2")))
        .filter(F.levenshtein("x_line", "y_line", 1) == 1)
    )
    near = written(verified.select(F.col("own.h1").alias("h1"), F.col("own.h2").alias("h2")).distinct(), "near")
    release(found)
    return near


def repeated_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """rid and the sorted 0-based numbers `removed` of the repeated lines of each row of `docs`, which has rid."""
    lines = _lines(docs)
    distinct = written(
        lines.select("h1", "h2", F.struct("doc_id", "rid", "pos").alias("at")).groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "distinct"
    )
    near = near_lines(docs, distinct, near_chars).withColumn("near", F.lit(True))
    judged = distinct.select("h1", "h2", "first", "n").join(near.hint("merge"), ["h1", "h2"], "left").filter("n > 1 or near").select("h1", "h2", F.col("first.rid").alias("f_rid"), F.col("first.pos").alias("f_pos"), F.coalesce("near", F.lit(False)).alias("near"))
    # Written, so that the join with all lines is one of two exchanges, whose skewed keys Spark splits.
    judged = written(judged, "judged")
    placed = lines.select("rid", "pos", "h1", "h2").join(judged.hint("merge"), ["h1", "h2"]).filter("near or rid != f_rid or pos != f_pos")
    return placed.groupBy("rid").agg(F.sort_array(F.collect_list("pos")).alias("removed"))


def line_dedup(docs: DataFrame, near_chars: int = NEAR_CHARS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of `docs` (doc_id long, text string among them) with text without its repeated lines, and `counts`: its
    lines and those removed.

    Lines are parts of a text between line feeds. A line goes if it equals an earlier one, whatever its length, or if
    it has at least `near_chars` characters and an earlier distinct line of at least as many is at edit distance one,
    whether or not that one stays itself. Lines under NEAR_CHARS characters without a letter or digit (empty ones,
    rulers) are layout and always stay. Lines are ordered by doc_id (null first), then row, then place, so of repeated
    rows the first keeps its lines. A null text stays null and has one empty line. Texts and lines are taken whole. An
    empty table gives an empty result. Columns of `docs` that are named as `counts` are replaced, all others stay.
    """
    own = identified(docs, "__row")
    gone = repeated_lines(own.select(F.col("__row").alias("rid"), "doc_id", "text"), near_chars).withColumnsRenamed({"rid": "__rid", "removed": "__removed"})
    joined = own.join(gone.hint("merge"), F.col("__row") == F.col("__rid"), "left")
    lines = F.split(text_of(), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__removed"))
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return joined.withColumn(counts[0], F.size(lines)).withColumn(counts[1], F.coalesce(F.size("__removed"), F.lit(0))).withColumn("text", text).drop("__row", "__rid", "__removed")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, removed lines and their 0-based numbers, joined by commas."""
    docs = identified(table(spark, sf_dir, "documents").select("doc_id", "text"), "rid")
    gone = repeated_lines(docs).withColumnRenamed("rid", "g_rid")
    rows = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.size(F.split(text_of(), "\n", -1)).cast("long").alias("n_lines"))
    return rows.join(gone.hint("merge"), F.col("rid") == F.col("g_rid"), "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines")
    )
