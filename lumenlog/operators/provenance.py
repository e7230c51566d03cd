"""Code provenance: paths, tool operations, commits, shares, bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.paths import OPERATIONS
from lumenlog.functions.text import ascii_lower, glob_pattern

def path_predicate(path: Column, basename: Column, pattern: str) -> Column:
    """Rows whose path a pattern means, by its form alone: a file name, a part of a path, an absolute path or folder, a
    glob. Parts of paths are compared without the case of A-Z; a part that ends in a file name must also be that file's."""
    given = pattern.strip()
    below = lambda folder: F.startswith(path, F.lit(folder + "/"))
    if not given:
        return F.lit(False)
    if set(given) & set("*?["):
        return path.rlike(glob_pattern(given if given[0] in "/*" else "*" + given))
    if given[-1] == "/":
        return below(given.rstrip("/"))
    if "/" not in given and given[0] != "~":
        return basename == given
    if given[0] in "/~":
        return (path == given) | below(given)
    part = given.lstrip("./").translate({i: i + 32 for i in range(65, 91)})
    name = given.rsplit("/", 1)[1]
    within = F.endswith(ascii_lower(path), F.lit("/" + part)) | F.contains(ascii_lower(path), F.lit("/" + part + "/"))
    return within & (basename == name) if "." in name else within


def op_predicate(op: Column, wanted: list[str] | None) -> Column:
    """Rows of the wanted operations; without any that is known, all rows."""
    known = [o for o in wanted or () if o in OPERATIONS]
    return op.isin(known) if known else F.lit(True)


def tally(touches: DataFrame, by: list[str], op: str = "op") -> DataFrame:
    """Touches by operation as a sorted array of (op, n), in two combining aggregates."""
    counts = touches.groupBy(*by, op).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(op, "n"))).alias("ops"), F.sum("n").alias("touches"))


def anchor(touches: DataFrame, by: list[str], op: str = "op", event: str = "event_id") -> DataFrame:
    """Of each group the newest event of its strongest operation."""
    rank = reduce(lambda a, b: a.when(F.col(op) == b[1], b[0]), list(enumerate(OPERATIONS))[1:], F.when(F.col(op) == OPERATIONS[0], 0)).otherwise(len(OPERATIONS))
    return touches.groupBy(*by).agg(F.min(F.struct(rank.alias("r"), (-F.col(event)).alias("e"))).alias("best")).select(*by, (-F.col("best.e")).alias("anchor"))


def by_next(touches: DataFrame, commits: DataFrame, key: str, at: str, commit: str) -> DataFrame:
    """Touches with the `commit` that they belong to: the next of their key at or after them, so those between two commits
    go to the later one. One sort of both by time within a key, no pairs; touches after the last commit are left out."""
    both = touches.select(key, at, F.lit(0).alias("__kind"), F.lit(None).cast("long").alias(commit)).unionByName(commits.select(key, at, F.lit(1).alias("__kind"), F.col(commit).cast("long").alias(commit)))
    onwards = Window.partitionBy(key).orderBy(at, "__kind", commit).rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn(commit, F.first(commit, ignorenulls=True).over(onwards)).filter(f"__kind = 0 and {commit} is not null").drop("__kind")


def prefix_either_way(a: DataFrame, b: DataFrame, x: str, y: str, block: int = 4) -> DataFrame:
    """Pairs where one hash begins with the other. Hashes meet by their first `block` characters; a shorter one is spread over
    the beginnings that it may have, so it must not be empty, and hashes are lower-case hexadecimal."""
    left, right = (_by_beginning(rows, name, block) for rows, name in ((a, x), (b, y)))
    return left.join(right, "__k").filter(F.startswith(x, F.col(y)) | F.startswith(y, F.col(x))).drop("__k").distinct()


def _by_beginning(rows: DataFrame, name: str, block: int) -> DataFrame:
    digits = F.array(*[F.lit(c) for c in "0123456789abcdef"])
    whole = F.length(name) >= block
    spread = F.array(F.col(name))
    for i in range(1, block):
        spread = F.when(F.length(name) + i <= block, F.flatten(F.transform(spread, lambda s: F.transform(digits, lambda c: F.concat(s, c))))).otherwise(spread)
    return rows.filter(F.length(name) > 0).withColumn("__k", F.explode(F.when(whole, F.array(F.substring(name, 1, block))).otherwise(spread)))
