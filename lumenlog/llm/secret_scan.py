"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns (assignments, access identifiers, long hex runs) are reported wherever they are. Weak parts (account
identifiers, bare mixed tokens, endpoints) are only candidates: they are reported when complementary parts lie within
the same scope. Parts become rows of intervals, and the interval join of each part with those at most `scope` characters
away is a pair of windows over its document, sorted by start: the greatest end before and the least start after it, for
each set of kinds. That is linear in the parts, with no pairs of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table, text_of

VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN = rf"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?({VALUE})"""
# Runs are maximal, so a least length in the pattern and the dropping of short runs give the same matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENTIFIER = rf"""(?i)(?<![A-Za-z0-9_])(user(?:name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?({VALUE})"""
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""(?i)(?:(?:https?|ftp|wss?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.]))"""
#: kind, pattern, whether it is reported alone; the order is that of equal starts.
KINDS = [("assign", ASSIGN, True), ("access", ACCESS, True), ("hex", HEX, True), ("identifier", IDENTIFIER, False), ("candidate", CANDIDATE, False), ("endpoint", ENDPOINT, False)]
RANK = {k: i for i, (k, _, _) in enumerate(KINDS)}
SCOPE = 200


def _parts(text: Column, rank: int, kind: str, pattern: str) -> Column:
    """Array of (kind, i, gap, length, keep): each match with the characters between it and the match before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.when(F.size(found) > 0, F.split(text, pattern, -1))
    group = {"assign": 2, "identifier": 2}.get(kind)
    long_enough = (lambda m: F.length(F.regexp_extract(m, pattern, group)) >= (6 if kind == "assign" else 3)) if group else (lambda m: F.lit(True))
    made = F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(rank).alias("kind"), i.alias("i"), F.length(F.element_at(between, i + 1)).cast("long").alias("gap"), F.length(m).cast("long").alias("length"), long_enough(m).alias("keep")
        ),
    )
    return F.when(F.size(found) > 0, made)


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for every row of `docs` (doc_id long, text string).

    A null text counts as empty: no spans, the hash of the empty string. Rows with null or repeated ids each give their
    own row. Positions are code points of the whole text. Matches of a kind don't overlap; those of different kinds may,
    but a weak candidate that overlaps a strong span is part of it and isn't reported. An empty table gives an empty
    result. Other columns are ignored. Parts are linked if at most `scope` characters lie between the end of the one and
    the start of the other.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("rid", F.monotonically_increasing_id())
    none = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("length"), F.lit(True).alias("keep")))
    nothing = F.filter(none, lambda _: F.lit(False))
    found = [F.coalesce(_parts(F.col("text"), RANK[k], k, p), nothing) for k, p, _ in KINDS]
    rows = source.select("rid", "doc_id", F.explode(F.concat(none, *found)).alias("part")).select("rid", "doc_id", "part.*")
    dealt = rows.repartition(partitions(docs.sparkSession), "rid")  # one exchange serves the windows and the groups
    in_kind = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(in_kind)).withColumn("start", F.col("end") - F.col("length")).filter("keep")
    order = Window.partitionBy("rid").orderBy("start", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)

    def has(*kinds: str) -> Column:
        of = F.col("kind").isin(*[RANK[k] for k in kinds])
        ended, begins = F.max(F.when(of, F.col("end"))).over(before), F.min(F.when(of, F.col("start"))).over(after)
        return F.coalesce(ended >= F.col("start") - scope, F.lit(False)) | F.coalesce(begins <= F.col("end") + scope, F.lit(False))

    strong = F.col("kind").between(0, 2)
    judged = (
        placed.withColumn("inside", (F.coalesce(F.max(F.when(strong, F.col("end"))).over(before), F.lit(-1)) > F.col("start")) | (F.coalesce(F.min(F.when(strong, F.col("start"))).over(after), F.col("end")) < F.col("end")))
        .withColumn("secret_near", has("assign", "hex")).withColumn("candidate_near", has("candidate")).withColumn("id_near", has("access", "identifier")).withColumn("endpoint_near", has("endpoint"))
    )
    complete = (
        F.when(F.col("kind") == RANK["identifier"], F.col("secret_near") | F.col("candidate_near"))
        .when(F.col("kind") == RANK["candidate"], F.col("id_near"))
        .when(F.col("kind") == RANK["endpoint"], (F.col("secret_near") | F.col("candidate_near")) & F.col("id_near"))
        .otherwise(F.col("kind") <= 2)
    )
    kept = judged.filter(complete & ((F.col("kind") <= 2) | ~F.col("inside")))
    name = F.element_at(F.array(*[F.lit(k) for k, _, _ in KINDS]), F.greatest(F.col("kind"), F.lit(0)) + 1)
    span = F.struct("start", "kind", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("span"))
    joined = lambda spans: F.array_join(F.transform(F.sort_array(spans), lambda s: s["span"]), ",")
    count = lambda k: F.count(F.when(F.col("kind") == RANK[k], 1))
    return (
        kept.groupBy("rid", "doc_id").agg(
            count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
            F.collect_list(F.when(strong, span)).alias("base"), F.collect_list(F.when(F.col("kind") >= 0, span)).alias("all"), F.count(F.when(F.col("kind") > 2, 1)).alias("n_linked"),
        ).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), "n_linked")
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))
