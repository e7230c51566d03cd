"""Retrieval metrics and behaviour of searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ndcg(run: DataFrame, qrels: DataFrame, k: int, exponential: bool = True) -> DataFrame:
    """(qid, ndcg) of ranked results (qid, doc_id, rank from 1) against judgments (qid, doc_id, rel)."""
    gain = (F.pow(F.lit(2.0), "rel") - 1) if exponential else F.col("rel").cast("double")
    got = run.filter(F.col("rank") <= k).join(qrels, ["qid", "doc_id"]).groupBy("qid").agg(F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = qrels.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id"))).filter(F.col("r") <= k)
    best = ideal.groupBy("qid").agg(F.sum(gain / F.log2(F.col("r") + 1)).alias("idcg"))
    return best.join(got, "qid", "left").select("qid", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def first_gold(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(qid, rr, success@k, recall@k, all@k) from one join and one aggregate."""
    judged = qrels.filter("rel > 0").join(run, ["qid", "doc_id"], "left")
    marks = [F.count(F.when(F.col("rank") <= k, 1)).alias(f"n{k}") for k in ks]
    found = judged.groupBy("qid").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("gold"), *marks)
    return found.select("qid", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), *[(F.col(f"n{k}") > 0).cast("int").alias(f"success_{k}") for k in ks], *[(F.col(f"n{k}") / F.col("gold")).alias(f"recall_{k}") for k in ks], *[(F.col(f"n{k}") == F.col("gold")).cast("int").alias(f"all_{k}") for k in ks])


def attributed(events: DataFrame, session: str, order: str, is_search, is_read) -> DataFrame:
    """Reads with the latest search before them in the session."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("search", F.last(F.when(is_search, F.col(order)), ignorenulls=True).over(w)).filter(is_read & F.col("search").isNotNull())


def query_shape(text: Column) -> Column:
    """What kind of query a text is: pipe-or, boolean/phrase, code, natural or single-term."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    boolean = F.contains(text, F.lit('"')) | F.exists(words, lambda w: w.isin("AND", "OR", "NOT"))
    code = text.rlike("_|::") | F.exists(words, lambda w: F.contains(w, F.lit(".")) & ~F.endswith(w, F.lit(".")))
    return F.when(F.contains(text, F.lit("|")), "pipe-or").when(boolean, "boolean/phrase").when(code, "code").when(F.size(words) >= 2, "natural").otherwise("single-term")
