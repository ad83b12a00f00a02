"""Rank fusion, filters after or before ranking, and dispatch by strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
FINAL_LIMIT = 15


def rrf(first: DataFrame, second: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, score, rank): reciprocal ranks of two ranked lists summed; ties keep the first list's order, then the second's."""
    lists = first.select("query_id", "doc_id", F.col("rank").alias("r1"), F.lit(None).cast("int").alias("r2")).unionByName(second.select("query_id", "doc_id", F.lit(None).cast("int").alias("r1"), F.col("rank").alias("r2")))
    one = lists.groupBy("query_id", "doc_id").agg(F.min("r1").alias("r1"), F.min("r2").alias("r2"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    scored = one.select("query_id", "doc_id", F.round(part("r1") + part("r2"), 9).alias("score"), F.coalesce("r1", F.lit(1 << 30)).alias("a"), F.coalesce("r2", F.lit(1 << 30)).alias("b"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "a", "b", "doc_id"))).drop("a", "b")


def postfilter(ranked: DataFrame, allowed: DataFrame, limit: int = FINAL_LIMIT) -> DataFrame:
    """Ranked rows whose (query_id, doc_id) is allowed, at most `limit` per question: filtered after ranking, so fewer than k may stay."""
    kept = ranked.join(allowed.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("n") <= limit).drop("n")
