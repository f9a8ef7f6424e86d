"""Measures of ranked lists against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def measures(ranked: DataFrame, relevant: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Per query: recall@k, reciprocal rank, nDCG@k, from (query_id, key, rank) and (query_id, key); queries without relevant records are left out."""
    rel = relevant.select("query_id", key).distinct()
    total = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    top = ranked.where(F.col("rank") <= k)
    hits = top.join(rel.withColumn("hit", F.lit(1)), ["query_id", key], "left_outer").where("hit = 1")
    a = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = total.join(a, "query_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("query_id", F.round(z(F.col("hits") / F.col("n_rel")), 6).alias("recall"), F.round(z(1 / F.col("first")), 6).alias("rr"), F.round(z(F.col("dcg") / ideal), 6).alias("ndcg"))


def duplicate_rate(ranked: DataFrame, key: str, content: DataFrame, hash_col: str) -> DataFrame:
    """Per query the share of listed records whose content an earlier one already had."""
    w = Window.partitionBy("query_id", hash_col).orderBy("rank")
    j = ranked.join(content.select(key, hash_col), key).withColumn("again", (F.row_number().over(w) > 1).cast("int"))
    return j.groupBy("query_id").agg(F.round(F.avg("again"), 6).alias("duplicate_rate"))


def gold_counts(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Gold queries with ``n_relevant``, the chunks of their gold section; 0 where it is unknown."""
    n = chunks.groupBy(F.col("doc").alias("gold_source_doc"), F.col("section_number").alias("gold_section_number")).agg(F.count("*").alias("n"))
    return gold.join(n, ["gold_source_doc", "gold_section_number"], "left").withColumn("n_relevant", F.coalesce("n", F.lit(0))).drop("n")
