"""Registered queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwell.llm import furniture, leakage, lookalike, mojibake, neardup, packing, segment, sentences, sql, truncation
from chunkwell.llm.common import table

CHUNKS = "prose_chunks"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, CHUNKS), "chunk_id", "text").select("chunk_id").distinct()


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, CHUNKS), "chunk_id", "text").distinct()


def _pieces(spark: SparkSession, d: str, keep_small: bool) -> DataFrame:
    cap = table(spark, d, "size_limits").where("limit_name = 'chunk_cap'").first()
    return segment.split_oversized(table(spark, d, CHUNKS), "chunk_id", "text", "node", cap.max_size, cap.overlap_share, keep_small)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, False).where("piece_no = 2").select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, True).dropDuplicates(["chunk_id", "piece_no"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return furniture.recurring_lines(table(spark, d, CHUNKS), "chunk_id", "doc", "page", "text")


def p3_sequences(spark: SparkSession, d: str) -> DataFrame:
    return furniture.frequent_sequences(table(spark, d, CHUNKS), "chunk_id", "doc", "page", "text")[0]


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return furniture.without_lines(table(spark, d, CHUNKS), "chunk_id", "text", p3_found(spark, d)).distinct()


def _both(spark: SparkSession, d: str) -> DataFrame:
    """The texts of both tables; a chunk that is delivered twice is kept twice here, its results are made distinct."""
    rec = lambda t, k, x: table(spark, d, t).select(F.concat(F.lit(t + "|"), k).alias("rec"), F.col(x).alias("text"))
    return rec(CHUNKS, "chunk_id", "text").unionByName(rec("test_queries", "query_id", "query_bangla"))


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.substring_index("rec", "|", 1).alias("table_name"), F.expr("substring(rec, instr(rec, '|') + 1)").alias("record_id"), *[c for c in df.columns if c != "rec"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, CHUNKS)
    audit = table(spark, d, "sentence_audit").select("chunk_id").distinct()
    some = chunks.select("chunk_id", "text").join(audit, "chunk_id", "left_semi")
    return sentences.sentences(some, "chunk_id", "text", sentences.statistics(chunks, "text")).select("chunk_id", "end_pos").distinct()


def p6_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every chunk."""
    chunks = table(spark, d, CHUNKS)
    return sentences.sentences(chunks, "chunk_id", "text", sentences.statistics(chunks, "text")).dropDuplicates(["chunk_id", "sentence_no"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _named(lookalike.changed(_both(spark, d), "rec", "text").select("rec").distinct())


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    """The one form of each record that isn't in it as stored, garbled ones included."""
    return _named(lookalike.changed(_both(spark, d), "rec", "text", garbled=True).distinct())


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rec = neardup.records(table(spark, d, CHUNKS), "chunk_id", "text", [F.col("source_act"), F.col("section_number")])
    return rec, neardup.similar_classes(rec)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rec, links = _near(spark, d)
    return neardup.pairs_of(rec, links).select(F.col("key_a").alias("chunk_id_a"), F.col("key_b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    rec, links = _near(spark, d)
    return neardup.groups(rec, links).select(F.col("key").alias("chunk_id"), "group_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rec, links = _near(spark, d)
    return neardup.survivors(table(spark, d, CHUNKS), "chunk_id", "text", neardup.groups(rec, links)).select("chunk_id")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    rec, links = _near(spark, d)
    return neardup.merged(table(spark, d, CHUNKS), "chunk_id", "text", neardup.groups(rec, links))


def p8_bins(spark: SparkSession, d: str) -> DataFrame:
    """Each pack_* capacity by itself, and all of them permitted together."""
    caps = {r.limit_name: [r.max_size] for r in table(spark, d, "size_limits").where("limit_name like 'pack_%'").orderBy("limit_name").collect()}
    return packing.packed(table(spark, d, "documents"), "doc_id", "text", caps | {"pack_joint": sorted(c for x in caps.values() for c in x)})


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_bins(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_spans(spark, d).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_passages"), "item_id", "text")


def p9_removal(spark: SparkSession, d: str) -> DataFrame:
    """The words that each document loses, whatever item they come from."""
    return leakage.removal_spans(p9_spans(spark, d), "doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(table(spark, d, "documents"), "doc_id", "source", "text").where("is_cut").select("doc_id")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.shares(table(spark, d, "documents"), "doc_id", "source", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": sql.P2_FOUND, "p3_found": sql.P3_FOUND, "p3_cleaned": sql.P3_CLEANED, "p4_found": sql.P4_FOUND, "p5_found": sql.P5_FOUND, "p9_found": sql.P9_FOUND}
