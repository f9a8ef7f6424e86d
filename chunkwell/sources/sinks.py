"""Writers: artifacts, the index and its manifest, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.functions import text as T
from chunkwell.operators import models, quality

ARTIFACTS = ["prose_chunks", "tables_extracted", "flags_manual_review", "doc_metadata", "validation_report", "parent_store", "dedup_report", "index_manifest", "routing_report"]


def artifacts(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> list[str]:
    """Each named table below the folder; names outside the list of artifacts are an error."""
    if unknown := set(tables) - set(ARTIFACTS):
        raise ValueError(f"no such artifact: {sorted(unknown)}")
    for name, df in tables.items():
        df.write.mode("overwrite").format(kind).save(f"{folder}/{name}")
    return sorted(tables)


def index_rows(chunks: DataFrame, dims: int = 64, load=None) -> DataFrame:
    """Indexable chunks with path, embedded text (prefix and bare text) and vector, by the model that ``load`` gives or the stand-in."""
    c = quality.indexable(chunks)
    path = T.section_path(F.col("doc"), F.col("chapter"), F.col("kind"), F.col("node"), F.col("section_marker"), F.col("page"))
    c = c.withColumn("section_path", path)
    prefix = T.embed_prefix(F.col("source_act"), F.col("doc"), F.col("chapter"), F.col("section_path"), F.col("section_title"), F.col("kind"), F.col("amends_section"))
    return c.withColumn("embed_text", T.embed_text(prefix, F.col("text"))).withColumn("embedding", models.embed(F.col("embed_text"), dims, load))


def write_index(chunks: DataFrame, path: str, dims: int = 64) -> DataFrame:
    """The index rebuilt at ``path``, replaced as a whole; returns its one-row manifest."""
    index_rows(chunks, dims).write.mode("overwrite").parquet(path)
    return manifest(chunks, chunks.sparkSession.read.parquet(path), dims)


def manifest(chunks: DataFrame, index: DataFrame, dims: int) -> DataFrame:
    n = chunks.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(index.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    n = n.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("children_in"), F.coalesce(F.sum("b"), F.lit(0)).alias("indexed"))
    return n.select("children_in", "indexed", (F.col("children_in") - F.col("indexed")).alias("excluded"), F.lit("hashed_words").alias("model"), F.lit(dims).alias("dims"), F.lit("cosine").alias("space"))


def write_traces(traces: DataFrame, folder: str) -> None:
    traces.withColumn("stages", F.to_json("stages")).write.mode("overwrite").partitionBy("query_id").json(folder)
