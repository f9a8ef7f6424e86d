"""Scans: text files, page transcripts, pages, gold queries, registry, tables of earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from chunkwell.functions import text as T

BOX = [StructField(c, DoubleType()) for c in ("x0", "x1", "top", "bottom")]
PAGES = StructType(
    [
        StructField("doc", StringType()),
        StructField("page", IntegerType()),
        StructField("text", StringType()),
        StructField("width", DoubleType()),
        StructField("height", DoubleType()),
        StructField("words", ArrayType(StructType([StructField("text", StringType()), *BOX]))),
        StructField("tables", ArrayType(StructType([*BOX, StructField("rows", ArrayType(ArrayType(StringType())))]))),
    ]
)
GOLD = "query_id string, query_bangla string, query_english string, category string, gold_section_number string, gold_answer_gist string, gold_source_doc string, gold_figure string, multi_aspect_expected boolean, historical_expected boolean, dual_layer_expected boolean, notes string, verified_by string, verified_date string"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, doc, size) of the folder's own .pdf, .txt and .md files, whatever the case of their endings; no content is read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")
    return f.where(F.lower("path").rlike(r"\.(pdf|txt|md)$")).select("path", T.doc_slug(F.col("path")).alias("doc"), F.col("length").alias("size"))


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, doc, text) of text files, one row each; bytes that aren't UTF-8 become replacement characters."""
    f = spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike(r"\.(txt|md)$"))
    return f.select("path", T.doc_slug(F.col("path")).alias("doc"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, page, text) of ``folder``/<doc>/pNNN.txt, without blank and '#' lines; a page of only such lines has empty text."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "p[0-9]*.txt").load(folder)
    lines = F.filter(F.transform(F.split(F.make_valid_utf8(F.col("content").cast("string")), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return f.select(F.regexp_extract("path", r"([^/]+)/p[0-9]+\.txt$", 1).alias("doc"), F.regexp_extract("path", r"/p([0-9]+)\.txt$", 1).cast("int").alias("page"), F.array_join(lines, "\n").alias("text"))


def pages(spark: SparkSession, path: str, max_pages: int = 0) -> DataFrame:
    """Extracted pages (JSON lines); all of them, or the first ``max_pages`` of each document."""
    p = spark.read.schema(PAGES).json(path)
    return p.where(F.col("page") <= max_pages) if max_pages else p


def with_transcripts(pages_: DataFrame, scripts: DataFrame, label: str = "label") -> DataFrame:
    """Pages whose text and label give way to a transcript where there is one; the former label stays as ``pdf_label``."""
    s = scripts.select("doc", "page", F.col("text").alias("__t"))
    out = pages_.join(s, ["doc", "page"], "left").withColumn("pdf_label", F.col(label))
    out = out.withColumn(label, F.when(F.col("__t").isNotNull(), "transcribed").otherwise(F.col(label)))
    return out.withColumn("text", F.coalesce("__t", "text")).drop("__t")


def gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).option("multiLine", "true").json(path)


def registry(chunks: DataFrame, reg: DataFrame, cols: list[str], defaults: dict[str, object], order: str | None = None) -> DataFrame:
    """Chunks with their document's registry columns; the conservative default where a document isn't registered. Clashing columns are replaced.

    Of several rows for a document the first by ``order`` counts, without one the least.
    """
    r = F.struct(*cols)
    one = reg.groupBy("doc").agg((F.min_by(r, order) if order else F.min(r)).alias("__r"))
    out = chunks.drop(*cols).join(one, "doc", "left")
    return out.select(*[c for c in out.columns if c != "__r"], *[F.coalesce(F.col("__r")[c], F.lit(defaults.get(c))).alias(c) for c in cols])


def saved(spark: SparkSession, path: str) -> DataFrame:
    """A table of an earlier run, such as the parent store or the index; a missing path is an error."""
    return spark.read.parquet(path)
