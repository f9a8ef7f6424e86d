"""The structural gate: per-document checks over chunks, flags, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwell.functions import text as T
from chunkwell.functions.ordered import WIDTH, numbered

FURNITURE_TOKENS, FURNITURE_PAGES, FURNITURE_SHARE, PARENTLESS_SHARE = 10, 3, 0.4, 0.5
# Fixed value: what a page number looks like on a line of its own.
PAGE_NUMBER = r"^(?:page\s*)?[-–—\s]*[0-9০-৯]{1,4}[-–—\s]*(?:of\s*[0-9]+)?$"


def delivered_once(df: DataFrame, key: str = "chunk_id", order: str = "seq") -> DataFrame:
    """Of records delivered again the first, by ``order``; of equal ones any.

    Each task keeps one row per key before the shuffle (a limit of the window's groups), and only the columns that are used later travel.
    """
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def fill_nodes(df: DataFrame, doc: str = "doc", order: str = "seq", node: str = "node") -> DataFrame:
    """Blank nodes become blkNNN by position in the document."""
    out = numbered(df, doc, order, "__place")
    return out.withColumn(node, F.when(F.coalesce(F.col(node), F.lit("")) == "", F.format_string("blk%03d", F.col("__place"))).otherwise(F.col(node))).drop("__place")


def continuity(df: DataFrame, doc: str, number: str, order: str) -> DataFrame:
    """Section numbers out of order: (doc, check, at, detail) for each backward jump and each gap.

    Rows (``order`` a whole number) are compared within buckets of the order; what crosses buckets is carried over one row each, so a hot
    document is spread. Gaps are looked for among a document's distinct numbers.
    """
    n = df.select(F.col(doc).alias("doc"), F.col(number).try_cast("int").alias("n"), F.col(order).alias("ord")).where("n is not null").withColumn("b", F.floor(F.col("ord") / WIDTH))
    each = n.groupBy("doc", "b").agg(F.max_by("n", "ord").alias("last"), F.max("n").alias("top"))
    earlier = Window.partitionBy("doc").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    start = each.select(F.col("doc").alias("d"), F.col("b").alias("c"), F.last("last").over(earlier).alias("last0"), F.max("top").over(earlier).alias("top0"))
    here = Window.partitionBy("doc", "b").orderBy("ord")
    n = n.join(start, n["doc"].eqNullSafe(start["d"]) & (n["b"] == start["c"]))
    n = n.withColumn("prev", F.coalesce(F.lag("n").over(here), "last0")).withColumn("top", F.greatest(F.max("n").over(here.rowsBetween(Window.unboundedPreceding, -1)), "top0"))
    jumps = n.where("(prev is null or prev <> n) and n < top").select("doc", F.lit("backward").alias("check"), F.col("n").alias("at"), F.col("top").alias("detail"))
    d = n.select("doc", "n").distinct()
    gaps = d.withColumn("nxt", F.lead("n").over(Window.partitionBy("doc").orderBy("n"))).where("nxt > n + 1").select("doc", F.lit("gap").alias("check"), F.col("n").alias("at"), F.col("nxt").alias("detail"))
    return jumps.unionByName(gaps)


def furniture(df: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", tokens: str = "est_tokens") -> DataFrame:
    """Adds ``is_furniture``: short chunks whose text stands on many pages of the document, or is a page number.

    Pages are counted as distinct values, a missing page as one. Only counts per (doc, text) travel; they are joined back by equality.
    """
    base = df.withColumn("__t", F.lower(T.normalize(F.col(text)))).withColumn("__d", F.col(doc))
    cand = F.coalesce(F.col("retrievable"), F.lit(True)) & (F.coalesce(F.col(tokens), F.lit(99)) <= FURNITURE_TOKENS) & (F.col("__t") != "")
    pages = df.groupBy(F.col(doc).alias("__d")).agg(F.countDistinct(page).alias("__n"))
    seen = base.where(cand).groupBy("__d", "__t").agg(F.countDistinct(F.coalesce(F.col(page).cast("int"), F.lit(-1))).alias("__p"))
    many = seen.join(pages, "__d").where(F.col("__p") >= F.greatest(F.lit(FURNITURE_PAGES), F.floor(F.lit(FURNITURE_SHARE) * F.col("__n")))).select("__d", "__t", F.lit(True).alias("__f"))
    out = base.join(many, ["__d", "__t"], "left").withColumn("is_furniture", cand & (F.coalesce("__f", F.lit(False)) | F.col("__t").rlike(PAGE_NUMBER)))
    return out.drop("__d", "__t", "__f")


def report(df: DataFrame, doc: str = "doc", strict: bool = False) -> DataFrame:
    """One row per document: counts, failures, review items, whether it is blocked, pass rate. One aggregation."""
    text, kind, node = T.normalize(F.col("text")), F.col("kind"), F.coalesce(F.col("node"), F.lit(""))
    leaf = kind == "leaf"
    orphan = leaf & node.contains("(") & (F.coalesce(F.col("section_marker"), F.lit("")) == "")
    a = df.groupBy(F.col(doc).alias("doc")).agg(
        F.count("*").alias("items"),
        F.count_if(leaf).alias("leaves"),
        F.count_if(orphan).alias("parentless_leaves"),
        F.count_if(node == "").alias("blank_nodes"),
        F.count_if(text == "").alias("empty_texts"),
        F.count_if(kind == "front_matter").alias("front_matter"),
        F.count_if((kind == "front_matter") & F.col("retrievable")).alias("retrievable_front"),
        F.count_if(F.col("pollution") == "page_furniture").alias("furniture_stripped"),
        F.countDistinct(F.nullif("section_marker", F.lit(""))).alias("sections_seen"),
    )
    bad = F.col("parentless_leaves") > F.col("leaves") * PARENTLESS_SHARE
    say = lambda c, t: F.when(c > 0, F.concat(c.cast("string"), F.lit(t)))
    drop = lambda *x: F.filter(F.array(*x), lambda v: v.isNotNull())
    failures = drop(say(F.col("blank_nodes"), " blank nodes"), say(F.col("empty_texts"), " empty texts"), say(F.col("retrievable_front"), " retrievable mastheads"), F.when(F.col("front_matter") > 1, F.lit("more than one masthead")), F.when(bad, F.lit("most clauses have no section")))
    review = drop(F.when(~bad, say(F.col("parentless_leaves"), " clauses without section")), say(F.col("furniture_stripped"), " furniture lines"))
    out = a.withColumn("failures", failures).withColumn("review", review)
    failed = F.col("blank_nodes") + F.col("empty_texts") + F.col("retrievable_front") + F.when(F.col("front_matter") > 1, 1).otherwise(0) + F.when(bad, 1).otherwise(0)
    out = out.withColumn("checks_total", F.col("items") + 5).withColumn("checks_failed", failed)
    out = out.withColumn("ok", F.size("failures") == 0).withColumn("blocked", (F.size("failures") > 0) | (F.lit(strict) & (F.size("review") > 0)))
    return out.withColumn("pass_rate", F.round(1 - F.col("checks_failed") / F.greatest(F.lit(1), F.col("checks_total")), 3))


def flags(chunks: DataFrame, reports: DataFrame) -> DataFrame:
    """The quarantine rows of stripped furniture and blocked documents."""
    cols = ["kind", "node", "text", "doc", "page", "reason"]
    a = chunks.where("pollution = 'page_furniture'").select(F.lit("furniture_stripped").alias("kind"), "node", "text", "doc", "page", F.lit("page_furniture").alias("reason"))
    b = reports.where("blocked").select(F.lit("document_blocked").alias("kind"), F.lit("").alias("node"), F.lit("").alias("text"), "doc", F.lit(None).cast("int").alias("page"), F.array_join(F.concat("failures", "review"), "; ").alias("reason"))
    return a.select(cols).unionByName(b.select(cols))


def rejected_table(df: DataFrame) -> DataFrame:
    """Flags of table chunks that weren't kept, from ``table_chunks``' columns."""
    return df.where("not kept").select(F.lit("table_validation_failed").alias("kind"), "doc", "page", F.array_join("reasons", "; ").alias("reason"))


def all_flags(*producers: DataFrame) -> DataFrame:
    """The flags of all producers (furniture and blocked documents, rejected grids, unreadable pages) in one table; what one lacks is null."""
    cols = {"kind": "string", "node": "string", "text": "string", "doc": "string", "page": "int", "reason": "string"}
    fit = lambda f: f.select(*[(F.col(c) if c in f.columns else F.lit(None)).cast(t).alias(c) for c, t in cols.items()])
    return reduce(DataFrame.unionByName, [fit(f) for f in producers])


def index_bound(df: DataFrame, reports: DataFrame) -> DataFrame:
    """Retrievable chunks of documents that aren't blocked."""
    return df.where("retrievable").join(reports.where("not blocked").select("doc"), "doc", "left_semi")


def indexable(c: DataFrame) -> DataFrame:
    return c.where((F.coalesce(F.col("retrievable"), F.lit(False))) & (F.coalesce(F.col("kind"), F.lit("")) != "front_matter"))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
