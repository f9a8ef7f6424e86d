"""Parents of chunks: sections in bounded parts, and chunks that are their own parent."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.functions import text as T
from chunkwell.functions.ordered import numbered
from chunkwell.functions.storage import stored

CHILDREN, TOKENS = 40, 5000


FOLDED, BUCKET = 2048, 1 << 14


def _next_starts(t: np.ndarray, children: int, cap: int) -> np.ndarray:
    """Where the part that begins at each row gives way to the next: when it is full by children, or a row would take it over the cap."""
    c = np.concatenate(([0], np.cumsum(t)))
    at = np.arange(len(t))
    over = np.searchsorted(c, c[:-1] + cap, side="right") - 1
    return np.minimum(np.maximum(over, at + 1), at + children)


def _folded(df: DataFrame, names: list[str], children: int, cap: int) -> DataFrame:
    """Parts of small groups: a fold over each group's (order, tokens)."""
    zero = F.struct(F.array().cast("array<struct<o:bigint,p:int>>").alias("out"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("t"), F.lit(1).alias("p"))

    def step(s, x):
        full = (s.n > 0) & ((s.n >= children) | (s.t + x.t > cap))
        p = F.when(full, s.p + 1).otherwise(s.p)
        return F.struct(F.concat(s.out, F.array(F.struct(x.o.alias("o"), p.alias("p")))).alias("out"), F.when(full, 1).otherwise(s.n + 1).alias("n"), F.when(full, x.t).otherwise(s.t + x.t).alias("t"), p.alias("p"))

    cells = F.array_sort(F.collect_list(F.struct("o", "t")))
    x = df.groupBy(*names).agg(F.aggregate(cells, zero, step, lambda s: s.out).alias("x"))
    return x.select(*names, F.explode("x").alias("x")).select(*names, "x.o", F.col("x.p").alias("part"))


def _bucketed(df: DataFrame, names: list[str], children: int, cap: int) -> DataFrame:
    """Parts of large groups, bucket by bucket of BUCKET rows.

    A part has at most ``children`` rows, so for each way that a bucket can be entered (how many of its first rows belong to the part
    before) where it is left and how many parts begin can be worked out by itself. One row per bucket is then folded in order.
    """
    rows = numbered(df.withColumn("k", F.struct(*names)), "k", "o", "place").select("k", "o", "t", F.floor((F.col("place") - 1) / BUCKET).alias("b"), ((F.col("place") - 1) % BUCKET).cast("int").alias("i"))
    rows = stored(rows.withColumn("h", F.xxhash64("k")))  # read twice
    ahead = rows.where((F.col("i") < children) & (F.col("b") > 0)).select("h", "t", (F.col("b") - 1).alias("b"), (F.col("i") + BUCKET).alias("i"))

    def ways(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        nxt = _next_starts(pdf["t"].to_numpy(), children, cap)
        n = min(len(pdf), BUCKET)
        left, began = np.zeros(n + children + 1, np.int64), np.zeros(n + children + 1, np.int64)
        left[n:] = np.arange(children + 1)
        for i in range(n - 1, -1, -1):
            left[i], began[i] = left[nxt[i]], began[nxt[i]] + 1
        return pd.DataFrame({"h": [pdf["h"].iloc[0]], "b": [pdf["b"].iloc[0]], "ends": [left[: children + 1].tolist()], "began": [began[: children + 1].tolist()]})

    way = rows.select("h", "t", "b", "i").unionByName(ahead).groupBy("h", "b").applyInPandas(ways, "h long, b long, ends array<long>, began array<long>")
    zero = F.struct(F.array().cast("array<struct<b:bigint,e:bigint,p:bigint>>").alias("out"), F.lit(0).cast("bigint").alias("e"), F.lit(0).cast("bigint").alias("p"))
    step = lambda s, x: F.struct(F.concat(s.out, F.array(F.struct(x.b.alias("b"), s.e.alias("e"), s.p.alias("p")))).alias("out"), x.ends[s.e.cast("int")].alias("e"), (s.p + x.began[s.e.cast("int")]).alias("p"))
    enter = way.groupBy("h").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("b", "ends", "began"))), zero, step, lambda s: s.out).alias("x")).select("h", F.explode("x").alias("x")).select("h", "x.*")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        nxt, begins = _next_starts(pdf["t"].to_numpy(), children, cap), np.zeros(len(pdf), np.int64)
        i = int(pdf["e"].iloc[0])
        while i < len(pdf):
            begins[i] = 1
            i = int(nxt[i])
        return pd.DataFrame({"h": pdf["h"], "o": pdf["o"], "part": pdf["p"] + np.cumsum(begins)})

    got = rows.select("h", "o", "t", "b", "i").join(enter, ["h", "b"]).groupBy("h", "b").applyInPandas(number, "h long, o long, part long")
    return rows.join(got, ["h", "o"]).select(*[F.col(f"k.{n}").alias(n) for n in names], "o", F.col("part").cast("int").alias("part"))


def part_numbers(df: DataFrame, group: list[str], order: str, tokens: str, children: int = CHILDREN, cap: int = TOKENS) -> DataFrame:
    """(group, order, part): a new part begins when one is full by children or tokens. ``order`` is a whole number, unique in its group.

    Groups of up to FOLDED rows are folded as a whole, larger ones bucket by bucket; both give the same parts, and no group is one task's.
    """
    cells = df.select(*group, F.col(order).cast("bigint").alias("o"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("t"))
    big = cells.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > FOLDED).drop("n")
    out = _folded(cells.join(big, group, "left_anti"), group, children, cap)
    if not big.isEmpty():
        out = out.unionByName(_bucketed(cells.join(big, group, "left_semi"), group, children, cap))
    return out.withColumnRenamed("o", order)


def build(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(children with parent_id, parents) of prose chunks with seq, doc, section_marker, section_title, chapter, text, page, est_tokens.

    Identifiers are keys of the content, so no order over all rows is needed.
    """
    c = chunks.withColumn("t", F.coalesce(F.when(F.col("est_tokens") > 0, F.col("est_tokens")), T.estimate_tokens(F.col("text")))).withColumn("m", F.coalesce("section_marker", F.lit("")))
    own = c.where("m = ''").withColumn("parent_id", T.content_id("par", F.lit("self"), F.col("doc"), F.col("seq")))
    inside = c.where("m <> ''")
    inside = inside.join(part_numbers(inside, ["doc", "m"], "seq", "t"), ["doc", "m", "seq"])
    inside = inside.withColumn("parent_id", T.content_id("par", F.lit("prose"), F.col("doc"), F.col("m"), F.col("part")))
    first = lambda x: F.min_by(x, F.when(F.coalesce(F.col(x), F.lit("")) != "", F.col("seq"))).alias(x)
    groups = inside.groupBy("parent_id", "doc", "m", "part").agg(
        first("section_title"),
        first("chapter"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("x")))), lambda s: s.x), "\n\n").alias("text"),
        F.array_sort(F.collect_set("page")).alias("pages"),
        F.count("*").cast("int").alias("n_children"),
        F.sum("t").cast("int").alias("est_tokens"),
    )
    parts = groups.groupBy(F.col("doc").alias("d"), F.col("m").alias("s")).agg(F.count("*").alias("n"))
    title = F.coalesce("section_title", F.lit(""))
    groups = groups.join(parts, F.col("doc").eqNullSafe(F.col("d")) & (F.col("m") == F.col("s"))).select("parent_id", F.lit("prose").alias("kind"), "doc", F.col("m").alias("section_marker"), F.when(F.col("n") > 1, F.format_string("%s (part %d/%d)", title, F.col("part"), F.col("n"))).otherwise(title).alias("section_title"), "chapter", "text", "pages", "n_children", "est_tokens")
    selfs = own.select("parent_id", F.lit("self").alias("kind"), "doc", F.lit("").alias("section_marker"), F.coalesce("section_title", F.lit("")).alias("section_title"), "chapter", "text", F.when(F.col("page").isNotNull(), F.array("page")).otherwise(F.array().cast("array<int>")).alias("pages"), F.lit(1).alias("n_children"), F.col("t").cast("int").alias("est_tokens"))
    children = own.select("seq", "parent_id").unionByName(inside.select("seq", "parent_id"))
    return children, groups.unionByName(selfs)


def sections(chunks: DataFrame) -> DataFrame:
    """(doc, section_marker, n_children, title, chapter, pages, chars) of every section; ``build`` joins the texts, in bounded parts, of which only the length is needed here."""
    t = chunks.where("coalesce(section_marker, '') <> ''")
    first = lambda x: F.min_by(x, F.when(F.col(x) != "", F.col("seq")))
    return t.groupBy("doc", "section_marker").agg(
        F.count("*").alias("n_children"),
        first("section_title").alias("title"),
        first("chapter").alias("chapter"),
        F.array_join(F.array_sort(F.collect_set("page")), ",").alias("pages"),
        (F.sum(F.length(F.coalesce("text", F.lit("")))) + (F.count("*") - 1) * 2).alias("chars"),
    )
