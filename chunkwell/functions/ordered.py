"""Ordered computations over groups of any size, in two levels: within buckets of the order, and over one row per bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16


def numbered(df: DataFrame, group: str, order: str, out: str, width: int = WIDTH) -> DataFrame:
    """Adds ``out``: the 1-based place of a row in its group by ``order`` (a whole number). A hot group is spread over its buckets."""
    b = df.withColumn("__b", F.floor(F.col(order) / width))
    counts = b.groupBy(F.col(group).alias("__g"), "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__g", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    local = b.withColumn("__i", F.row_number().over(Window.partitionBy(group, "__b").orderBy(order)))
    j = local.join(base, local[group].eqNullSafe(base["__g"]) & local["__b"].eqNullSafe(base["__b"])).select(*[local[c] for c in df.columns], (F.col("__i") + F.coalesce("__o", F.lit(0))).alias(out))
    return j


def carried(df: DataFrame, group: str, bucket: str, order: str, events: dict[str, Column]) -> DataFrame:
    """Adds for each name the last non-null event at or before the row, by (bucket, order) within the group; null where there was none.

    Events are carried within a bucket by a window of that bucket, and from bucket to bucket over one row each.
    """
    rows = df
    for n, e in events.items():
        rows = rows.withColumn(f"__{n}", e)
    last = rows.groupBy(F.col(group).alias("__g"), F.col(bucket).alias("__b")).agg(*[F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.col(order))).alias(f"__l_{n}") for n in events])
    before = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    start = last.select("__g", "__b", *[F.last(f"__l_{n}", ignorenulls=True).over(before).alias(f"__s_{n}") for n in events])
    j = rows.join(start, rows[group].eqNullSafe(start["__g"]) & rows[bucket].eqNullSafe(start["__b"]))
    here = Window.partitionBy(group, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n in events:
        j = j.withColumn(n, F.coalesce(F.last(f"__{n}", ignorenulls=True).over(here), F.col(f"__s_{n}")))
    return j.select(*df.columns, *events)
