"""What the operators of this package share: table access and a typed ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from chunkwell.functions.storage import scratch, stored  # noqa: F401  (used by the other modules)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, f: Callable[..., Iterator[tuple]], schema: str, gate: tuple[int, str] | None = None, **params) -> DataFrame:
    """Apply ``f(batch_columns, **params) -> rows`` to each Arrow batch of ``df``.

    ``batch_columns`` is a list of Python lists, one per column of ``df``. An empty batch gives no rows.
    ``gate``: column number and RE2 pattern; rows whose text doesn't match are dropped before they become Python objects.
    """
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if gate:
                b = b.filter(pc.match_substring_regex(b.column(gate[0]), gate[1]))
            rows = list(f([c.to_pylist() for c in b.columns], **params))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def spread(df: DataFrame, *cols: str, parts: int | None = None) -> DataFrame:
    """Rows dealt evenly to tasks by a hash of ``cols``; for few heavy rows that come out of a filter."""
    return df.repartition(parts or max(12, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *[F.col(c) for c in cols])
