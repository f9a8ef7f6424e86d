"""Containers of permitted capacities filled with texts sized in tokens: variable-capacity best fit.

Texts larger than the largest permitted capacity are divided into full containers and a rest; all others stay whole. Items
are dealt to shards of about ``SHARD_ITEMS`` by a hash of their key, and each shard is packed by best fit: a bin is opened for the
largest item left, and what goes in leaves the least room. All permitted capacities are tried, and the one of least cost
per token that it would hold is opened; at last every bin is downsized to the smallest permitted size that holds its
contents. The last, badly filled bins of a shard are few. Items are found in a bit set over sizes, so an item costs constant time.

Null texts are no items; an empty text is an item of size 0. Keys are expected to be unique; a repeated row is an item of its own
in the same shard. The tokenizer's file is a parameter and is read where the tasks run.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.llm.common import stored

SHARD_ITEMS = 20_000
TOKENIZER = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoding(path: str | None):
    import tiktoken
    import public_tokenizers as P

    with open(path or P.path(TOKENIZER), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens`` of every text; strings of special tokens are ordinary text."""
    kind = df.schema[key].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["key", "n_tokens"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null").mapInArrow(go, f"key {kind}, n_tokens long").withColumnRenamed("key", key)


def _filled(room: int, have: int, left: list[int]) -> tuple[list[int], int]:
    """(sizes, room that stays) of a bin into which goes, as long as there is one, the item that leaves the least room."""
    took: list[int] = []
    while room > 0:
        fits = have & ((1 << (room + 1)) - 1)
        while fits and (s := fits.bit_length() - 1) and left[s] <= took.count(s):
            fits &= ~(1 << s)  # all of this size are in the bin already
        s = fits.bit_length() - 1
        if s < 1:
            break
        took.append(s)
        room -= s
    return took, room


def best_fit(sizes: list[int], capacities: list[int], cost: Callable[[int], float] = float) -> tuple[list[int], list[int]]:
    """(bin of each item, capacity of each bin); every size must be within the largest capacity.

    A bin is opened for the largest item that is left. For each permitted capacity that holds it the bin is filled by best fit from
    what is left, and the capacity of least cost per token that would go in is opened so, of equal ones the largest.
    Items of size 0 go into the last bin.
    """
    caps = sorted(capacities)
    left, have = [0] * (caps[-1] + 1), 0  # items by size; bit s is set where a size has one
    items: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        items.setdefault(sizes[i], []).append(i)
        left[sizes[i]] += 1
        have |= 1 << sizes[i]
    where, bins = [0] * len(sizes), []

    def put(s: int) -> None:
        nonlocal have
        where[items[s].pop()] = len(bins)
        left[s] -= 1
        if not left[s]:
            have &= ~(1 << s)

    while have > 1:
        s = have.bit_length() - 1
        put(s)
        options = [(c, *_filled(c - s, have, left)) for c in caps if c >= s]
        c, took, room = min(options, key=lambda o: (cost(o[0]) / (o[0] - o[2]), -o[0]))
        for x in took:
            put(x)
        bins.append(c - room)
    bins = bins or [0] * bool(sizes)
    for i in items.get(0, []):
        where[i] = len(bins) - 1
    return where, [next(c for c in caps if c >= u) for u in bins]


def pack(counts: DataFrame, key: str, plans: dict[str, list[int]], shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per item: ``plan``, ``bin_id``, ``bin_capacity``, ``key``, ``part_no``, ``token_start``, ``tokens``.

    ``plans`` names lists of permitted capacities; each plan packs all items.
    """
    kind = counts.schema[key].dataType.simpleString()
    items = counts.select(F.col(key).alias("key"), "n_tokens")
    shards = max(1, math.ceil(items.count() / shard_items))
    tagged = items.select("key", "n_tokens", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), F.explode(F.array(*[F.lit(p) for p in plans])).alias("plan"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        plan, shard = pdf["plan"].iloc[0], int(pdf["shard"].iloc[0])
        caps = plans[plan]
        most = max(caps)
        n = pdf["n_tokens"].to_numpy()
        parts = np.maximum(1, -(-n // most))
        at = np.repeat(np.arange(len(n)), parts)
        no = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = no * most
        size = np.minimum(n[at] - start, most)
        keys = pdf["key"].to_numpy()[at]
        order = np.lexsort((no, keys, -size))
        where, cap = best_fit(size[order].tolist(), caps)
        where = np.array(where)
        return pd.DataFrame({"plan": plan, "bin_id": [f"{plan}-{shard}-{k}" for k in where], "bin_capacity": np.array(cap)[where], "key": keys[order], "part_no": no[order] + 1, "token_start": start[order], "tokens": size[order]})

    out = tagged.groupBy("plan", "shard").applyInPandas(one, f"plan string, bin_id string, bin_capacity long, key {kind}, part_no long, token_start long, tokens long")
    return out.withColumnRenamed("key", key)


def packed(df: DataFrame, key: str, text: str, plans: dict[str, list[int]], tokenizer: str | None = None) -> DataFrame:
    return pack(stored(token_counts(df, key, text, tokenizer)), key, plans)


def part_texts(bins: DataFrame, df: DataFrame, key: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """``bins`` with ``piece``, the bytes of each part (UTF-8; a divided text may be cut inside a character). Parts of one text, in order, join to it again."""
    kind = df.schema[key].dataType.simpleString()
    j = bins.select(*bins.columns).join(df.select(F.col(key).alias("__k"), F.col(text).alias("__t")).where("__t is not null").dropDuplicates(["__k"]), F.col(key) == F.col("__k"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(tokenizer)
        for b in batches:
            plan, bin_id, cap, k, no, start, n, t = (c.to_pylist() for c in b.columns)
            cut = [enc.decode_bytes(enc.encode_ordinary(x)[s : s + m]) for x, s, m in zip(t, start, n, strict=True)]
            cols = [*b.columns[:7], pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["plan", "bin_id", "bin_capacity", "key", "part_no", "token_start", "tokens", "piece"])

    cols = ["plan", "bin_id", "bin_capacity", key, "part_no", "token_start", "tokens", "__t"]
    return j.select(*cols).mapInArrow(go, f"plan string, bin_id string, bin_capacity long, key {kind}, part_no long, token_start long, tokens long, piece binary").withColumnRenamed("key", key)


def fill(bins: DataFrame) -> DataFrame:
    """Per plan: items, bins, tokens, capacity in all and the share of it that is used."""
    each = bins.groupBy("plan", "bin_id", "bin_capacity").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    out = each.groupBy("plan").agg(F.sum("items").alias("n_items"), F.count("*").alias("n_bins"), F.sum("tokens").alias("n_tokens"), F.sum("bin_capacity").alias("capacity"))
    return out.withColumn("fill_rate", F.round(F.col("n_tokens") / F.col("capacity"), 6))
