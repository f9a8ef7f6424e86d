"""Records that share most of their word runs, by pigeonring filtering; groups of them; one survivor for each group.

A record is the set A of its distinct runs of three words, a 0/1 vector over all runs. A similarity |A and B| / |A or B| >= t
is a Hamming distance of at most (1 - t) / (1 + t) * (|A| + |B|). The runs are dealt to ``BOXES`` segments of a ring by
hash, and segment i gets the proportional budget (1 - t) / (1 + t) * (|A_i| + |B_i|). By the pigeonring principle some
segment of every pair in question begins a chain round the ring of which each beginning stays within its
cumulative budget. The steps:

1. One pass over the texts turns each into runs of 40-bit hashes, written once to the shared folder.
2. The frequency of runs is counted in 2**20 buckets (up to 2**23 where there are more than 2**30 runs), a table that only orders runs (rare ones first).
3. In the segment that begins the chain the sets reach t themselves, so they share k of the first
   |A_i| - ceil(t |A_i|) + k runs in that order, for any k up to ceil(t |A_i|); k grows with |A_i|. Only these are dealt to tasks by
   hash, in packed blocks, one segment after the other, each one's files deleted before the next, and records that share k
   of them become candidates. The entries of hot runs are split into blocks instead, and joined block by
   block; what decides whether a chain may begin is part of the join's condition. Entries of runs so common that they could
   overwhelm a task are dealt by record from the start.
4. Chains are tested on 64-bit sketches of the segments, whose differing bits never exceed the true distance.
5. The few pairs that remain get the full Hamming check on their runs, in slices where there are many.

Records with equal sets are one class throughout, whatever its number of copies; no candidate is ever capped.
Null and short texts (fewer than ``min_words`` words) take no part. Null blocking keys equal one another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwell.functions.storage import release
from chunkwell.llm import lookalike
from chunkwell.llm.common import stored
from chunkwell.operators.graph import components

BOXES, HASH_BYTES, HOT, COMMON, COPIES, STEP, SLICES = 4, 5, 2048, 1 << 20, 4096, 16, 2
T, MIN_WORDS, RUN = 0.6, 40, 3
ODD = np.uint64(0x9E3779B97F4A7C15)
STRIP = r"[\pP\pS]+"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _pack(h: np.ndarray) -> np.ndarray:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]


def unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def _word_hashes(words: pa.Array) -> np.ndarray:
    enc = words.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in enc.dictionary.to_pylist()), np.uint64, len(enc.dictionary))
    return each[enc.indices.to_numpy(zero_copy_only=False)] if len(enc) else np.zeros(0, np.uint64)


def _runs(texts: pa.Array, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of words without case, punctuation and symbols, sorted, without repeats in a row."""
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), STRIP, "")))
    n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten()
    row = np.repeat(np.arange(len(n)), n)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    if not full.all():
        flat, row = flat.filter(pa.array(full)), row[full]
    w = _word_hashes(flat)
    m = len(w) - run + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(run):
        h = _mix(h * ODD + w[k : k + m] + np.uint64(k))
    ok = row[:m] == row[run - 1 :]
    row, h = row[:m][ok], h[ok] >> np.uint64(64 - 8 * HASH_BYTES)
    o = np.lexsort((h, row))
    row, h = row[o], h[o]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _box(h: np.ndarray) -> np.ndarray:
    return (_mix(h * ODD) >> np.uint64(62)).astype(np.int64) % BOXES


SIG = [*(f"c{i}" for i in range(BOXES)), *(f"m{i}" for i in range(BOXES))]
RUNS = [f"r{i}" for i in range(BOXES)]
RECORD = "key string, block long, rid long, n int, " + ", ".join([f"r{i} binary" for i in range(BOXES)] + [f"c{i} int" for i in range(BOXES)] + [f"m{i} long" for i in range(BOXES)])


def records(df: DataFrame, key: str, text: str, block: list[Column], min_words: int = MIN_WORDS, run: int = RUN) -> DataFrame:
    """One stored row per delivered record of enough words: its class ``rid``, the runs of its segments, and their sketches.

    The runs are left out where the same task has already given them for the class.
    """
    scores = lookalike.bigrams(df, text)
    gate = lookalike.gate_pattern()
    same = [F.coalesce(F.concat(F.lit("v"), b.cast("string")), F.lit("n")) for b in block]
    some = df.select(F.col(key).cast("string"), F.xxhash64(*same).alias("block"), F.col(text).alias("text")).where("text is not null")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = lookalike.Reader(scores), set()
        for b in (whole.slice(k, 2500) for whole in batches for k in range(0, len(whole), 2500)):
            texts = b.column(2)
            odd = pc.match_substring_regex(texts, gate)
            if pc.any(odd).as_py():
                texts = pc.replace_with_mask(texts, odd, pa.array([reader.form(t) for t in texts.filter(odd).to_pylist()], texts.type))
            words = pc.list_value_length(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts)))
            keep = pc.greater_equal(words, min_words)
            texts, b = texts.filter(keep), b.filter(keep)
            row, h = _runs(texts, run)
            n = np.bincount(row, minlength=len(b))
            start = np.concatenate(([0], np.cumsum(n)))
            box = _box(h)
            counts = np.bincount(row * BOXES + box, minlength=len(b) * BOXES).reshape(-1, BOXES)
            packed = [_pack(h[box == i]).tobytes() for i in range(BOXES)]
            at = np.concatenate((np.zeros((1, BOXES), np.int64), np.cumsum(counts, 0))) * HASH_BYTES
            bits = np.uint64(1) << (_mix(h + ODD) >> np.uint64(58))
            sketch = np.zeros(len(b) * BOXES, np.uint64)
            np.bitwise_or.at(sketch, row * BOXES + box, bits)
            sketch = sketch.reshape(-1, BOXES)
            block_ = b.column(1).to_numpy().view(np.uint64)
            mixed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(h * ODD + np.uint64(7)))))
            rid = _mix((mixed[start[1:]] - mixed[start[:-1]]) * ODD + n.astype(np.uint64) + _mix(block_)).view(np.int64)
            new = []
            for r in rid.tolist():
                new.append(r not in seen)
                seen.add(r)
            cols = [b.column(0), b.column(1), pa.array(rid), pa.array(n.astype(np.int32))]
            for x, ends in zip(packed, at.T.tolist(), strict=True):
                cols.append(pa.array([x[p:q] if given else None for given, p, q in zip(new, ends, ends[1:], strict=False)], pa.binary()))
            cols += [pa.array(counts[:, i].astype(np.int32)) for i in range(BOXES)] + [pa.array(sketch[:, i].copy().view(np.int64)) for i in range(BOXES)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "block", "rid", "n", *RUNS, *SIG]).filter(pc.greater(cols[3], 0))

    return stored(some.mapInArrow(go, RECORD))


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all runs in a column of packed runs."""
    n = np.array([len(x) // HASH_BYTES for x in col.to_pylist()], np.int64)
    return np.repeat(np.arange(len(n)), n), unpack(b"".join(col.to_pylist()))


def _bucket(h: np.ndarray, size: int) -> np.ndarray:
    return (_mix(h + np.uint64(3)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def frequencies(rec: DataFrame, size: int, total: int) -> np.ndarray:
    """Counts of all ``total`` runs in ``size`` buckets (a power of two), as bytes on a logarithmic scale. Few enough tasks that their tables are small beside the runs."""
    slices = 64
    tasks = min(4096, max(rec.sparkSession.sparkContext.defaultParallelism, total * HASH_BYTES // (16 * size)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = np.zeros(size, "<u4")
        for b in batches:
            for runs in b.columns:
                np.add.at(each, _bucket(_flat(runs)[1], size), 1)
        part = each.reshape(slices, -1)
        yield pa.RecordBatch.from_pydict({"part": np.arange(slices, dtype=np.int32), "n": pa.array([p.tobytes() for p in part], pa.binary())})

    def add(pdf):
        import pandas as pd

        n = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in pdf["n"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "n": [np.minimum(np.log2(n + 1) * 6, 255).astype(np.uint8).tobytes()]})

    got = rec.select(*RUNS).where("r0 is not null").coalesce(tasks).mapInArrow(count, "part int, n binary").groupBy("part").applyInPandas(add, "part int, n binary").collect()
    out = np.zeros((slices, size // slices), np.uint8)
    for part, n in got:
        out[part] = np.frombuffer(n, np.uint8)
    return out.ravel()


#: A key is 46 bits of hash below the segment's number; the rest describes the class in that segment, sizes cut off at their type's limit.
ENTRY = np.dtype([("key", "V6"), ("rid", "<i8"), ("sketch", "<u8"), ("n", "<u2"), ("c", "u1")])
KEY_BITS = 48
WIDE = np.dtype([("key", "<u8"), *[(k, t) for k, (t, _) in list(ENTRY.fields.items())[1:]]])


def _wide(b: bytes) -> np.ndarray:
    e = np.frombuffer(b, ENTRY)
    out = np.zeros(len(e), WIDE)
    for k in ENTRY.names[1:]:
        out[k] = e[k]
    key = np.zeros((len(e), 8), np.uint8)
    key[:, :6] = np.frombuffer(b, np.uint8).reshape(len(e), ENTRY.itemsize)[:, :6]
    out["key"] = key.view("<u8").ravel()
    return out


def _shared(c: np.ndarray, t: float) -> np.ndarray:
    """Runs that a segment of ``c`` runs must share, within the prefixes, with one that reaches t: one more for every STEP runs."""
    return np.minimum(1 + c // STEP, np.ceil(c * t - 1e-9).astype(np.int64))


def _entries(rec: DataFrame, given: Broadcast, t: float, parts: int, box: int) -> DataFrame:
    """(part, packed entries): the filter prefix of the segment ``box``, dealt by hash. The segment is in the key's two highest bits.

    Entries of runs in buckets of more than COMMON go to negative parts, by record, so that no key's entries overwhelm a task.
    """
    warm = int(math.log2(COMMON + 1) * 6)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = given.value
        for b in batches:
            row, h = _flat(b.column(2))
            if not len(row):
                continue
            f = freq[_bucket(h, len(freq))].astype(np.uint64)
            o = np.lexsort(((f << np.uint64(40)) | h, row))
            row, h, f = row[o], h[o], f[o]
            c = np.bincount(row, minlength=len(b))
            first = np.concatenate(([0], np.cumsum(c)))[:-1]
            most = c - np.ceil(c * t - 1e-9).astype(np.int64) + _shared(c, t)
            take = np.arange(len(row)) - first[row] < most[row]
            row, h, f = row[take], h[take], f[take]
            block = b.column(0).to_numpy().view(np.uint64)[row]
            key = _mix(h * ODD + _mix(block)) >> np.uint64(66 - KEY_BITS) | np.uint64(box << (KEY_BITS - 2))
            e = np.empty(len(row), ENTRY)
            e["key"], e["rid"], e["sketch"] = np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel(), b.column(1).to_numpy()[row], b.column(4).to_numpy().view(np.uint64)[row]
            e["n"], e["c"] = np.minimum(b.column(3).to_numpy()[row], 65535), np.minimum(c[row], 255)
            by_record = -1 - (_mix(e["rid"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            to = np.where(f > warm, by_record, (_mix(key) % np.uint64(parts)).astype(np.int64))
            o = np.argsort(to, kind="stable")
            e, to = e[o], to[o]
            some, cut = np.unique(to, return_index=True)
            cut = np.append(cut, len(to))
            yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "e": pa.array([e[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())})

    return rec.where("r0 is not null").select("block", "rid", f"r{box}", "n", f"m{box}").mapInArrow(go, "part int, e binary")


def _begins(x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """Whether a chain may begin in the segment that the entries share, and the sizes allow the similarity at all."""
    n, m = x["n"].astype(np.int64), y["n"].astype(np.int64)
    c, e = x["c"].astype(np.int64), y["c"].astype(np.int64)
    size = (np.minimum(n, m) >= np.maximum(n, m) * t - 1e-9) | (np.maximum(n, m) == 65535)
    apart = np.bitwise_count(x["sketch"] ^ y["sketch"])
    return size & ((apart <= (1 - t) / (1 + t) * (c + e) + 1e-9) | (np.maximum(c, e) == 255))


PAIRED = "a long, b long, need int, n int, c int, sketch long"


def _paired(batches: Iterator[pa.RecordBatch], t: float, most: int) -> Iterator[pa.RecordBatch]:
    """Pairs of classes that share an entry's key and may begin a chain there, as (a < b, the number of keys that they must share). Entries of runs of more than ``most`` records go out singly, as (key, class, -1) with their sizes and sketch."""
    blobs: dict[int, list[bytes]] = {}
    for b in batches:
        for p, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            blobs.setdefault(p, []).append(e)
    for p in list(blobs):
        e = _wide(b"".join(blobs.pop(p)))
        e = e[np.lexsort((e["rid"], e["key"]))]
        new = np.ones(len(e), bool)
        new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["rid"][1:] != e["rid"][:-1])
        e = e[new]
        edge = np.flatnonzero(np.concatenate(([True], e["key"][1:] != e["key"][:-1]))) if len(e) else np.zeros(0, np.int64)
        size = np.repeat(np.diff(np.append(edge, len(e))), np.diff(np.append(edge, len(e))))
        hot = (size > most) | (p < 0)
        if hot.any():
            x = e[hot]
            yield pa.RecordBatch.from_pydict({"a": x["key"].view(np.int64), "b": x["rid"], "need": np.full(len(x), -1, np.int32), "n": x["n"].astype(np.int32), "c": x["c"].astype(np.int32), "sketch": x["sketch"].view(np.int64)})
        e = e[~hot & (size > 1)]
        key, rid = e["key"], e["rid"]
        d = 1
        left = np.arange(len(key))
        while len(left):
            left = left[left + d < len(key)]
            left = left[key[left] == key[left + d]]
            for s in range(0, len(left), 1 << 18):
                i = left[s : s + (1 << 18)]
                i = i[_begins(e[i], e[i + d], t)]
                none = pa.nulls(len(i), pa.int32())
                need = _shared(np.minimum(e["c"][i], e["c"][i + d]).astype(np.int64), t).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"a": rid[i], "b": rid[i + d], "need": need, "n": none, "c": none, "sketch": pa.nulls(len(i), pa.int64())})
            d += 1


def _hot_pairs(hot: DataFrame, t: float) -> DataFrame:
    """(a < b, needed keys) of the hot runs' records (key, rid, n, c, sketch) that may begin a chain: blocks of about HOT records, each met by each."""
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("blocks"), F.count("*").alias("size")).where("size > 1").drop("size")
    rows = hot.join(blocks, "key").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    side = lambda s, i, j: rows.select("key", F.explode(F.sequence(i, j)).alias("other"), "part", *[F.col(c).alias(f"{s}{c}") for c in ("rid", "n", "c", "sketch")])
    x = side("x", F.col("part"), F.col("blocks") - 1).select("key", F.col("part").alias("i"), F.col("other").alias("j"), "xrid", "xn", "xc", "xsketch")
    y = side("y", F.lit(0), F.col("part")).select("key", F.col("other").alias("i"), F.col("part").alias("j"), "yrid", "yn", "yc", "ysketch")
    size = (F.least("xn", "yn") >= F.greatest("xn", "yn") * F.lit(t) - 1e-9) | (F.greatest("xn", "yn") == 65535)
    apart = F.bit_count(F.col("xsketch").bitwiseXOR(F.col("ysketch")))
    begins = (apart <= F.lit((1 - t) / (1 + t)) * (F.col("xc") + F.col("yc")) + 1e-9) | (F.greatest("xc", "yc") == 255)
    c = F.least("xc", "yc")
    need = F.least(1 + F.floor(c / STEP), F.ceil(c * F.lit(t) - 1e-9)).cast("int")
    same = [x[k] == y[k] for k in ("key", "i", "j")]
    met = x.join(y, same[0] & same[1] & same[2] & ((x["i"] < x["j"]) | (x["xrid"] < y["yrid"])) & size & begins)
    return met.select(F.least("xrid", "yrid").alias("a"), F.greatest("xrid", "yrid").alias("b"), need.alias("need"))


def _total(rec: DataFrame) -> int:
    return rec.where("r0 is not null").agg(F.sum("n")).first()[0] or 0


def _candidates(rec: DataFrame, t: float) -> DataFrame:
    """Distinct pairs (a < b) of classes, with the segments in which they may begin a chain as bits of ``boxes``.

    One segment at a time: its entries are deleted before those of the next are dealt, and only pairs that share enough of them are kept.
    """
    spark = rec.sparkSession
    total = _total(rec)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BOXES / 1_000_000))
    hot = HOT
    size = 1 << min(23, max(20, int(total).bit_length() - 8))
    order = spark.sparkContext.broadcast(frequencies(rec, size, total))
    found = []
    for box in range(BOXES):
        met = stored(_entries(rec, order, t, parts, box).repartition(parts, "part").mapInArrow(lambda it: _paired(it, t, hot), PAIRED), free=True)
        more = _hot_pairs(met.where("need < 0").select(F.col("a").alias("key"), F.col("b").alias("rid"), "n", "c", "sketch"), t)
        pairs = met.where("need >= 0").select("a", "b", "need").unionByName(more).groupBy("a", "b").agg(F.count("*").alias("keys"), F.max("need").alias("need"))
        found.append(stored(pairs.where("keys >= need").select("a", "b", F.lit(1 << box).alias("boxes")), free=True))
        release(met)
    order.destroy()
    return reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.bit_or("boxes").alias("boxes"))


def _chain(t: float) -> Column:
    """Whether, by the sketches, a chain may begin in one of the pair's segments and go round the ring within its budgets."""
    share = (1 - t) / (1 + t)
    over = [F.bit_count(F.col(f"a_m{i}").bitwiseXOR(F.col(f"b_m{i}"))) - share * (F.col(f"a_c{i}") + F.col(f"b_c{i}")) for i in range(BOXES)]
    ways = F.lit(False)
    for s in range(BOXES):
        way, run = F.col("boxes").bitwiseAND(F.lit(1 << s)) != 0, F.lit(0.0)
        for k in range(BOXES):
            run = run + over[(s + k) % BOXES]
            way = way & (run <= 1e-6)
        ways = ways | way
    return ways


def similar_classes(rec: DataFrame, t: float = T) -> DataFrame:
    """Pairs (a < b) of classes of similarity ``sim`` >= t, exactly checked.

    The check moves both sets of every pair. It is done in slices of the pairs that move at most half as many runs as all records have.
    """
    some = rec.where("r0 is not null")
    sig = some.select("rid", "n", *SIG).dropDuplicates(["rid"])
    side = lambda x: sig.select(*[F.col(c).alias(f"{x}_{c}" if c != "rid" else x) for c in sig.columns])
    pairs = _candidates(rec, t).join(side("a"), "a").where("true").join(side("b"), "b")
    pairs = pairs.where((F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * F.lit(t) - 1e-9) & _chain(t))
    pairs = stored(pairs.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("moved")), free=True)
    few = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    if few.count() <= 1_000_000:  # 8 MB of identifiers at most
        few = F.broadcast(few)
    runs = stored(some.select("rid", F.concat(*RUNS).alias("runs")).join(few, "rid", "left_semi").dropDuplicates(["rid"]), free=True)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = unpack(x), unpack(y)
                both_ = len(np.intersect1d(p, q, assume_unique=True))
                sim.append(both_ / (len(p) + len(q) - both_))
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim, pa.float64())], names=["a", "b", "sim"])
            yield out.filter(pc.greater_equal(out.column(2), t - 1e-12))

    slices = max(1, math.ceil(SLICES * (pairs.agg(F.sum("moved")).first()[0] or 0) / max(1, _total(rec))))
    found = []
    for k in range(slices):
        ends = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == k).select("a", "b", F.explode(F.array("a", "b")).alias("rid"))
        both = ends.join(runs, "rid").groupBy("a", "b").agg(F.min(F.when(F.col("rid") == F.col("a"), F.col("runs"))).alias("x"), F.min(F.when(F.col("rid") == F.col("b"), F.col("runs"))).alias("y"))
        found.append(stored(both.mapInArrow(check, "a long, b long, sim double"), free=True))
    release(pairs)
    release(runs)
    return reduce(DataFrame.unionByName, found)


def pairs_of(rec: DataFrame, links: DataFrame) -> DataFrame:
    """(key_a < key_b) of all records, copies among themselves included. Classes of many copies are split into blocks of about COPIES, which meet in separate tasks."""
    m = rec.select("key", "rid").distinct()
    copies = m.groupBy("rid").agg(F.count("*").alias("copies"))
    big = copies.where(F.col("copies") > COPIES).select("rid", F.ceil(F.col("copies") / COPIES).cast("int").alias("blocks"))
    m = m.join(big, "rid", "left").select("key", "rid", F.coalesce("blocks", F.lit(1)).alias("blocks")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    at = lambda side: big.select(F.col("rid").alias(side), F.col("blocks").alias(f"n_{side}"))
    each = lambda side: F.explode(F.sequence(F.lit(0), F.coalesce(f"n_{side}", F.lit(1)) - 1)).alias(f"part_{side}")
    met = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select("a", "b", "n_b", each("a")).select("a", "b", "part_a", each("b"))
    side = lambda s, k: m.select(F.col("rid").alias(s), F.col("part").alias(f"part_{s}"), F.col("key").alias(k))
    cross = met.join(side("a", "x"), ["a", "part_a"]).join(side("b", "y"), ["b", "part_b"])
    # classes without copies, most of them, take no part in the join of copies
    twice = m.join(copies.where("copies > 1").select("rid"), "rid", "left_semi")
    x = twice.select("rid", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("blocks") - 1)).alias("j"), F.col("key").alias("x"))
    y = twice.select("rid", F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"), F.col("key").alias("y"))
    same = x.join(y, ["rid", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    both = cross.select("x", "y").unionByName(same.select("x", "y"))
    return both.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).where("key_a < key_b").distinct()


def groups(rec: DataFrame, links: DataFrame) -> DataFrame:
    """(key, group_id) of every record with a partner, be it similar or a copy."""
    m = rec.select("key", "rid").distinct()
    copies = m.groupBy("rid").agg(F.count("*").alias("copies"))
    return m.join(copies, "rid").join(components(links).withColumnRenamed("node", "rid"), "rid", "left").where("copies > 1 or root is not null").select("key", F.coalesce("root", "rid").alias("group_id"))


# The orders of preference, best first.
AUTHORITY = ["official_gazette", "official_translation", "unofficial_translation", "reputable_secondary", "advocacy_report"]
LEGAL = ["ratified", "pending_ratification", "unverified", "superseded"]
TRANSLATION = [["original_bangla", "original_english"], ["official_english"], ["unofficial"]]


def _plain(c: str) -> Column:
    return F.regexp_replace(F.trim(F.lower(F.col(c))), r"[\s_\-]+", "_")


def _place(c: str, order: list) -> Column:
    got = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        got = F.when(_plain(c).isin(v if isinstance(v, list) else [v]), i).otherwise(got)
    return got


def _rank(key: str, text: str) -> list[Column]:
    """The order in which a group's records survive: trust, then completeness of the text, then the key."""
    return [_place("authority_rank", AUTHORITY), _place("legal_status", LEGAL), _place("translation_status", TRANSLATION), -F.coalesce(F.length(text), F.lit(0)), F.col(key)]


def survivors(df: DataFrame, key: str, text: str, member: DataFrame) -> DataFrame:
    """(group_id, key) of the best record of each group.

    By authority, legal status, translation, longer text, smaller key; unknown spellings and nulls come last. Each task keeps one
    record per group before the shuffle (a limit of the window's groups), so a hot group is no burden. Repeated rows count once.
    """
    some = df.select(*dict.fromkeys([key, text, "authority_rank", "legal_status", "translation_status"]))
    rank = {f"r{i}": c for i, c in enumerate(_rank(key, text))}
    j = some.select(key, *[c.alias(n) for n, c in rank.items()]).join(member.withColumnRenamed("key", key), key)
    w = Window.partitionBy("group_id").orderBy(*rank)
    return j.withColumn("n", F.row_number().over(w)).where("n = 1").select("group_id", key)


def merged(df: DataFrame, key: str, text: str, member: DataFrame) -> DataFrame:
    """``survivors`` with the best known value of each field of their groups, and the number of members.

    Ranked fields have their best value; dates the most precise, then the most trusted, then the latest; others that of the first record that
    knows one. Values are folded by ``min`` of structs, combined on the map side.
    """
    more = [c for c in ("source_act", "section_number", "section_title", "source_type") if c in df.columns]
    dates = [c for c in ("effective_date",) if c in df.columns]
    some = df.select(*dict.fromkeys([key, text, "authority_rank", "legal_status", "translation_status", *more, *dates]))
    j = some.join(member.withColumnRenamed("key", key), key)
    rank = F.struct(*_rank(key, text))
    best = lambda c, order: F.min(F.struct(_place(c, order).alias("p"), rank.alias("r"), _plain(c).alias("v")))["v"].alias(c)
    known = lambda c: F.min(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct(rank.alias("r"), F.col(c).alias("v"))))["v"].alias(c)
    date = lambda c: F.max(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.length(c).alias("n"), (-_place("authority_rank", AUTHORITY)).alias("p"), F.col(c).alias("v"))))["v"].alias(c)
    values = j.groupBy("group_id").agg(F.countDistinct(key).alias("n_members"), best("authority_rank", AUTHORITY), best("legal_status", LEGAL), best("translation_status", TRANSLATION), *[known(c) for c in more], *[date(c) for c in dates])
    return survivors(df, key, text, member).join(values, "group_id")
