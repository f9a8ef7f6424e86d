"""Held-out passages inside a corpus: an FM-index per training shard, searched backwards for the passages' phrases.

A word is what white space separates, in the one form of problem 7, without case, punctuation and symbols, digits in one script.
Every phrase of ``run`` consecutive words of a passage is searched. Before a shard is indexed, words in which no phrase
can begin or go on are cut out: where two neighbours never stand together in a passage, no phrase crosses, and
stretches shorter than a phrase hold none. The rest is indexed: suffix array, Burrows-Wheeler transform, wavelet matrix
with block ranks, and every ``SAMPLE``-th suffix position. All phrases are searched backwards at once; their
occurrences are located by stepping to sampled positions and merged to spans.

Passages are queries stated beforehand; they are taken in blocks of ``BLOCK`` against all documents. Null and empty texts, and passages
shorter than a phrase, match nothing. Copies are found each. Shards are flushed by size, whatever their number of documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwell.llm import lookalike

RUN, SAMPLE, SHARD, BLOCK = 12, 16, 1 << 20, 20_000
_DIGITS = {o: str(unicodedata.digit(chr(o))) for o in range(0x80, 0x1FBFA) if unicodedata.category(chr(o)) == "Nd"}


def plain_word(w: str) -> str:
    w = w.lower().translate(_DIGITS)
    return w if w.isalnum() else "".join(c for c in w if unicodedata.category(c)[0] not in "PS")


class WaveletMatrix:
    """Rank of any symbol before any position, for many queries at once."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.bits = len(seq), bits
        self.words, self.counts, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            b = (seq >> level) & 1
            packed = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            packed[: self.n] = b
            words = np.packbits(packed, bitorder="little").view("<u8")
            self.words.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))))
            self.zeros.append(int(self.n - b.sum()))
            seq = np.concatenate((seq[b == 0], seq[b == 1]))

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        w, r = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << r) - np.uint64(1)
        return self.counts[level][w] + np.bitwise_count(self.words[level][w] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[k] before position i[k]."""
        s = np.zeros(len(i), np.int64)
        for level in range(self.bits):
            bit = (c >> (self.bits - 1 - level)) & 1
            ri, rs = self._rank1(level, i), self._rank1(level, s)
            i = np.where(bit == 1, self.zeros[level] + ri, i - ri)
            s = np.where(bit == 1, self.zeros[level] + rs, s - rs)
        return i - s


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; the sequence ends with its only smallest symbol."""
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    n, k = len(seq), 1
    while True:
        nxt = np.zeros(n, np.int64)
        if k < n:
            nxt[:-k] = rank[k:] + 1
        pair = rank * (n + 2) + nxt
        order = np.argsort(pair, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(pair[order[1:]] != pair[order[:-1]])
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class FMIndex:
    def __init__(self, seq: np.ndarray, alphabet: int):
        """``seq``: symbols from 1; 0 is added at the end."""
        seq = np.append(seq, 0).astype(np.int64)
        sa = suffix_array(seq)
        self.bwt = seq[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=alphabet + 1))))
        self.tree = WaveletMatrix(self.bwt, max(1, int(alphabet).bit_length()))
        self.kept = sa % SAMPLE == 0
        self.at = np.where(self.kept, sa, -1)[self.kept]
        self.before = np.cumsum(self.kept) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [lo, hi) of suffixes that begin with each phrase (rows)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), len(self.bwt), np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            lo[alive] = self.first[c] + self.tree.rank(c, lo[alive])
            hi[alive] = self.first[c] + self.tree.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        dead = np.ones(len(phrases), bool)
        dead[alive] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by stepping back to sampled ones."""
        out, at, step, todo = np.zeros(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(todo):
            here = self.kept[at[todo]]
            done = todo[here]
            out[done] = self.at[self.before[at[done]]] + step
            todo = todo[~here]
            c = self.bwt[at[todo]]
            at[todo] = self.first[c] + self.tree.rank(c, at[todo])
            step += 1
        return out


class Phrases:
    """The passages' vocabulary, neighbours and distinct phrases, with the items each phrase belongs to."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int):
        self.run = run
        self.ids: dict[str, int] = {}
        seqs = [(k, [self.ids.setdefault(w, len(self.ids) + 1) for w in ws]) for k, ws in items if len(ws) >= run]
        owners: dict[tuple, set] = {}
        pairs = set()
        for k, s in seqs:
            pairs.update(zip(s, s[1:], strict=False))
            for i in range(len(s) - run + 1):
                owners.setdefault(tuple(s[i : i + run]), set()).add(k)
        self.size = len(self.ids)
        self.rows = np.array(list(owners), np.int64).reshape(-1, run)
        self.owners = [sorted(x) for x in owners.values()]
        self.pairs = np.sort(np.array([a * (self.size + 1) + b for a, b in pairs], np.int64))


def _stretches(ids: np.ndarray, row: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the stretches of word ids in which a phrase may lie."""
    if not len(ids) or not len(p.pairs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = ids[:-1] * (p.size + 1) + ids[1:]
    at = np.minimum(np.searchsorted(p.pairs, code), len(p.pairs) - 1)
    linked = (p.pairs[at] == code) & (row[:-1] == row[1:])
    start = np.flatnonzero(np.concatenate(([True], ~linked)))
    end = np.append(start[1:], len(ids))
    long = end - start >= p.run
    return start[long], end[long]


def _find(seq: list[np.ndarray], p: Phrases) -> Iterator[tuple[int, int]]:
    """(position in the shard, phrase) of all occurrences."""
    index = FMIndex(np.concatenate(seq), p.size + 1)
    lo, hi = index.search(p.rows)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    yield from zip(index.locate(rows).tolist(), which.tolist(), strict=True)


def _spans(seq: list[np.ndarray], where: list[tuple], p: Phrases) -> Iterator[tuple]:
    """(key, item, first word, last word): occurrences of one item in one document, merged where they touch."""
    first = np.cumsum([0] + [len(s) for s in seq])[:-1]
    hits: dict[tuple, list[int]] = {}
    for pos, ph in _find(seq, p):
        k = int(np.searchsorted(first, pos, "right")) - 1
        key, word = where[k]
        for item in p.owners[ph]:
            hits.setdefault((key, item), []).append(word + pos - int(first[k]))
    for (key, item), at in hits.items():
        at.sort()
        a = b = at[0]
        for x in at[1:]:
            if x > b + p.run:
                yield key, item, a, b + p.run - 1
                a = x
            b = x
        yield key, item, a, b + p.run - 1


_WORD = re.compile(r"\S+")


def words_of(text: str, reader: lookalike.Reader) -> list[str]:
    return [w for w in map(plain_word, reader.form(text).split()) if w]


def leaked(docs: DataFrame, key: str, text: str, passages: DataFrame, item: str, passage: str, run: int = RUN) -> DataFrame:
    """``key``, ``item`` and the first and last word (from 0, words without letter or digit left out) of each leaked span."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), passages.schema[item].dataType.simpleString()
    scores = lookalike.bigrams(docs, text)
    reader = lookalike.Reader(scores)
    gate = lookalike.gate_pattern()
    schema = f"key {kind}, item {item_kind}, first_word long, last_word long"
    sc = docs.sparkSession.sparkContext

    def job(block: list) -> DataFrame:
        given = sc.broadcast(Phrases(block, run))

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, reader, known = given.value, lookalike.Reader(scores), {}
            seq, where, size = [], [], 0

            def flush() -> Iterator[pa.RecordBatch]:
                rows = list(_spans(seq, where, p))
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(("key", "item", "first_word", "last_word"), map(list, zip(*rows, strict=True)), strict=True)))

            for b in (whole.slice(k, 5000) for whole in batches for k in range(0, len(whole), 5000)):
                texts = b.column(1)
                odd = pc.match_substring_regex(texts, gate)
                if pc.any(odd).as_py():
                    texts = pc.replace_with_mask(texts, odd, pa.array([reader.form(t) for t in texts.filter(odd).to_pylist()], texts.type))
                words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
                n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                enc = words.flatten().dictionary_encode()
                each = np.zeros(len(enc.dictionary), np.int64)
                for i, w in enumerate(enc.dictionary.to_pylist()):
                    v = known.get(w)
                    if v is None:
                        x = plain_word(w)
                        v = p.ids.get(x, 0) if x else -1
                        if len(known) < 1_000_000:
                            known[w] = v
                    each[i] = v
                if not len(each):
                    continue
                ids = each[enc.indices.to_numpy(zero_copy_only=False)]
                row = np.repeat(np.arange(len(n)), n)
                full = ids >= 0
                ids, row = ids[full], row[full]
                begin = np.searchsorted(row, np.arange(len(n)))
                for s, e in zip(*_stretches(ids, row, p), strict=True):
                    r = int(row[s])
                    seq.append(np.append(ids[s:e], p.size + 1))
                    where.append((b.column(0)[r].as_py(), int(s - begin[r])))
                    size += e - s + 1
                if size > SHARD:
                    yield from flush()
                    seq, where, size = [], [], 0
            if seq:
                yield from flush()

        return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null").mapInArrow(go, schema)

    # one block's words at a time are held by the driver
    stated = passages.select(item, passage).where(F.col(passage).isNotNull()).distinct().toLocalIterator()
    jobs = []
    while block := [(r[0], words_of(r[1], reader)) for r in islice(stated, BLOCK)]:
        jobs.append(job(block))
    return reduce(DataFrame.unionByName, jobs or [job([])]).withColumnRenamed("key", key).withColumnRenamed("item", item)


def removal_spans(spans: DataFrame, key: str, item: str) -> DataFrame:
    """``key``, first_word, last_word and n_items: the words of each document to be removed, spans of all items that overlap or touch merged. A group is one document's spans."""
    before = Window.partitionBy(key).orderBy("first_word", "last_word", item).rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("first_word") > F.max("last_word").over(before) + 1, F.lit(True))
    runs = spans.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(Window.partitionBy(key).orderBy("first_word", "last_word", item)))
    return runs.groupBy(key, "run").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.countDistinct(item).alias("n_items")).drop("run")
