"""Sentences across languages and scripts by semi-Markov dynamic programming over whole spans.

Every full stop, danda, question mark and the like, with the closing marks after it, is a possible end. The best
division of the text into spans maximises the sum of the span scores: length, opening word, closing word and balanced
quotations are scored jointly. How often a word opens a sentence, how often a word with a full stop is followed by
a small letter or digit (an abbreviation), and how long sentences are, is counted over all texts in tables of fixed size (hashed words;
lengths in words, in Chinese and other texts by themselves). A span may reach over any number of possible ends.

Line breaks, colons, semicolons, list markers and decimals never end a sentence; the end of the text does. White space at the
end belongs to no sentence. Null, empty and blank texts have none. Texts are processed whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.llm.common import arrow_map

BUCKETS, ROWS, SLICES = 1 << 19, 2, 64
STRONG = "।॥৷۔؟。！？!?"
# Short forms that stand before a name and so never end a sentence.
TITLES = {"Dr", "Mr", "Mrs", "Ms", "Prof", "M/s", "Messrs", "St", "Adv", "Hon", "Md", "No", "Nos", "Sch", "Art", "Sec", "vide", "viz", "cf", "e.g", "i.e", "ড", "ডা", "মো", "মে", "নং", "মি", "এড"}
OPENING, CLOSING = "“\"‘«「『([", "”\"’»」』)]"
POSSIBLE = re.compile(rf"[.{STRONG}…]+[{re.escape(CLOSING)}]*")
TOKEN_BEFORE = re.compile(r"[\s(\[“\"‘«「『—]")
NEXT = re.compile(rf"(\s*)([{re.escape(OPENING)}]*)([^\s]*)")
MARK_ONLY = re.compile(r"^\W*(?:\(?[0-9০-৯]{1,3}[.)।]|\([a-zA-Zঀ-৿]{1,3}\)|[a-zA-Z]\.)?\W*$")
HAN = re.compile("[㐀-鿿]")
LENGTHS, LONG_WORD = 512, 60  # a longer word is no short form
BASE_RATE, PRIOR = 0.05, 2.0
LENGTH_WEIGHT, LENGTH_LEAST = 0.25, -2.0


def _word_key(w: str) -> str:
    w = w.strip("“”\"‘’«»「」『』()[]—–-,;:.।?!؟۔。、،")
    return w[:2] if HAN.match(w) else w


def _buckets(w: str) -> tuple[int, int]:
    """A word's place in each of the two rows; of these the less crowded one counts."""
    h = xxhash.xxh3_64_intdigest(_word_key(w))
    return h & (BUCKETS - 1), (h >> 32 & (BUCKETS - 1)) + BUCKETS


def statistics(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket over every text how often its words occur, how likely they open a sentence, how often they are short forms; and the scores of lengths.

    Words are hashed into two rows of BUCKETS, so the tables' size is fixed; tasks send only the buckets that they met.
    """
    size = ROWS * BUCKETS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lengths = np.zeros((4, size), np.int64), np.zeros(2 * LENGTHS, np.int64)
        for b in batches:
            t = pc.replace_substring_regex(b.column(0), r"([।৷。！？۔؟][”\"」』]?)", r"\1 ")
            words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(t))
            n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            enc = words.flatten().dictionary_encode()
            d = enc.dictionary
            at = enc.indices.to_numpy(zero_copy_only=False)
            if not len(at):
                continue
            np_ = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
            keys = np.array([_buckets(w) for w in d.to_pylist()], np.int64)
            ends = np_(pc.match_substring_regex(d, r"[।৷。！？۔؟.!?]$"))[at]
            dot = np_(pc.match_substring_regex(d, r"[^.]\.$"))[at]
            small = np_(pc.match_substring_regex(d, r"^[a-z0-9]"))[at]
            row = np.repeat(np.arange(len(n)), n)
            first = np.ones(len(at), bool)
            first[1:] = row[1:] != row[:-1]
            opener = first.copy()
            opener[1:] |= ends[:-1] & ~dot[:-1] | dot[:-1] & ~small[1:]
            begin = np.flatnonzero(opener)
            whole = np.diff(np.append(begin, len(at)))
            han = np_(pc.match_substring_regex(d, "[\\x{3400}-\\x{9fff}]"))[at[begin]]
            lengths += np.bincount(han * LENGTHS + np.minimum(whole, LENGTHS - 1), minlength=2 * LENGTHS)
            lower = np.zeros(len(at), bool)
            lower[:-1] = dot[:-1] & small[1:] & ~first[1:]
            for i, m in enumerate((np.ones(len(at), bool), opener, dot, lower)):
                each = np.bincount(at[m], minlength=len(d))
                for r in range(ROWS):
                    np.add.at(out[i], keys[:, r], each)
        step = size // SLICES
        met = np.flatnonzero(out[0])
        cut = np.searchsorted(met, np.arange(SLICES + 1) * step)
        parts = [met[cut[k] : cut[k + 1]] for k in range(SLICES)]
        keys_ = [p.astype("<i8").tobytes() for p in parts] + [b""]
        yield pa.RecordBatch.from_pydict({"part": np.arange(SLICES + 1, dtype=np.int32), "k": pa.array(keys_, pa.binary()), "n": pa.array([*(out[:, p].astype("<i8").tobytes() for p in parts), lengths.astype("<i8").tobytes()], pa.binary())})

    def add(pdf):
        import pandas as pd

        part, step = int(pdf["part"].iloc[0]), size // SLICES
        if part == SLICES:
            return pd.DataFrame({"part": [part], "n": [sum(np.frombuffer(n, "<i8") for n in pdf["n"]).tobytes()]})
        total = np.zeros((4, step), np.int64)
        for k, n in zip(pdf["k"], pdf["n"], strict=True):
            total[:, np.frombuffer(k, "<i8") - part * step] += np.frombuffer(n, "<i8").reshape(4, -1)
        return pd.DataFrame({"part": [part], "n": [total.astype("<i8").tobytes()]})

    got = df.select(F.col(text)).where(F.col(text).isNotNull()).coalesce(4096).mapInArrow(count, "part int, k binary, n binary").groupBy("part").applyInPandas(add, "part int, n binary").toLocalIterator()
    out, lengths = np.zeros((4, SLICES, size // SLICES), np.int64), np.zeros(2 * LENGTHS, np.int64)
    for part, n in got:
        if part == SLICES:
            lengths = np.frombuffer(n, "<i8")
        else:
            out[:, part] = np.frombuffer(n, "<i8").reshape(4, -1)
    out = out.reshape(4, size)
    opens = np.log((out[1] + PRIOR * BASE_RATE) / (out[0] + PRIOR) / BASE_RATE)
    return np.stack([out[0], opens, out[3] / (out[2] + 3.0)]).astype(np.float32), length_scores(lengths.reshape(2, LENGTHS))


def length_scores(n: np.ndarray) -> np.ndarray:
    """For each number of words the log probability of a sentence of that length against the likeliest, from counts (Chinese last); never below LENGTH_LEAST.

    Neighbouring lengths share their counts over a window that grows with the length.
    """
    out = np.zeros(n.shape)
    sums = np.concatenate((np.zeros((2, 1)), np.cumsum(n, 1)), 1)
    k = np.arange(LENGTHS)
    lo, hi = k - k // 8, np.minimum(k + k // 8 + 1, LENGTHS)
    p = (sums[:, hi] - sums[:, lo] + 0.5) / (hi - lo)
    p[:, 0] = p[:, 1]
    out = np.log(p) - np.log(p.max(1, keepdims=True))
    return np.maximum(LENGTH_WEIGHT * out, LENGTH_LEAST).astype(np.float32)


class Divider:
    def __init__(self, stats: tuple[np.ndarray, np.ndarray]):
        (self.total, self.opens, self.short), self.lengths = stats

    def _place(self, word: str) -> int:
        i, j = _buckets(word)
        return i if self.total[i] <= self.total[j] else j

    def _end_score(self, text: str, s: int, e: int, begin: int) -> float:
        """Closing and opening words at a possible end, text[s:e] being the marks and text[begin:s] the word before them."""
        marks = text[s:e]
        nxt = NEXT.match(text, e)
        gap, quote, word = nxt.groups()
        stop = marks.rstrip(CLOSING)
        quoted = len(stop) < len(marks) and any(c in "”\"’»」』" for c in marks[len(stop) :])
        c = word[:1]
        if c.islower():
            return -8.0
        prev = text[max(begin, s - LONG_WORD - 1) : s]
        if stop[-1] in STRONG:
            if quoted and not c.isupper():
                return 2.3 + float(self.opens[self._place(word)])
            return 6.0
        if stop[-1] == "…" or stop.endswith(".."):
            return 1.0
        if not prev or prev in TITLES or len(prev) == 1 and prev.isalpha():
            return -8.0
        last = prev[-1]
        if "ঀ" <= last <= "৿":
            return -8.0
        if c.isdigit() and not quoted:
            return -4.0
        if not gap and not quoted:
            if not quote and not c.isupper() or len(prev) < 3 and not last.isdigit():
                return -8.0
        short = float(self.short[self._place(prev)]) if not quoted and last.isalpha() and len(prev) <= LONG_WORD else 0.0
        if not c.isupper() and quoted:
            return 2.3 + float(self.opens[self._place(word)])
        return 5.0 - 8.0 * short

    def ends(self, text: str) -> list[int]:
        """1-based positions of the sentences' last characters."""
        stop = len(text.rstrip())
        if not stop:
            return []
        at, score = [0], [0.0]
        word, breaks = 0, TOKEN_BEFORE.finditer(text, 0, stop)
        ahead = next(breaks, None)
        for m in POSSIBLE.finditer(text, 0, stop):
            s, e = m.span()
            if e >= stop:
                break
            if m.group()[0] == "." and e - s == 1 and text[e] not in " \n\t\r" and not (text[e].isupper() or text[e] in OPENING or ord(text[e]) > 0x2FF):
                continue
            while ahead is not None and ahead.end() <= s:
                word, ahead = ahead.end(), next(breaks, None)
            sc = self._end_score(text, s, e, word)
            if sc > -7.0:
                at.append(e)
                score.append(sc)
        at.append(stop)
        score.append(0.0)
        if len(at) == 2:
            return [stop]
        pieces = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
        bal = np.cumsum([0, *(p.count("“") + p.count("「") + p.count("«") - p.count("”") - p.count("」") - p.count("»") for p in pieces)])
        words = np.cumsum([0, *(len(p.split()) for p in pieces)])
        lengths = self.lengths[int(2 * sum(len(HAN.findall(p)) for p in pieces) > stop)]
        best, back = np.full(len(at), -np.inf), np.zeros(len(at), np.int64)
        best[0] = 0.0
        for j in range(1, len(at)):
            n = words[j] - words[:j]
            v = best[:j] + (score[j] - 4.0 * np.abs(bal[j] - bal[:j])) + lengths[np.minimum(n, LENGTHS - 1)]
            for i in range(j - 1, -1, -1):
                if n[i] > 3:
                    break
                if MARK_ONLY.match(text[at[i] : at[j]]):
                    v[i] -= 10.0
            back[j] = np.argmax(v)
            best[j] = v[back[j]]
        back = back.tolist()
        out, j = [], len(at) - 1
        while j:
            out.append(at[j])
            j = back[j]
        return out[::-1]


def _rows(cols: list[list], stats) -> Iterator[tuple]:
    d = Divider(stats.value)
    for key, text in zip(*cols, strict=True):
        start = 0
        for k, end in enumerate(d.ends(text), 1):
            a = start + len(text[start:end]) - len(text[start:end].lstrip())
            yield key, k, a + 1, end, text[a:end]
            start = end


def sentences(df: DataFrame, key: str, text: str, stats: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``key``, ``sentence_no``, ``start_pos``, ``end_pos`` (1-based, as stored) and ``sentence``."""
    kind = df.schema[key].dataType.simpleString()
    some = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    return arrow_map(some, _rows, f"key {kind}, sentence_no int, start_pos int, end_pos int, sentence string", stats=df.sparkSession.sparkContext.broadcast(stats)).withColumnRenamed("key", key)
