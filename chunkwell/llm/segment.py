"""Oversized texts cut into overlapping pieces by lexical cohesion.

The size of a text is ``max(1, round_half_even(1.3 * words))`` with words separated by white space. A natural break is a
line feed before a list marker or heading, any other line feed, or a sentence end. At every break the words of
the blocks on both sides are compared; the similarity curve's valleys mark changes of topic. Within each
size window the break of greatest depth is taken, line and list breaks ahead of mere sentence ends of equal depth, and
the next piece begins ``overlap_share`` of the piece's words before its end. Only where a window holds no break
is the text cut between two words.

Null texts give no piece; a text within the limit, the empty one included, is one piece as it stands. Repeated rows give their
pieces once each. A text without white space counts as one word and is therefore never over the limit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwell.llm.common import arrow_map, spread

WORD = re.compile(r"\S+")
SENTENCE_END = re.compile(r"[.!?।॥۔؟。！？৷][\"”’»)\]」』]*$")
ABBREVIATION = re.compile(r"^[(“\"]?(?:[A-Za-z]|[A-Za-z]\.[A-Za-z]|No|Nos|Sch|Dr|Mr|Mrs|Govt|Ltd|para|viz|cf|ss|art|Art|vol|approx|Tk|M/s|etc|নং|ড|মো|মে|লি|ডা)\.$")
LIST_MARK = re.compile(r"^(?:\(?[0-9০-৯]{1,3}[.)।]|\([a-zA-Zঀ-৿ivxlc]{1,4}\)|[-•*–])")
BLOCK_WORDS = 40
MIN_FILL = 0.5
#: What a break is worth besides the depth of its valley: list or heading, line feed, sentence end.
BONUS = {"list": 0.35, "line": 0.2, "sentence": 0.1}


def size_of(text: Column) -> Column:
    """Estimated tokens of a text as the limits count them."""
    n = F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.bround(n * F.lit(13) / F.lit(10)).cast("int"))


def _words_within(limit: int) -> int:
    n = max(1, int(limit / 1.3) + 2)
    while n > 1 and round(n * 13 / 10) > limit:
        n -= 1
    return n


def _cosine(a: Counter, b: Counter) -> float:
    dot = sum(v * b[k] for k, v in a.items())
    return dot / ((sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5 or 1.0)


def _breaks(text: str, spans: list[tuple[int, int]], node: str) -> dict[int, str]:
    """Index of the word after each natural break -> kind. A node of parts marks prose, where list marks are ordinary lines."""
    prose = node.startswith("part")
    out = {}
    for i in range(1, len(spans)):
        gap, word = text[spans[i - 1][1] : spans[i][0]], text[spans[i][0] : spans[i][1]]
        before = text[spans[i - 1][0] : spans[i - 1][1]]
        ended = bool(SENTENCE_END.search(before)) and not ABBREVIATION.match(before)
        if "\n" in gap:
            mark = bool(LIST_MARK.match(word)) or "\n\n" in gap
            if mark and not prose or ended or before[-1] in ";:—":
                out[i] = "list" if mark else "line"
        elif ended:
            out[i] = "sentence"
    return out


def _depths(words: list[str], at: list[int]) -> dict[int, float]:
    """Depth of the similarity valley at each break."""
    sims = [_cosine(Counter(words[max(0, i - BLOCK_WORDS) : i]), Counter(words[i : i + BLOCK_WORDS])) for i in at]
    n = len(sims)
    left, right = sims[:], sims[:]
    for j in range(1, n):  # the peak that is climbed to without a descent on the way
        left[j] = max(sims[j], left[j - 1]) if sims[j - 1] >= sims[j] else sims[j]
    for j in range(n - 2, -1, -1):
        right[j] = max(sims[j], right[j + 1]) if sims[j + 1] >= sims[j] else sims[j]
    return {i: left[j] + right[j] - 2 * sims[j] for j, i in enumerate(at)}


def pieces(text: str, node: str | None, limit: int, overlap_share: float) -> list[tuple[int, int, int]]:
    """(start, end, words) of each piece, as positions in the text."""
    spans = [m.span() for m in WORD.finditer(text)]
    most = _words_within(limit)
    if len(spans) <= most:
        return [(0, len(text), len(spans))]
    kinds = _breaks(text, spans, node or "")
    words = [text[s:e].strip(".,;:!?()[]“”\"'।").casefold() for s, e in spans]
    depth = _depths(words, sorted(kinds))
    out, start = [], 0
    while True:
        rest = len(spans) - start
        if rest <= most:
            end = len(spans)
        else:
            lo = start + max(2, int(most * MIN_FILL))
            inside = [i for i in range(lo, start + most + 1) if i in kinds]
            end = max(inside, key=lambda i: (depth[i] + BONUS[kinds[i]], i)) if inside else start + most
        a = 0 if start == 0 else spans[start][0]
        b = len(text) if end == len(spans) else spans[end][0]
        out.append((a, b, end - start))
        if end == len(spans):
            return out
        start = end - min(end - start - 1, max(1, round(overlap_share * (end - start))))


def _rows(cols: list[list], limit: int, overlap_share: float) -> Iterator[tuple]:
    for key, text, node in zip(*cols, strict=True):
        for k, (a, b, n) in enumerate(pieces(text, node, limit, overlap_share), 1):
            yield key, k, a, max(1, round(n * 13 / 10)), text[a:b]


def split_oversized(df: DataFrame, key: str, text: str, node: str, limit: int, overlap_share: float, keep_small: bool = True) -> DataFrame:
    """One row per piece: ``key``, ``piece_no`` from 1, ``start_pos`` (0-based), ``piece_tokens``, ``piece``.

    Texts within the limit stay in the JVM; with ``keep_small`` they come back as one piece each.
    """
    kind = df.schema[key].dataType.simpleString()
    some = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(node).cast("string").alias("node")).where("text is not null")
    # a text has at most (length + 1) / 2 words, so short ones need no count
    large = some.where((F.length("text") >= 2 * _words_within(limit)) & (size_of(F.col("text")) > limit))
    cut = arrow_map(spread(large, "key"), _rows, f"key {kind}, piece_no int, start_pos int, piece_tokens int, piece string", limit=limit, overlap_share=overlap_share)
    if keep_small:
        small = some.where((F.length("text") < 2 * _words_within(limit)) | (size_of(F.col("text")) <= limit))
        cut = cut.unionByName(small.select("key", F.lit(1).alias("piece_no"), F.lit(0).alias("start_pos"), size_of(F.col("text")).alias("piece_tokens"), F.col("text").alias("piece")))
    return cut.withColumnRenamed("key", key)
