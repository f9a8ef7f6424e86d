"""One consistent form for text that looks the same but differs in its characters.

First compatibility forms (full width, ligatures, radicals, presentation forms), unusual spaces, ignorable characters and
sequences that have a composed form are replaced. Then every word of Latin, Cyrillic or Greek letters that mixes these scripts, or holds
a Cyrillic or Greek letter with a look-alike, becomes a lattice of its possible readings in all three scripts, and Viterbi
picks the reading of highest score under the character bigrams of each script; changing the script within a word, and replacing
a letter, cost extra, so that a word really written in its script stays, and one with a foreign letter gets its own script's. The
bigrams of each script are counted over all texts beforehand, within words of one script; the counts (a table of fixed size) are
all that reaches the driver. Joiners are kept where they change how a word is drawn.

Nulls give no row in ``changed``; an empty text is its own form. Texts are processed whole.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata as U
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.llm import mojibake
from chunkwell.llm.common import arrow_map

# Letters that look alike, in the order of the alphabets.
CYRILLIC = "асеорхуіјѕһԁԛԝАВСЕНІЈКМОРЅТХУ"
CYRILLIC_AS = "aceopxyijshdqwABCEHIJKMOPSTXY"
GREEK = "αικνορυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_AS = "aikvopuxABEZHIKMNOPTYX"
OTHER = "ıɑɡⅼ"
OTHER_AS = "iagl"
#: Compatibility characters that are typography, not look-alikes: dots, ellipsis, primes, spacing accents.
TYPOGRAPHIC = set("․‥…‼⁇⁈⁉″‴⁗¨¯´¸˘˙˚˛˜˝")
IGNORABLE = "­͏؜᠎​‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
HYPHENS = "‐‑"
JOINERS = re.compile(
    "(?<=র)‍(?=্)|(?<=[্्])[‌‍](?=[ঀ-৿ऀ-ॿ]|$|[^\\w])|(?<=[ؠ-ۓ])[‌‍](?=[ؠ-ۓ])|(?<=[☀-➿\U0001f300-\U0001faff️])‍(?=[☀-➿\U0001f300-\U0001faff])|[‌‍]"
)
SEQUENCES = {"অা": "আ", "৷": "।"}
SWITCH, REPLACE, UNKNOWN = -9.0, -1.5, -3.5


@lru_cache(maxsize=1)
def _rules() -> dict:
    """Derived from the Unicode character database: single-character replacements, and what can't stand in composed text."""
    single, inert, seconds, firsts = {}, [], set(), set()
    for o in range(0x80, sys.maxunicode + 1):
        c = chr(o)
        if c in "‌‍":
            continue
        if U.category(c) == "Zs" or c in "\u2028\u2029":
            single[o] = " "
            continue
        dec = U.decomposition(c)
        if not dec:
            continue
        if dec[0] == "<":
            tag, rest = dec[1:].split("> ", 1)
            if tag in ("wide", "narrow", "font", "initial", "medial", "final", "isolated") or tag == "compat" and c not in TYPOGRAPHIC and not rest.startswith("0020") and (U.category(c)[0] in "LNP" or 0x2E80 <= o <= 0x2FDF):
                single[o] = U.normalize("NFKC", c)
        else:
            parts = [int(x, 16) for x in dec.split()]
            if U.normalize("NFC", c) != c:
                inert.append(o)
            elif len(parts) == 2:
                seconds.add(parts[1])
                firsts.add(parts[0])
    for c in IGNORABLE:
        single[ord(c)] = ""
    for c in HYPHENS:
        single[ord(c)] = "-"
    vowels = {0x9BE, 0x9D7}
    return {"single": single, "inert": inert, "seconds": sorted(seconds - vowels)}


def _ranges(points: list[int]) -> str:
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\x{{{points[i]:x}}}" + (f"-\\x{{{points[j]:x}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


@lru_cache(maxsize=1)
def gate_pattern() -> str:
    """An RE2 pattern that every text with a case matches."""
    r = _rules()
    letters = [*range(0x370, 0x400), *range(0x400, 0x530), *map(ord, OTHER)]
    points = sorted({*r["single"], *r["inert"], *r["seconds"], *letters, 0x200C, 0x200D, 0x9F7})
    return f"[{_ranges(points)}]|ে[াৗ]|অা"


_PAIRS = [(x, y) for a, b in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS)) for x, y in zip(a, b, strict=True)]
_ALIKE: dict[str, tuple[str, ...]] = {}
for _x, _y in zip(OTHER, OTHER_AS, strict=True):
    _ALIKE[_x] = (_y,)
for _x, _y in _PAIRS:
    same = [z for p in _PAIRS if p[1] == _y for z in p]  # the Latin letter and all that look like it
    for _z in {_x, _y}:
        _ALIKE[_z] = tuple(dict.fromkeys([*_ALIKE.get(_z, ()), *(q for q in same if q != _z)]))
_SUSPECT = re.compile("[" + CYRILLIC + GREEK + OTHER + "]")
_FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f" + OTHER + "]")
_HAN_PUNCT = re.compile("((?<=[㐀-鿿」』])[！，：；？（）]|[！，：；？（）](?=[㐀-鿿「『]))")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

#: The letters that bigrams are counted of: Latin, Cyrillic (basic and the rest of its block) and Greek, in small letters; 0 is what stands between words.
ALPHABETS = {"LATIN": [chr(c) for c in range(0x61, 0x7B)], "CYRILLIC": [chr(c) for c in range(0x430, 0x460)], "GREEK": [chr(c) for c in range(0x3B1, 0x3CA)]}
LETTERS = {c: k for k, c in enumerate((c for a in ALPHABETS.values() for c in a), 1)}
SIZE, GONE = len(LETTERS) + 1, 255
_EDGES = np.cumsum([1, *map(len, ALPHABETS.values())])


@lru_cache(maxsize=4096)
def _script(c: str) -> str:
    if c.isascii():
        return "LATIN"
    return U.name(c, "?").split(" ")[0]


@lru_cache(maxsize=4096)
def _letter(c: str) -> int:
    """The number of a letter without its accents; 0 for all others."""
    return LETTERS.get(U.normalize("NFD", c.lower())[:1], 0) or LETTERS.get(c.lower(), 0)


@lru_cache(maxsize=1)
def _numbers() -> np.ndarray:
    """Letter number by code point, of all that UTF-8 writes in one or two bytes."""
    return np.array([_letter(chr(o)) if chr(o).isalpha() else 0 for o in range(0x800)], np.int16)


class Reader:
    """Normalises texts with given bigram log probabilities (SIZE x SIZE)."""

    def __init__(self, bigrams: np.ndarray):
        self.bigrams = bigrams.tolist()

    def _step(self, a: str, b: str) -> float:
        sa, sb = _script(a) if a else "", _script(b) if b else ""
        if sa and sb and sa != sb:
            return SWITCH
        i, j = _letter(a) if a else 0, _letter(b) if b else 0
        if a and not i or b and not j:
            return UNKNOWN
        return self.bigrams[i][j]

    def word(self, w: str, prior: dict[str, float]) -> str:
        """The best reading; where several score alike the one with fewest replacements, then the first in the order of the options."""
        lattice = [(c, *_ALIKE.get(c, ())) for c in w]
        best = {c: ((0.0 if c == w[0] else REPLACE) + self._step("", c) + prior.get(_script(c), -6.0), c) for c in lattice[0]}
        for k, options in enumerate(lattice[1:], 1):
            best = {c: max((s + self._step(p, c) + (0.0 if c == w[k] else REPLACE), path + c) for p, (s, path) in best.items()) for c in options}
        return max((s + self._step(c, ""), path) for c, (s, path) in best.items())[1]

    def _word(self, m: re.Match, prior: dict[str, float]) -> str:
        w = m.group()
        if not _FOREIGN.search(w) or not (_SUSPECT.search(w) or any(_script(c) != _script(w[0]) for c in w)):
            return w
        if all(c not in _ALIKE for c in w):
            return w
        return self.word(w, prior)

    def form(self, text: str) -> str:
        """The consistent form; equal to the text where nothing is a case."""
        if _HAN_PUNCT.search(text):  # full-width punctuation is the usual form beside Chinese characters
            parts = _HAN_PUNCT.split(text)
            text = "".join(x if k % 2 else x.translate(_rules()["single"]) for k, x in enumerate(parts))
        else:
            text = text.translate(_rules()["single"])
        if "‌" in text or "‍" in text:
            text = JOINERS.sub(_joiner, text)
        for a, b in SEQUENCES.items():
            text = text.replace(a, b)
        text = U.normalize("NFC", text)
        if _FOREIGN.search(text):
            sure: dict[str, int] = {}
            for c in text:
                if c.isalpha() and c not in _ALIKE:
                    sure[_script(c)] = sure.get(_script(c), 0) + 1
            total = sum(sure.values()) + 1
            prior = {s: math.log((n + 0.01) / total) for s, n in sure.items()}
            text = _WORD.sub(lambda m: self._word(m, prior), text)
        return text


def _joiner(m: re.Match) -> str:
    """Keeps a joiner that stands where it changes the drawing."""
    t, i = m.string, m.start()
    before, after = t[i - 1 : i], t[i + 1 : i + 2]
    if before == "র" and after == "্" and m.group() == "‍":
        return m.group()
    if before in ("্", "्") and (not after or "ঀ" <= after <= "৿" or "ऀ" <= after <= "ॿ" or not after.isalpha()):
        return m.group()
    if before and after and "ؠ" <= before <= "ۓ" and "ؠ" <= after <= "ۓ":
        return m.group()
    if m.group() == "‍" and before and after and ord(before) > 0x2600 and U.category(after) == "So":
        return m.group()
    return ""


@lru_cache(maxsize=1)
def _byte_letters() -> np.ndarray:
    """Letter number by byte; GONE for bytes that don't begin a character."""
    out = np.zeros(256, np.uint8)
    out[:128] = _numbers()[:128]
    out[0x80:0xC0] = GONE
    return out


def _count(texts: pa.Array) -> np.ndarray:
    """Bigrams of the letters within words of one script; what is no letter of a counted script parts words."""
    col = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())).cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[len(col)]]
    x = _byte_letters()[data]
    two = np.flatnonzero((data >= 0xC3) & (data < 0xE0))
    x[two] = _numbers()[(data[two].astype(np.int64) & 0x1F) << 6 | data[two + 1] & 0x3F]
    x = x[x != GONE]
    keep = x > 0
    keep[1:] |= x[:-1] > 0
    x = np.concatenate(([0], x[keep])).astype(np.int64)  # letters, and one separator after each word
    a, b = x[:-1], x[1:]
    side = np.searchsorted(_EDGES, np.arange(SIZE), side="right")
    crossing = np.flatnonzero((a > 0) & (b > 0) & (side[a] != side[b]))
    code = a * SIZE + b
    if len(crossing):  # a word that mixes scripts says nothing
        word = np.cumsum(a == 0)
        code = code[~np.isin(word, word[crossing])]
    return np.bincount(code, minlength=SIZE * SIZE)


def bigram_scores(n: np.ndarray) -> np.ndarray:
    """Log probabilities from counts (SIZE x SIZE): of a letter after another within a script, and after a word's edge; add-one smoothing."""
    out = np.full((SIZE, SIZE), SWITCH)
    for lo, hi in zip(_EDGES, _EDGES[1:], strict=False):
        own = np.r_[0, lo:hi]
        x = n[np.ix_(own, own)] + 1.0
        x[0, 0] = 0.0
        with np.errstate(divide="ignore"):
            p = np.log(x / x.sum(1, keepdims=True))
        p[0, 0] = 0.0
        out[np.ix_(own, own)] = p
    return out


def bigrams(df: DataFrame, text: str) -> np.ndarray:
    """Log probabilities of letters after one another in each script, counted over every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE * SIZE, np.int64)
        for b in batches:
            if len(b):
                total += _count(b.column(0))
        total[0] = 0
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": k.astype(np.int32), "n": total[k]})

    got = df.select(F.col(text).cast("string")).where(F.col(text).isNotNull()).mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(SIZE * SIZE)
    for k, v in got:
        n[k] = v
    return bigram_scores(n.reshape(SIZE, SIZE))


def _rows(cols: list[list], scores: np.ndarray, garbled: bool) -> Iterator[tuple]:
    reader = Reader(scores)
    wrong = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m.group(1), 16):04x}", mojibake.candidate_pattern()))
    for key, text in zip(*cols, strict=True):
        new = reader.form(text)
        if new != text and (garbled or not (wrong.search(text) and mojibake.restore(text)[1])):
            yield key, new


def changed(df: DataFrame, key: str, text: str, scores: np.ndarray | None = None, garbled: bool = False) -> DataFrame:
    """``key`` and ``form`` of each row whose text isn't in the one form; texts with garbled stretches only with ``garbled``."""
    kind = df.schema[key].dataType.simpleString()
    some = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    scores = bigrams(df, text) if scores is None else scores
    return arrow_map(some, _rows, f"key {kind}, form string", gate=(1, gate_pattern()), scores=scores, garbled=garbled).withColumnRenamed("key", key)
