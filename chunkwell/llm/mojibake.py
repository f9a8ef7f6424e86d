"""Text decoded with the wrong encoding: found and restored by a hidden Markov model over characters.

States are ``clean``, one state per encoding pair (UTF-8 bytes read in another encoding) and ``lost`` for
replacement characters. In the state of a pair only whole UTF-8 units can be emitted, i.e. characters whose bytes in
the wrong encoding form one UTF-8 sequence; a unit's emission score depends on the character it restores to and on its neighbours.
Where the wrong encoding has two bytes a character, units don't end where characters do: the pair's state carries the bytes of the
unit that is still open, so garbled text may begin and end anywhere, also between clean characters of the same script.
Viterbi labels the characters, each labelled span gets its state's inverse transform, and the result is labelled
again until nothing is garbled any more, since text can be garbled several times; every round makes it shorter. Characters that no garbled state can emit are clean on any path, so the
search runs only inside the stretches between them; a text without such a stretch is passed over by one
pattern match per batch, before it becomes a Python object.

Nulls and empty texts give no span. A repeated row gives its row again. A text is processed whole whatever its length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.llm.common import arrow_map

#: Encodings in which UTF-8 bytes may have been read, most likely first.
SINGLE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r", "iso8859_15")
DOUBLE = "gbk"
LOST = "lost"
LOST_CHAR = "�"
START, STAY, END = -5.0, -0.05, -1.0


def _single_map(enc: str) -> dict[str, int]:
    """Character -> byte; a byte without meaning is read as the control character of its number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(enc)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


@lru_cache(maxsize=65536)
def _double_bytes(c: str) -> bytes:
    """The two bytes that stand for a character in the double-byte encoding; none where it has none or one."""
    try:
        b = c.encode(DOUBLE)
    except UnicodeEncodeError:
        return b""
    return b if len(b) == 2 else b""


@lru_cache(maxsize=1)
def _tables() -> dict:
    maps = {e: _single_map(e) for e in SINGLE}
    units = {}
    for e, m in maps.items():
        cls = lambda lo, hi, m=m: "".join(re.escape(c) for c, b in m.items() if lo <= b <= hi)
        cont = f"[{cls(0x80, 0xBF)}{LOST_CHAR}]"
        real = f"[{cls(0x80, 0xBF)}]"
        lead3 = f"[{cls(0xE0, 0xEF)}]"
        units[e] = re.compile(f"[{cls(0xC2, 0xDF)}]{cont}|{lead3}{real}{cont}|{lead3}{cont}{real}|[{cls(0xF0, 0xF4)}]{real}{real}{real}")
    emit = set().union(*maps.values()) | {LOST_CHAR}
    emit |= {c for c in map(chr, range(0xA1, 0x10000)) if not 0x3400 <= ord(c) <= 0x9FFF and _double_bytes(c)}
    island = re.compile("[" + "".join(re.escape(c) for c in sorted(emit)) + "㐀-鿿豈-﫿-]{1,}")
    return {"maps": maps, "units": units, "island": island}


def candidate_pattern() -> str:
    """An RE2 pattern that every text with a garbled stretch matches: some unit of some pair, or a lost character."""
    alts = [LOST_CHAR, "[\\x{3400}-\\x{9fff}]"]
    for e in SINGLE:
        m = _single_map(e)
        cls = lambda lo, hi, m=m: "".join(f"\\x{{{ord(c):x}}}" for c, b in m.items() if lo <= b <= hi)
        cont = cls(0x80, 0xBF)
        alts += [f"[{cls(0xC2, 0xF4)}][{cont}]"]
    return "|".join(alts)


@lru_cache(maxsize=8192)
def _clean_score(c: str, left: str, right: str) -> float:
    """Log probability, up to a constant, of a clean character between the classes of its neighbours."""
    o = ord(c)
    k = _class(c)
    if k == "han":
        return -12.0 if {"latin", "ascii"} & {left, right} else -3.0 if _common_han(c) else -8.0
    if k == "latin":
        return -3.0 if "ascii" in (left, right) or o > 0x24F else -6.0 if "latin" not in (left, right) else -8.0
    if k in ("cyrillic", "greek"):
        return -7.0 if "ascii" in (left, right) else -3.5 if k in (left, right) else -5.0
    if k == "indic" or k == "arabic":
        return -3.0
    if k == "punct":
        return -3.0
    if k == "control":
        return -14.0
    if o == 0xA0:
        return -5.0
    return -8.0 if o < 0x100 else -9.0


@lru_cache(maxsize=65536)
def _common_han(c: str) -> bool:
    """Whether a character is of the first level of the simplified Chinese standard, that of common characters."""
    try:
        b = c.encode("gb2312")
    except UnicodeEncodeError:
        return False
    return 0xB0 <= b[0] <= 0xD7


@lru_cache(maxsize=65536)
def _class(c: str) -> str:
    if not c:
        return ""
    o = ord(c)
    if o < 0x80:
        return "ascii" if c.isalpha() else "other"
    if 0x80 <= o < 0xA0:
        return "control"
    if 0x3400 <= o <= 0x9FFF:
        return "han"
    if 0x980 <= o <= 0x9FF or 0x900 <= o <= 0x97F:
        return "indic"
    if 0x600 <= o <= 0x6FF:
        return "arabic"
    if 0x400 <= o <= 0x4FF:
        return "cyrillic"
    if 0x370 <= o <= 0x3FF:
        return "greek"
    if c in "–—‘’“”…•‚„":
        return "punct"
    if o < 0x250 and c.isalpha():
        return "latin"
    return "other"


@lru_cache(maxsize=65536)
def _restored_score(c: str) -> float:
    """Log probability, up to a constant, that garbled text stands for this character."""
    k, o = _class(c), ord(c)
    if k in ("indic", "arabic", "punct"):
        return -3.0
    if k == "han":
        return -3.5 if _common_han(c) else -7.0
    if 0x3000 <= o <= 0x30FF or 0xFF00 <= o <= 0xFFEF:
        return -3.5
    if c in "‌‍​₹£€²°§«»º ﻿©®½·":
        return -5.0
    if k == "latin":
        return -4.0 if o < 0x100 else -6.0
    if k in ("cyrillic", "greek"):
        return -9.0
    if k == "control":
        return -5.0 if o == 0x8D else -9.0
    return -14.0 if unicodedata.category(c) in ("Cn", "Co", "Cs", "Cc") else -11.0


def _unit_text(piece: str, m: dict[str, int]) -> str | None:
    """The one character that the piece stands for; the replacement character if a byte of it is lost."""
    if LOST_CHAR in piece:
        return LOST_CHAR
    try:
        return bytes(m[c] for c in piece).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _read(open_: bytes, more: bytes) -> tuple[str, bytes] | None:
    """(characters that are complete now, bytes of the one that is open) after more bytes of UTF-8; nothing if they can't go on so."""
    b = open_ + more
    try:
        return b.decode("utf-8"), b""
    except UnicodeDecodeError as x:
        if x.reason != "unexpected end of data":
            return None
        return b[: x.start].decode("utf-8"), b[x.start :]


def _double_steps(c: str, open_: bytes) -> tuple[str, bytes, float] | None:
    """(what is complete, bytes still open, score) when a character of the double-byte reading comes after open bytes."""
    if c == LOST_CHAR:  # the rest of an open unit is lost
        return (LOST_CHAR, b"", -4.0) if open_ else None
    got = _read(open_, _double_bytes(c)) if _double_bytes(c) else None
    if got is None:
        return None
    # an ASCII letter can be the second byte
    return got[0], got[1], sum(_restored_score(x) if ord(x) > 127 else -2.0 for x in got[0])


def _label(text: str) -> list[tuple[int, int, str, str]]:
    """The Viterbi path's garbled spans: (start, end, state, what it stands for)."""
    t = _tables()
    spans: list[tuple[int, int, str, str]] = []
    for isl in t["island"].finditer(text):
        s, e = isl.span()
        steps: dict[int, list[tuple[int, str, str, float]]] = {}
        for enc, pat in t["units"].items():
            m = t["maps"][enc]
            for u in pat.finditer(text, s, e):
                c = _unit_text(u.group(), m)
                if c is not None:
                    beside = _class(c) == "han" and "ascii" in (_class(text[u.start() - 1]) if u.start() else "", _class(text[u.end()]) if u.end() < len(text) else "")
                    steps.setdefault(u.start(), []).append((u.end(), enc, c, -4.0 if c == LOST_CHAR else _restored_score(c) - 6.0 * beside))
        for i in range(s, e):
            if text[i] == LOST_CHAR:
                steps.setdefault(i, []).append((i + 1, LOST, LOST_CHAR, -6.0))
        double = any("㐀" <= c <= "鿿" for c in text[s:e])
        if not steps and not double:
            continue
        # best[i]: state -> (score, previous position, previous state, what the step stands for); a state is a pair and the bytes that are open
        best: list[dict[tuple, tuple]] = [{} for _ in range(e - s + 1)]
        clean_ = ("clean", b"")
        best[0][clean_] = (0.0, -1, None, "")

        def reach(at: int, state: tuple, score: float, frm: int, before: tuple, out: str | None, best=best, s=s) -> None:
            old = best[at - s].get(state)
            if old is None or score > old[0]:
                best[at - s][state] = (score, frm, before, out)

        for i in range(s, e):
            here = best[i - s]
            # leaving a garbled state that has no byte open costs nothing but END
            for st, v in list(here.items()):
                if st != clean_ and not st[1]:
                    reach(i, clean_, v[0] + END, i, st, None)
            clean = here.get(clean_)
            if clean is not None:
                sc = clean[0] + _clean_score(text[i], _class(text[i - 1]) if i else "", _class(text[i + 1]) if i + 1 < len(text) else "")
                reach(i + 1, clean_, sc - 20.0 * (text[i] == LOST_CHAR), i, clean_, text[i])
            for end, enc, out, score in steps.get(i, ()):
                st = (enc, b"")
                stay, start = here[st][0] + STAY if st in here else -1e9, clean[0] + START if clean is not None else -1e9
                if max(stay, start) > -1e8:
                    reach(end, st, max(stay, start) + score, i, st if stay >= start else clean_, out)
            if double:
                ways = [(st, v[0] + STAY) for st, v in here.items() if st[0] == DOUBLE]
                if clean is not None:
                    ways.append((clean_, clean[0] + START))
                for st, score in ways:
                    got = _double_steps(text[i], st[1])
                    if got:
                        reach(i + 1, (DOUBLE, got[1]), score + got[2], i, st, got[0])
        last = {st: v for st, v in best[e - s].items() if not st[1]}
        if not last:
            continue
        state = max(last, key=lambda k: last[k][0] + (0 if k == clean_ else END))
        pos = e
        while state is not None:
            _, prev, before, out = best[pos - s][state]
            if prev < 0:
                break
            if state != clean_ and out is not None:
                spans.append((prev, pos, state[0], out))
            pos, state = prev, before
    spans.sort(key=lambda x: x[:2])
    return spans


def restore(text: str | None) -> tuple[str | None, int, bool]:
    """(text as it first read, number of garbled characters, whether all of it came back)."""
    if not text:
        return text, 0, True
    count = 0
    while True:
        spans = _label(text)
        if not spans:
            break
        at, parts = 0, []
        for s, e, _st, out in spans:
            parts += [text[at:s], out]
            at = e
            count += e - s
        new = "".join(parts) + text[at:]
        if new == text:
            break
        text = new
    return text, count, LOST_CHAR not in text if count else True


def _rows(cols: list[list]) -> Iterator[tuple]:
    for key, text in zip(*cols, strict=True):
        new, n, whole = restore(text)
        if n:
            yield key, new, n, whole


def garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of ``df`` with a garbled stretch: ``key``, ``restored`` text, ``n_garbled`` characters, ``whole`` (all restored).

    Null and empty texts never appear. A row that stands twice appears twice. Columns besides ``key`` and ``text`` don't matter.
    """
    kind = df.schema[key].dataType.simpleString()
    some = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    return arrow_map(some, _rows, f"key {kind}, restored string, n_garbled int, whole boolean", gate=(1, candidate_pattern())).withColumnRenamed("key", key)
