"""Texts that were cut off: right-censored length models per source, combined with the evidence of the ending.

Lengths. Per source and unit (characters, UTF-8 bytes, words) a log-normal length distribution is fitted by maximum likelihood, the texts at
a candidate limit counting as censored (known only to be at least so long). Every length with more texts than the fitted density and
the lengths around it explain is a candidate limit; the share of the excess is the posterior probability that a text of that size was censored.

Endings. What a text ends in is one of a fixed number of cells: closing mark, form of the last line, end of the line before, habit of the
last line's words. How cut texts end is learned from the texts themselves, each cut at a place that its key chooses; how
whole ones end, from those away from all limits, of which the largest share that cut texts may have among them is taken off. Both come from
a bounded sample of at most ``SAMPLE`` texts; all else counts every text. Marks of omission and replacement characters, which no such cut makes,
have the share that they have at the limits.

A text's odds are those of its limit (away from limits the source's rate of cuts, by expectation maximisation over its cells) times the
likelihood ratio of its ending. A text that ends with a sentence's closing mark doesn't stop inside a sentence: it is whole whatever its length.

Null and blank texts are never cut; null sources are one source; each copy of a text counts. Lengths are those of whole texts, a closing replacement
character or mark of omission left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwell.llm.common import stored

LINE_BUCKETS, SAMPLE, PRIOR_TEXTS = 1 << 18, 20_000, 20.0
UNITS = {"chars": 1, "bytes": 4, "words": 1}  # what a cut may fall short of the limit by, plus one
NEAR, BY_CHANCE = 50, 0.01  # windows on each side that a length is compared with; chance that any length is a candidate by accident
OMITTED = r"(?:…|\.\.\.|\[(?:…|\.\.\.)\]|\[(?:more|truncated|cont(?:inue)?d?)\.?\])"
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　"
# Short forms that don't end a sentence.
SHORT = "Dr|Mr|Mrs|Ms|Prof|M/s|No|Nos|Sch|Art|Sec|viz|cf|e\\.g|i\\.e|p|a|s|ss|r|i|e|para|Tk|Govt|Ltd|approx|vide"
END_MARKS = "।॥৷۔؟。！？!?"
CLOSE_MARKS = "”\"’»」』)\\]"
DONE = rf"[{END_MARKS}][{CLOSE_MARKS}]*$|\.[{CLOSE_MARKS}]*$|[”»」』][{CLOSE_MARKS}]*$"
MARKS, FORMS, BEFORE, HABITS = ("done", "lost", "omitted", "short", "none"), ("framed", "form", "brief", "long"), ("alone", "done", "open"), ("closing", "inside", "unknown")
CELLS = len(MARKS) * len(FORMS) * len(BEFORE) * len(HABITS)
MADE = (1, 2)  # marks that cutting adds


def _norm_cdf_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def fit_censored(length: np.ndarray, n: np.ndarray, limit: float) -> tuple[float, float]:
    """(mean, deviation) of log length by expectation maximisation; lengths at or above the limit are censored there."""
    x, c = np.log(np.maximum(length, 1)), math.log(max(limit, 1))
    seen = length < limit
    k, m = float(n[~seen].sum()), float(n[seen].sum())
    if m < 2:
        return float(np.average(x, weights=n)), 1.0
    s1, s2 = float((n * x)[seen].sum()), float((n * x * x)[seen].sum())
    mu, sd = s1 / m, max(1e-3, math.sqrt(max(0.0, s2 / m - (s1 / m) ** 2)))
    for _ in range(200):
        z = (c - mu) / sd
        tail = max(_norm_cdf_tail(z), 1e-300)
        lam = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
        e1, e2 = mu + sd * lam, mu * mu + sd * sd + sd * (c + mu) * lam  # moments above the limit
        new = (s1 + k * e1) / (m + k)
        var = (s2 + k * e2) / (m + k) - new * new
        done = abs(new - mu) < 1e-9
        mu, sd = new, math.sqrt(max(var, 1e-6))
        if done:
            break
    return mu, sd


def _limit(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidate limits of one source and unit, with the posterior at each.

    The largest length is one. So is each other length at which most texts are in excess of both the fitted density and the
    lengths around it, by more than chance gives any of the lengths tried (Chernoff's bound); of overlapping windows the fullest counts.
    Half a text is added to what is expected, so a single longest text is no more likely cut than not.
    """
    pdf = pdf.sort_values("length")
    x, n, unit = pdf["length"].to_numpy(), pdf["n"].to_numpy(), pdf["unit"].iloc[0]
    top, w, total = int(x.max()), UNITS[unit], float(n.sum())
    below = np.concatenate([[0], np.cumsum(n)])
    upto = lambda v: below[np.searchsorted(x, v, side="right")]

    def scored(lim: int, mu: float, sd: float, around: float) -> float:
        lo, hi = math.log(max(lim - w + 0.5, 0.5)), math.log(lim + 0.5)
        return max(around, total * max(0.0, _norm_cdf_tail((lo - mu) / sd) - _norm_cdf_tail((hi - mu) / sd))) + 0.5

    def row(lim: int, around: float) -> tuple:
        at = int(upto(lim) - upto(lim - w))
        mu, sd = fit_censored(x.astype(float), n, float(lim - w + 1))
        return pdf["src"].iloc[0], unit, lim, at, mu, sd, 1.0 - min(1.0, scored(lim, mu, sd, around) / at)

    out = [row(top, 0.0)]
    mu, sd = out[0][4:6]
    at = (upto(x) - upto(x - w)).astype(float)
    around = np.maximum(upto(x - w) - upto(x - w - NEAR * w), upto(x + NEAR * w) - upto(x)) / NEAR
    z = lambda v: (np.log(np.maximum(v, 0.5)) - mu) / sd
    tail = np.vectorize(_norm_cdf_tail)
    least = np.maximum(around, total * np.maximum(0.0, tail(z(x - w + 0.5)) - tail(z(x + 0.5)))) + 0.5
    odd = (at > 2 * least) & (at * np.log(np.maximum(at, 1e-9) / least) - (at - least) > math.log(len(x) / BY_CHANCE))
    taken = [top]
    for i in np.flatnonzero(odd)[np.lexsort((x[odd], -at[odd]))]:
        lim = int(x[i])
        if all(abs(lim - t) >= w for t in taken):
            out.append(row(lim, float(around[i])))
            taken.append(lim)
    return pd.DataFrame(out, columns=["src", "unit", "lim", "n_at", "mu", "sd", "p_cut"])


def _ending(text: Column) -> dict[str, Column]:
    """The last line and the end of the line before it, of a text without white space at its end."""
    last = F.substring_index(text, "\n", -1)
    rest = F.rtrim(F.left(text, F.length(text) - F.length(last)), F.lit(SPACE))
    return {"last": last, "before": F.right(F.substring_index(rest, "\n", -1), F.lit(8))}


def _line_keys(line: Column) -> list[Column]:
    """Buckets of a line's first two words, last two words and first word, digits left out."""
    plain = F.trim(F.translate(line, "0123456789০১২৩৪৫৬৭৮৯", ""))
    b = lambda s, x: F.pmod(F.xxhash64(F.lit(s), x), F.lit(LINE_BUCKETS)).cast("int")
    return [b("first", F.substring_index(plain, " ", 2)), b("last", F.substring_index(plain, " ", -2)), b("word", F.substring_index(plain, " ", 1))]


def line_habits(df: DataFrame, text: str) -> DataFrame:
    """(bucket, p_last, n_lines): how often a line with these first or last words is the last of its text. At most LINE_BUCKETS rows."""
    t = F.rtrim(F.col(text), F.lit(SPACE))
    lines = df.select(t.alias("t")).where("t <> ''").select(F.split("t", "\n").alias("lines")).select(F.size("lines").alias("k"), F.posexplode("lines").alias("i", "line"))
    each = lines.where("line <> ''").select(F.explode(F.array(*_line_keys(F.col("line")))).alias("bucket"), (F.col("i") == F.col("k") - 1).cast("int").alias("is_last"))
    return each.groupBy("bucket").agg(((F.sum("is_last") + 0.2) / (F.count("*") + 5.0)).alias("p_last"), F.count("*").alias("n_lines"))


def _mark(last: Column) -> Column:
    """Which of MARKS the text's end is."""
    short = last.rlike(rf"(?:^|[\s(“])(?:{SHORT})\.$|[ঀ-৿]\.$|[a-z]\.[a-z]\.$")
    return F.when(last.endswith("\ufffd"), 1).when(last.rlike(OMITTED + "$"), 2).when(short, 3).when(last.rlike(DONE), 0).otherwise(4)


def _form(last: Column) -> Column:
    """Which of FORMS the last line has: a framed note; a date, label, signature, list entry or caption; a short line; any other."""
    n = F.length(last)
    form = last.rlike(r"^\s*(?:[\p{L}][^\s:]{0,30}(?: [^\s:]{1,20}){0,2}: ?\S.*|\([a-zA-Zক-হ]{1,3}\) .*|[-–—•*].*)$") & (n <= 60)
    return F.when((n <= 200) & last.rlike(r"^\s*[-–—].*[-–—]\s*$"), 0).when(form, 1).when(n <= F.when(last.rlike(r"[\x{3400}-\x{9fff}]"), 12).otherwise(40), 2).otherwise(3)


def _cell(s: str) -> Column:
    """The number of the cell from the columns last, before and the three habits with suffix ``s``."""
    h = lambda k: F.coalesce(F.col(f"p{k}{s}"), F.lit(0.0))
    known = lambda k: (F.coalesce(F.col(f"n{k}{s}"), F.lit(0)) >= 10) & (h(k) < 0.3)
    last, before = F.col("last" + s), F.col("before" + s)
    habit = F.when((F.greatest(h(0), h(1)) > 0.5) & (F.length(last) <= 80), 0).when(known(0) | known(2), 1).otherwise(2)
    prior = F.when(before == "", 0).when(before.rlike(DONE), 1).otherwise(2)
    return ((_mark(last) * len(FORMS) + _form(last)) * len(BEFORE) + prior) * len(HABITS) + habit


def endings(df: DataFrame, key: str, source: str, text: str, sample: int = SAMPLE) -> DataFrame:
    """One stored narrow row per text that isn't blank: key, src, its sizes, its ``cell``, and for sampled texts the cell after a cut (``cut_cell``)."""
    t = F.rtrim(F.col(text), F.lit(SPACE))
    some = df.select(F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("")).alias("src"), t.alias("t")).where("t <> ''")
    share = min(1.0, sample / max(1, some.count()))
    h = F.xxhash64("key")
    some = some.withColumn("at", F.when((F.pmod(h, F.lit(1 << 20)) < math.ceil(share * (1 << 20))) & (F.length("t") > 1), 1 + F.pmod(F.shiftrightunsigned(h, 20), F.length("t") - 1)))
    some = some.withColumn("cut", F.when(F.col("at").isNotNull(), F.rtrim(F.left("t", F.col("at").cast("int")), F.lit(SPACE))))
    for s, c in (("", "t"), ("2", "cut")):
        for n, v in _ending(F.col(c)).items():
            some = some.withColumn(n + s, v)
    # the text before a closing replacement character or mark of omission, which a cut adds to what it leaves
    gone = F.length("last") - F.length(F.regexp_replace("last", rf"(?:\x{{FFFD}}+|\s*{OMITTED})$", ""))
    some = some.withColumn("whole", F.when(gone > 0, F.rtrim(F.left("t", F.length("t") - gone), F.lit(SPACE))).otherwise(F.col("t")))
    sizes = [F.length("whole").alias("chars"), F.octet_length("whole").alias("bytes"), F.size(F.split("whole", r"\s+")).alias("words")]
    some = some.select("key", "src", *sizes, "last", "before", "last2", "before2", *[b.alias(f"b{k}{s}") for s in ("", "2") for k, b in enumerate(_line_keys(F.col("last" + s)))])
    habit = line_habits(df, text)
    for s in ("", "2"):
        for k in range(3):
            some = some.join(F.broadcast(habit.select(F.col("bucket").alias(f"b{k}{s}"), F.col("p_last").alias(f"p{k}{s}"), F.col("n_lines").alias(f"n{k}{s}"))), f"b{k}{s}", "left")
    return stored(some.select("key", "src", *UNITS, _cell("").alias("cell"), F.when(F.coalesce("last2", F.lit("")) != "", _cell("2")).alias("cut_cell")))


def limits(ends: DataFrame) -> DataFrame:
    """(src, unit, lim, n_at, mu, sd, p_cut): the fitted model and the censoring posterior at the candidate limits of each source and unit, from ``endings``."""
    sizes = ends.select("src", F.explode(F.create_map(*[x for u in UNITS for x in (F.lit(u), F.col(u))])).alias("unit", "length"))
    return sizes.groupBy("src", "unit", "length").agg(F.count("*").alias("n")).groupBy("src", "unit").applyInPandas(_limit, "src string, unit string, lim long, n_at long, mu double, sd double, p_cut double")


def _expected() -> np.ndarray:
    """What each cell's log likelihood ratio is taken to be before any text is seen, as PRIOR_TEXTS texts: forms and habits of closing lines speak for a whole text."""
    mark, form, before, habit = np.unravel_index(np.arange(CELLS), (len(MARKS), len(FORMS), len(BEFORE), len(HABITS)))
    closing = (before == 1) & ((form < 2) | (habit == 0)) | (form == 0)
    return np.select([mark == 3, closing, (form == 2) & (before == 1) & (habit == 2), before == 0], [3.0, -3.0, -1.5, 2.0], 3.0)


def ending_ratio(whole: np.ndarray, cut: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, float]:
    """(log likelihood ratio of each cell, rate of cuts away from limits) from the cells of texts away from limits, of texts cut on purpose, and of texts at limits.

    In the cells that hold half of what cuts make, whole texts are taken to be rare: the rate is the median, weighed by that, of what each cell by itself suggests.
    """
    by_mark = np.arange(CELLS) // (CELLS // len(MARKS))
    made = np.isin(by_mark, MADE)
    inside = (by_mark != 0) & ~made  # cells of texts that stop inside a sentence, unmarked
    share = float((marks[made].sum() + PRIOR_TEXTS / 2) / (marks[made | inside].sum() + PRIOR_TEXTS))
    total = max(whole.sum(), 1.0)
    before = PRIOR_TEXTS / inside.sum()
    p = np.where(inside, cut + before, 0.0)
    p = p / p.sum()
    n = np.where(inside, whole, 0.0)
    at = np.flatnonzero(inside)[np.argsort((n / np.maximum(p, 1e-12))[inside], kind="stable")]
    k = at[np.searchsorted(np.cumsum(p[at]), 0.5)]
    cuts = float(n[k] / p[k])
    q = np.maximum(n - 1.0 - cuts * p, 0.0) + before * np.exp(-_expected())  # a text is no evidence of how whole ones end by itself
    p *= 1 - share
    p[made], q[made] = share / made.sum(), 0.05 / made.sum()  # a whole text doesn't end in these
    p[by_mark == 0] = q[by_mark == 0] = 1.0
    return np.log(p) - np.log(q / total), min(1.0, (cuts + 0.5) / (total + 1) / (1 - share))


def judged(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """Every text that isn't blank with ``p_limit``, ``log_odds`` of having been cut off, and ``is_cut``."""
    return _judged(endings(df, key, source, text), key, source)[0]


def _judged(ends: DataFrame, key: str, source: str) -> tuple[DataFrame, DataFrame]:
    lim = stored(limits(ends))
    per = lim.groupBy("src").pivot("unit", list(UNITS)).agg(F.collect_list(F.struct("lim", "p_cut")))
    j = ends.join(F.broadcast(per.select("src", *[F.col(u).alias(f"{u}_at") for u in UNITS])), "src")
    p = F.lit(0.0)
    for u, w in UNITS.items():
        here = F.filter(f"{u}_at", lambda x: (F.col(u) > x.lim - w) & (F.col(u) <= x.lim))  # noqa: B023
        p = F.greatest(p, F.coalesce(F.array_max(F.transform(here, lambda x: x.p_cut)), F.lit(0.0)))
    j = j.select("key", "src", "cell", "cut_cell", p.alias("p_limit"))
    away = F.col("p_limit") < 0.5
    counts = j.groupBy("src", "cell").agg(F.count_if(away).alias("whole"), F.sum(F.when(~away, F.col("p_limit")).otherwise(0.0)).alias("at")).toPandas()  # sources times CELLS rows
    both = F.array(F.struct(away.alias("whole"), F.col("cell").alias("c")), F.struct(F.lit(None).alias("whole"), F.col("cut_cell").alias("c")))
    learn = np.zeros((2, CELLS))
    for whole, c, n in j.where("cut_cell is not null").select(F.explode(both).alias("x")).groupBy("x.whole", "x.c").count().collect():  # 3 * CELLS rows
        if whole is not False:
            learn[int(whole is None), c] = n
    total = np.zeros(CELLS)
    np.add.at(total, counts["cell"].to_numpy(), counts["at"].to_numpy())
    ratio, rate = ending_ratio(*learn, total)
    rates = _rates(counts, ratio, rate)
    odds = F.element_at(F.array(*[F.lit(float(x)) for x in ratio]), F.col("cell") + 1)
    spark = ends.sparkSession
    j = j.join(F.broadcast(spark.createDataFrame(rates, "src string, rate double")), "src")
    prior = F.when(F.col("p_limit") >= 0.5, F.least(F.col("p_limit"), F.lit(1 - 1e-6))).otherwise(F.col("rate"))
    j = j.withColumn("log_odds", F.log(prior / (1 - prior)) + odds)
    stops = F.col("cell") >= CELLS // len(MARKS)
    out = j.select(F.col("key").alias(key), F.col("src").alias(source), F.round("p_limit", 6).alias("p_limit"), F.round("log_odds", 6).alias("log_odds"), (stops & (F.col("log_odds") > 0)).alias("is_cut"))
    return out, lim


def _rates(counts: pd.DataFrame, ratio: np.ndarray, rate: float, prior: float = PRIOR_TEXTS) -> list[tuple[str, float]]:
    """Each source's rate of cuts away from limits, by expectation maximisation from the rate of all, which weighs as ``prior`` texts."""
    out, lr, rate = [], np.exp(np.clip(ratio, -50, 50)), min(max(rate, 1e-4), 0.5)
    lr[: CELLS // len(MARKS)] = 0.0
    for src, g in counts.groupby("src"):
        n, x, r = g["whole"].to_numpy(float), lr[g["cell"].to_numpy()], rate
        for _ in range(100):
            r = float(((n * r * x / (1 - r + r * x)).sum() + prior * rate) / (n.sum() + prior))
            r = min(r, 0.9)
        out.append((src, r))
    return out


def shares(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """Per source: texts, cut texts, their share, and the likeliest limit with its unit."""
    j, lim = _judged(endings(df, key, source, text), key, source)
    j = j.groupBy(source).agg(F.count("*").alias("n_texts"), F.count_if("is_cut").alias("n_cut"))
    best = lim.where("p_cut > 0.5").groupBy("src").agg(F.max(F.struct("p_cut", "lim", "unit")).alias("m"))
    return j.join(F.broadcast(best.withColumnRenamed("src", source)), source, "left").select(source, "n_texts", "n_cut", F.round(F.col("n_cut") / F.col("n_texts"), 6).alias("share_cut"), F.col("m.lim").alias("likely_limit"), F.col("m.unit").alias("limit_unit"))
