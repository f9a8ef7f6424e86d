"""Problems 4, 5, 8, 9, 10: brute force on small data, edge cases."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from chunkwell.llm import leakage, lookalike, neardup, packing, truncation
from chunkwell.operators.graph import components


def edited(rnd, base):
    w = base[:]
    for _ in range(rnd.randrange(0, 8)):
        k = rnd.randrange(len(w))
        w[k : k + rnd.randrange(2)] = [rnd.choice("abcdefghij") * 3] if rnd.random() < 0.7 else []
    return w


def corpus(rnd, n=160):
    bases = [[rnd.choice(["the", "of", "shall", f"w{rnd.randrange(400)}"]) for _ in range(rnd.randrange(42, 90))] for _ in range(12)]
    rows = [(f"c{i:03}", " ".join(edited(rnd, rnd.choice(bases))), rnd.choice(["A", None]), rnd.choice(["1", "2", None])) for i in range(n)]
    return rows + [rows[0], ("c900", None, "A", "1"), ("c901", "", "A", "1"), ("c902", "too short", "A", "1")]


def brute_pairs(rows, t=0.6):
    sets = {}
    for k, text, a, s in rows:
        w = (text or "").split()
        if len(w) >= 40:
            sets[k] = ((a, s), {tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    keys = sorted(sets)
    return {(x, y) for i, x in enumerate(keys) for y in keys[i + 1 :] if sets[x][0] == sets[y][0] and len(sets[x][1] & sets[y][1]) >= t * len(sets[x][1] | sets[y][1]) - 1e-12}


def near(spark, rows):
    df = spark.createDataFrame(rows, "k string, text string, act string, sec string")
    rec = neardup.records(df, "k", "text", [F.col("act"), F.col("sec")])
    return rec, neardup.similar_classes(rec)


def test_pairs_equal_brute_force(spark, monkeypatch):
    for seed, hot, common in ((1, 2048, 1 << 20), (2, 3, 1 << 20), (3, 3, 2)):
        monkeypatch.setattr(neardup, "HOT", hot)  # the second run takes the way of hot runs and of many copies, the third deals common ones by record
        monkeypatch.setattr(neardup, "COMMON", common)
        monkeypatch.setattr(neardup, "COPIES", 4096 if hot > 3 else 1)
        rows = corpus(random.Random(seed))
        rows += [(f"e{i}", *rows[i % 3][1:]) for i in range(20)]
        rec, links = near(spark, rows)
        assert {tuple(r) for r in neardup.pairs_of(rec, links).collect()} == brute_pairs(rows)


def test_long_texts_with_little_in_common_are_no_candidates(spark):
    # every two share a phrase of eight words; sketches of 64 bits are full at this length and drop nothing
    rnd = random.Random(5)
    text = {i: [] for i in range(36)}
    for i in text:
        for j in range(i):
            phrase = [f"w{rnd.randrange(10**6)}" for _ in range(8)]
            text[i] += phrase
            text[j] += phrase
    rows = [(f"c{i:02}", " ".join(w), "A", "1") for i, w in text.items()]
    rows.append(("near", " ".join(text[3][:-20]), "A", "1"))
    rec, links = near(spark, rows)
    assert neardup._candidates(rec, 0.6).count() == 1
    assert [tuple(r) for r in neardup.pairs_of(rec, links).collect()] == [("c03", "near")]


def test_long_pairs_about_the_limit_in_slices(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SLICES", 3)
    rnd = random.Random(6)
    rows = []
    for b in range(5):
        base = [rnd.choice(["the", "of", f"w{rnd.randrange(3000)}"]) for _ in range(rnd.choice([120, 400, 900]))]
        for i in range(9):
            share = rnd.uniform(0.02, 0.1)
            rows.append((f"c{b}{i}", " ".join(f"x{rnd.randrange(3000)}" if rnd.random() < share else w for w in base), "A", None))
    want = brute_pairs(rows)
    rec, links = near(spark, rows)
    assert {tuple(r) for r in neardup.pairs_of(rec, links).collect()} == want and 20 < len(want) < 5 * 36


def shuffled(spark):
    """Bytes of the shuffle files by name."""
    jvm = spark._jvm
    files = jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle") and f.getName().endswith(".data")}


def left_after(spark, before, most):
    """Bytes of later shuffle files; they are deleted beside the query, so a few seconds are given to get below ``most``."""
    for _ in range(50):
        left = sum(n for f, n in shuffled(spark).items() if f not in before)
        if left < most:
            break
        time.sleep(0.1)
    return left


def test_shuffle_files_are_deleted_when_stored(spark):
    from chunkwell.functions.storage import CLEANUP, stored

    before, setting = shuffled(spark), spark.conf.get(CLEANUP)
    got = stored(spark.range(20_000).repartition(3, "id").select(F.sha2(F.col("id").cast("string"), 256).alias("k")), free=True)
    assert left_after(spark, before, 1000) < 1000
    assert got.distinct().count() == 20_000 and spark.conf.get(CLEANUP) == setting


def test_rounds_of_components_leave_no_shuffle_files(spark):
    links = spark.range(4000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1 + F.col("id") % 2).alias("b"))
    before = shuffled(spark)
    got = components(links)
    assert left_after(spark, before, 20_000) < 20_000  # but for the rounds' counts
    assert got.select("node").distinct().count() == got.count() >= 4000


def test_groups_and_survivors(spark):
    rows = corpus(random.Random(4))
    rec, links = near(spark, rows)
    got = {}
    for k, g in neardup.groups(rec, links).collect():
        got.setdefault(g, set()).add(k)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(rows):
        parent[find(a)] = find(b)
    want = {}
    for x in list(parent):
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_survivor_order(spark):
    rows = [("a", "long text here", "Official Gazette", "ratified", None), ("b", "longer text here", "official-gazette", "Ratified ", None), ("c", "x", "advocacy_report", "ratified", "original_bangla"), ("d", None, None, None, None)]
    rows = [(*r, d) for r, d in zip(rows, ("2031", "2030-05", "2032-01-02", None), strict=True)]
    df = spark.createDataFrame(rows, "k string, text string, authority_rank string, legal_status string, translation_status string, effective_date string")
    member = spark.createDataFrame([(r[0], 1) for r in rows], "key string, group_id long")
    assert [tuple(r) for r in neardup.survivors(df.unionByName(df), "k", "text", member).collect()] == [(1, "b")]
    got = neardup.merged(df, "k", "text", member).first()
    assert got.k == "b" and got.n_members == 4 and got.translation_status == "original_bangla" and got.effective_date == "2032-01-02"
    assert neardup.survivors(df.where("false"), "k", "text", member).count() == 0


def test_no_records(spark):
    rec, links = near(spark, [("a", None, None, None)])
    assert neardup.pairs_of(rec, links).count() == 0 and neardup.groups(rec, links).count() == 0


def test_best_fit():
    rnd = random.Random(7)
    sizes = sorted((rnd.randrange(0, 513) for _ in range(3000)), reverse=True)
    where, caps = packing.best_fit(sizes, [128, 256, 512])
    used = np.bincount(where, weights=sizes, minlength=len(caps))
    assert (used <= caps).all() and sum(sizes) / sum(caps) > 0.98
    assert all(c == min(x for x in (128, 256, 512) if x >= u) for u, c in zip(used, caps, strict=True))


def test_pack_frame(spark):
    counts = spark.createDataFrame([(1, 1000), (2, 0), (3, 30), (4, 128), (5, 129), (5, 129)], "doc_id long, n_tokens long")
    got = packing.pack(counts, "doc_id", {"small": [128], "joint": [128, 512]}, 3).collect()
    for plan, cap in (("small", 128), ("joint", 512)):
        mine = [r for r in got if r.plan == plan]
        assert sum(r.tokens for r in mine) == 1000 + 30 + 128 + 129 * 2
        parts = {}
        for r in mine:
            parts.setdefault(r.doc_id, []).append((r.part_no, r.token_start, r.tokens))
            assert r.tokens <= r.bin_capacity <= cap
        assert len(parts[1]) == -(-1000 // cap) and len(parts[2]) == 1 and len(parts[4]) == 1
        load = {}
        for r in mine:
            load[r.bin_id] = load.get(r.bin_id, 0) + r.tokens
        assert all(load[r.bin_id] <= r.bin_capacity for r in mine)
    assert packing.pack(counts.limit(0), "doc_id", {"small": [128]}).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello <|endoftext|> world"), (2, ""), (3, None)], "k long, t string")
    got = dict(packing.token_counts(df, "k", "t").collect())
    assert got[2] == 0 and got[1] > 3 and 3 not in got


def test_fm_index():
    rnd = np.random.default_rng(5)
    seq = rnd.integers(1, 6, 3000)
    index = leakage.FMIndex(seq, 6)
    phrases = np.array([seq[i : i + 4] for i in rnd.integers(0, 2990, 40)] + [[5, 5, 5, 5], [1, 6, 1, 1]])
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi, strict=True):
        want = [i for i in range(2997) if (seq[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_leaked_equals_brute_force(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice([f"w{rnd.randrange(30)}", "The", "of,"])
    passages = [(i, " ".join(word() for _ in range(rnd.randrange(5, 40)))) for i in range(20)] + [(99, None), (98, "")]
    docs = []
    for k in range(120):
        w = [word() for _ in range(30)]
        p = rnd.choice(passages[:20])[1].split()
        s = rnd.randrange(len(p))
        docs.append((k, " ".join([*w, *[x.upper() + "!" for x in p[s : s + rnd.randrange(8, 30)]], *w[:9]])))
    docs += [(900, None), (901, ""), docs[3]]
    r = lookalike.Reader(np.log(np.full((27, 27), 1 / 27)))
    runs = {}
    for i, t in passages:
        w = leakage.words_of(t or "", r)
        for j in range(len(w) - 11):
            runs.setdefault(tuple(w[j : j + 12]), set()).add(i)
    want = {(k, i) for k, t in docs for w in [leakage.words_of(t or "", r)] for j in range(len(w) - 11) for i in runs.get(tuple(w[j : j + 12]), ())}
    d, p = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string")
    got = leakage.leaked(d, "doc_id", "text", p, "item_id", "text")
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want and want
    assert leakage.leaked(d.limit(0), "doc_id", "text", p, "item_id", "text").count() == 0
    assert leakage.leaked(d, "doc_id", "text", p.limit(0), "item_id", "text").count() == 0


def test_censored_fit():
    rnd = np.random.default_rng(1)
    x = np.minimum(np.exp(rnd.normal(6.5, 0.6, 20000)), 1000).round()
    v, n = np.unique(x, return_counts=True)
    mu, sd = truncation.fit_censored(v, n, 1000)
    assert abs(mu - 6.5) < 0.03 and abs(sd - 0.6) < 0.03


def test_cut_texts(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        t = " ".join(" ".join(rnd.choice(["worker", "shall", "pay", "depot"]) for _ in range(9)).capitalize() + "." for _ in range(rnd.randrange(2, 40)))
        rows.append((i, "feed", t[:900]))
    want = {i for i, _, t in rows if not t.rstrip().endswith(".")}
    ends = ["All is well.\nDated: 3 May 2031", "He went away […]", "He went aw…", "“and so on...”", "Paid in full.", "He paid Dr.", "It was re�", "He paid the", None, ""]
    rows += [(1000 + i, None, t) for i, t in enumerate(ends)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    j = truncation.judged(df, "doc_id", "source", "text").collect()
    got = {r.doc_id for r in j if r.is_cut}
    assert {x for x in got if x < 1000} == want
    assert {x for x in got if x >= 1000} == {1001, 1002, 1005, 1006, 1007}
    s = {r.source: r for r in truncation.shares(df, "doc_id", "source", "text").collect()}
    assert s["feed"].likely_limit == 900 and s["feed"].n_cut == len(want)
    assert truncation.judged(df.limit(0), "doc_id", "source", "text").count() == 0


def test_limit_below_longer_texts(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        t = "কাজ " + "\n".join(" ".join(rnd.choice(["শ্রমিক", "মালিক", "কাজ", "pay"]) for _ in range(rnd.randrange(4, 9))) + "।" for _ in range(int(rnd.lognormvariate(3, 0.5))))
        rows.append((i, "dump", t.encode()[:3000].decode(errors="replace") if i % 40 else t + "\n" + "শেষ হইল।" * i))
    cut = {i for i, _, t in rows if i % 40 and len(t.rstrip("\ufffd").encode()) > 2996}
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    r = truncation.limits(truncation.endings(df, "doc_id", "source", "text")).where("unit = 'bytes' and p_cut > 0.5").collect()
    assert [x.lim for x in r] == [3000] and r[0].n_at == len(cut) > 20
    assert {x.doc_id for x in truncation.judged(df, "doc_id", "source", "text").where("p_limit > 0.5").collect()} == cut


def test_no_limit_by_chance():
    import pandas as pd

    rnd = np.random.default_rng(2)
    for unit in ("chars", "bytes", "words"):
        v, n = np.unique(np.exp(rnd.normal(4 if unit == "words" else 7, 0.7, 5000)).astype(int), return_counts=True)
        got = truncation._limit(pd.DataFrame({"src": "s", "unit": unit, "length": v, "n": n}))
        assert not (got["p_cut"] > 0.5).any()


def test_ending_of_a_long_last_line(spark):
    rows = [(1, "s", "Notice.\n" + "Dated " + "word " * 400 + "end"), (2, "s", "One line " * 200), (3, "s", "A.\n \nB […]\n\t ")]
    e = {r.key: r for r in truncation.endings(spark.createDataFrame(rows, "doc_id long, source string, text string"), "doc_id", "source", "text").collect()}
    part = lambda c: (truncation.MARKS[c // 36], truncation.FORMS[c // 9 % 4], truncation.BEFORE[c // 3 % 3])
    assert [part(e[k].cell) for k in (1, 2, 3)] == [("none", "long", "done"), ("none", "long", "alone"), ("omitted", "brief", "done")]
    assert (e[1].words, e[2].chars, e[3].chars) == (403, 1799, 6) and all(e[k].cut_cell is not None for k in (1, 2))


def test_ending_ratio_takes_cuts_off():
    inside = truncation.CELLS - 1  # unmarked, long, open, unknown
    form = 4 * 36 + 1 * 9 + 1 * 3  # unmarked, of a closing form after a whole line
    whole, cut, marks = np.zeros(truncation.CELLS), np.zeros(truncation.CELLS), np.zeros(truncation.CELLS)
    whole[0], whole[inside], whole[form], cut[inside], cut[form], marks[inside] = 9000, 100, 900, 970, 30, 50
    ratio, rate = truncation.ending_ratio(whole, cut, marks)
    assert 0.008 < rate < 0.02 and ratio[inside] > 5 and ratio[form] < -0.5


def test_removal_spans(spark):
    rows = [(1, 7, 0, 11), (1, 8, 5, 20), (1, 7, 21, 40), (1, 7, 60, 71), (2, 9, 3, 14)]
    got = leakage.removal_spans(spark.createDataFrame(rows, "doc_id long, item_id long, first_word long, last_word long"), "doc_id", "item_id").collect()
    assert {tuple(r) for r in got} == {(1, 0, 40, 2), (1, 60, 71, 1), (2, 3, 14, 1)}


def test_parts_join_to_their_text(spark):
    texts = {1: "শ্রমিক মজুরি পাইবেন। " * 60, 2: "short text", 3: "", 4: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, t string")
    bins = packing.packed(df, "doc_id", "t", {"small": [64], "joint": [64, 128]})
    got = {}
    for r in packing.part_texts(bins, df, "doc_id", "t").collect():
        got.setdefault((r.plan, r.doc_id), []).append((r.part_no, bytes(r.piece)))
    for plan in ("small", "joint"):
        assert {k[1]: b"".join(x for _, x in sorted(v)).decode() for k, v in got.items() if k[0] == plan} == {k: v for k, v in texts.items() if v is not None}


def test_joint_capacities_waste_no_more_than_single_ones():
    rnd = random.Random(2)
    for _ in range(20):
        sizes = [min(512, int(rnd.lognormvariate(4, 1)) + 1) for _ in range(400)]
        room = lambda caps: sum(packing.best_fit(sizes, caps)[1])  # noqa: E731, B023
        assert room([128, 256, 512]) <= room([512])


def test_passages_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK", 2)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    items = [(k, " ".join(words[k * 10 : k * 10 + 14])) for k in range(4)] + [(9, None)]
    got = leakage.leaked(docs, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()
    assert sorted((r.item_id, r.first_word, r.last_word) for r in got) == [(k, k * 10, k * 10 + 13) for k in range(4)]
    assert leakage.leaked(docs, "doc_id", "text", spark.createDataFrame([], "item_id long, text string"), "item_id", "text").count() == 0


def test_sql_skeleton_of_copies():
    import duckdb

    from chunkwell.llm import sql

    con = duckdb.connect()
    for a, b in [("ｗａｇｅ", "wage"), ("wаgе", "wage"), ("ofﬁce", "office"), ("a b", "a b"), ("t​he", "the"), ("কো", "কো")]:
        assert con.execute(f"select {sql.skeleton('x')} = {sql.skeleton('y')} from (select '{a}' as x, '{b}' as y)").fetchone()[0]
