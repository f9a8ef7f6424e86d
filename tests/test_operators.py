"""Operators against brute force on small data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwell.operators import dedup, evaluation, graph, ingest, parents, quality, retrieval
from chunkwell.sources import corpus, sinks

CHUNK = "seq long, chunk_id string, doc string, page int, kind string, node string, text string, chapter string, section_marker string, section_title string, retrievable boolean, est_tokens int, pollution string, source_act string, authority_rank string, text_layer string, section_number string, amends_section string"


def chunk(seq, **k):
    base = {"seq": seq, "chunk_id": f"c{seq}", "doc": "d", "page": 1, "kind": "leaf", "node": "1", "text": f"text {seq}", "chapter": "", "section_marker": "1", "section_title": "T", "retrievable": True, "est_tokens": 20, "pollution": None, "source_act": "A", "authority_rank": "official_gazette", "text_layer": "consolidated_base", "section_number": "1", "amends_section": None}
    return tuple((base | k).values())


def test_hierarchy_equals_walk(spark):
    rnd = random.Random(2)
    rows = [(doc, page, n, line) for doc in ("x", "y") for page in (1, 2, 3) for n, line in enumerate(rnd.choice(["12. Head", "(3) sub", "(a) clause", "CHAPTER I", "Provided that", "words", "| a |", "৪। শিরোনাম"]) for _ in range(15))]
    text = {}
    for d, p, _n, line in rows:
        text.setdefault((d, p), []).append(line)
    df = spark.createDataFrame([(d, p, "\n".join(v)) for (d, p), v in text.items()], "doc string, page int, text string")
    got = {(r.doc, r.page, r.line_no): r for r in ingest.hierarchy(ingest.line_table(df, "doc", "page", "text")).collect()}
    for doc in ("x", "y"):
        marker, base, suffix, chapter = "", "", "", None
        for page in (1, 2, 3):
            block = 0
            for n, _ in enumerate(text[doc, page]):
                r = got[doc, page, n]
                block += r.kind != "text" or n == 0
                if r.kind == "section":
                    marker, base, suffix = r.mark, "", ""
                elif r.kind == "chapter":
                    marker, base, suffix, chapter = "", "", "", r.line
                elif r.kind == "subsection":
                    base, suffix = f"({r.mark})", ""
                elif r.kind == "clause":
                    suffix = f"({r.mark})"
                elif r.kind == "proviso":
                    suffix = "(proviso)"
                elif r.kind == "table_row":
                    base = suffix = ""
                assert (r.section_marker, r.node, r.chapter, r.block) == (marker, marker + (suffix or base), chapter, block)


def walk(doc, pages):
    """A document's chunks, line by line, with one state for all pages."""
    import re

    node = chapter = sec = title = ""
    out, fm_seen = [], False
    ascii_ = str.maketrans("০১২৩৪৫৬৭৮৯", "0123456789")
    flat = lambda t: " ".join(t.split())
    for page, text in pages:
        lines = [x.strip() for x in text.splitlines() if x.strip()]
        cut = 2 if lines[:1] == ["Registered No. DA-1"] else 0
        blocks, pending, header, used, hits, quotes, rows = [], [], None, False, 0, 0, 0

        def flush():
            if pending:
                t = flat(" ".join(pending))
                ps = [t] if ingest.py_tokens(t) <= 350 else [flat(p) for p in ingest.pack_lines("\n".join(pending))]
                blocks.extend(["leaf", node, chapter, sec, title, f"{i + 1}/{len(ps)}" if len(ps) > 1 else None, p] for i, p in enumerate(ps))
                pending.clear()

        for x in [*lines[cut:], None]:
            if x is None or not x.startswith("|"):
                if header and not used:
                    pending.append(header)
                header, used = None, False
            if x is None:
                flush()
            elif x.startswith(">"):
                pending.append(x[1:].strip())
                quotes += 1
            elif x.startswith("|"):
                flush()
                node = sec
                hits += 1
                if header is None:
                    header = x
                else:
                    pending += [header, x]
                    used = True
                    rows += 1
                    flush()
            elif m := re.match(r"([০-৯]{1,3})।\s*", x):
                flush()
                hits += 1
                rest = x[m.end() :]
                h = re.match(r"(.{1,250}?)।\s*[—–-]+\s*(.*)$", rest)
                title, body = (flat(h[1]), h[2].strip()) if h else ("", rest)
                sec = node = str(int(m[1].translate(ascii_)))
                if title:
                    blocks.append(["section_header", sec, chapter, sec, title, None, title])
                if s := re.match(r"\(([০-৯]{1,2}[ক-হ]?)\)", body):
                    node = f"{sec}({s[1].translate(ascii_)})"
                if body:
                    pending.append(body)
            elif m := re.match(r"([0-9]{1,3})\.", x):
                flush()
                hits += 1
                sec = node = m[1]
                title = flat(x[m.end() :])
                if title:
                    blocks.append(["section_header", sec, chapter, sec, title, None, title])
            elif m := re.match(r"\(([0-9০-৯]{1,2}|[a-zক-হ])\)|Provided", x):
                flush()
                hits += 1
                mark = (m[1] or "proviso").translate(ascii_)
                node = f"{sec if mark.isdigit() else node.split('(')[0]}({mark})"
                pending.append(x)
            elif x.startswith("CHAPTER"):
                flush()
                hits += 1
                chapter, node = x, ""
            else:
                pending.append(x)
        if hits >= 3 or rows or (quotes and sec):
            merged, carry = [], []
            join = lambda bs: flat(" ".join(b[6] for b in bs))

            def alone(into):
                a = next((b for b in carry if b[0] == "section_header"), None)
                if a and a[3] != into and ingest.py_tokens(join(carry)) >= 12:
                    merged.append(["leaf", *a[1:6], join(carry)])
                    carry.clear()

            for b in blocks:
                short = ingest.py_tokens(b[6]) < 12
                if short and not carry and b[0] == "leaf" and "(" in b[1] and merged and merged[-1][3] == b[3]:
                    merged[-1][6] = join([merged[-1], b])
                    continue
                alone(b[3])
                if b[0] == "section_header" or short:
                    carry.append(b)
                else:
                    merged.append([*b[:6], join([*carry, b])])
                    carry.clear()
            alone(merged[-1][3] if merged else None)
            if carry and merged:
                merged[-1][6] = join([merged[-1], *carry])
            elif carry:
                merged = [["leaf", "", "", "", "", None, join(carry)]]
        else:
            t = flat(" ".join(lines[cut:]))
            merged = [["prose_fallback", f"part{i:02d}", doc, "", "", None, p] for i, p in enumerate(ingest.split_long(t) if t else [], 1)]
        if cut and not fm_seen:
            merged = [["front_matter", "front_matter", doc, "", "", None, " ".join(lines[:cut])], *merged]
        fm_seen = fm_seen or cut > 0
        out += [(doc, page, *b) for b in merged]
    return out


def test_walker_equals_walk(spark):
    rnd = random.Random(4)
    words = lambda n: " ".join(rnd.choice(["labour", "worker", "shall", "pay", "due."]) for _ in range(n))
    kinds = [lambda: f"{rnd.randrange(1, 99)}. {words(rnd.choice([0, 3, 14]))}", lambda: f"(3) {words(rnd.choice([2, 20]))}", lambda: f"(b) {words(4)}", lambda: "CHAPTER IV", lambda: "Provided that " + words(15), lambda: words(rnd.choice([3, 30, 300])), lambda: "| " + words(2) + " |", lambda: "> (1) " + words(9), lambda: "০৪। শিরোনাম।—(১) " + words(12), lambda: "৫। " + words(8), lambda: "  "]
    rare = [*kinds[5:8], kinds[5], kinds[5]]
    docs = {f"d{i}": [(p, "\n".join([*(["Registered No. DA-1", "Ministry of Labour"] if rnd.random() < 0.2 else []), *[rnd.choice(use)() for _ in range(rnd.randrange(1, 12))]])) for p in range(1, 6) for use in [rnd.choice([kinds, kinds, rare, kinds[5:6]])]] for i in range(12)}
    docs["table"] = [(1, "9. Rates\n| Grade | Pay |\n| I | 20 |\n| II | 30 |\nafter\n| alone |\nCHAPTER V\ntext"), (2, f"(2) {words(20)}\n(3) {words(20)}\n(4) {words(20)}")]
    docs["plain"] = [(1, "One. Two.\nThree.")]
    df = spark.createDataFrame([(d, p, t) for d, ps in docs.items() for p, t in ps] + [("none", 1, None), ("none", 2, " \n")], "doc string, page int, text string")
    cols = ["doc", "page", "kind", "node", "chapter", "section_marker", "section_title", "split_part", "text"]
    got = [tuple(r[c] for c in cols) for r in ingest.walked(df, "doc", "page", "text").orderBy("doc", "page", "block").collect()]
    want = [r for d in sorted(docs) for r in walk(d, docs[d])]
    assert got == want and {r[2] for r in want} == {"leaf", "prose_fallback", "front_matter"} and any(r[7] for r in want)
    rows = [(r[3], r[6], r[8]) for r in got if r[0] == "table"]
    assert rows[0][2].startswith("Rates | Grade | Pay | | I | 20 |")
    assert all("CHAPTER" not in r[8] for r in got if r[2] == "leaf") and rows[-1][:2] == ("9(4)", "Rates")


def test_routing(spark):
    texts = ["", "  \n", "plain words here", "a    b\nc", "a b c d                             x\n" * 4, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(ingest.text_label(F.col("t"))).collect()] == ["empty", "empty", "prose", "mixed", "table", "empty"]
    words = [("p", w) for w in ["†x"] * 10 + [f"w{i}" for i in range(70)]] + [("q", "few"), ("r", "(cid:1)"), *[("r", f"a{i}") for i in range(5)]]
    e = ingest.page_evidence(spark.createDataFrame(words, "page string, w string"), ["page"], "w")
    assert dict(e.select("page", ingest.page_label()).collect()) == {"p": "visual_routing_required", "q": "empty", "r": "visual_routing_required"}
    page = spark.createDataFrame([([("in", 1.0, 2.0, 1.0, 2.0), ("out", 8.0, 9.0, 1.0, 2.0)], [(0.0, 5.0, 0.0, 5.0), (0.0, 3.0, 0.0, 3.0)])], "words array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>, tables array<struct<x0:double,x1:double,top:double,bottom:double>>")
    assert tuple(page.select(ingest.text_outside_tables(F.col("words"), F.col("tables")), ingest.words_in_tables(F.col("words"), F.col("tables"))).first()) == ("out", 2)


def test_masthead_cut(spark):
    t = ["Some line\nRegistered No. 5\nTHE LABOUR RULES\nMinistry of X\nBody text\nGazette", "Gazette\nBody", "Body\nBody\nBody\nRegistered No. 5", None]
    df = spark.createDataFrame([(x,) for x in t], "t string")
    assert [r[0] for r in df.select(ingest.masthead_cut(F.col("t"))).collect()] == [4, 0, 0, 0]


def test_windows_equal_walk():
    rnd = random.Random(11)
    cost = lambda w: max(1, round(w * 1.3))
    for _ in range(400):
        words = [rnd.randrange(0, 40) for _ in range(rnd.randrange(0, 30))]
        cap, least = rnd.choice([20, 60, 350]), rnd.choice([0, 1])
        want, start, size = [], 0, 0
        for k, w in enumerate(words):
            if k > start and size + cost(w) > cap:
                want.append((start, k))
                start = k - max(least, int((k - start) * 0.15))
                size = cost(sum(words[start:k])) if start < k else 0
            size += cost(w)
        if words:
            want.append((start, len(words)))
        sums = lambda x: np.concatenate(([0], np.cumsum(x))).astype(int)
        assert ingest.windows(sums(words), sums([cost(w) for w in words]), cap, 0.15, least) == want


def test_dispatch(spark):
    from chunkwell.plans.registry import PAGES

    box = lambda rows: (0.0, 5.0, 0.0, 5.0, rows)
    words = [("in", 1.0, 2.0, 1.0, 2.0), ("out", 8.0, 9.0, 1.0, 2.0)]
    good, bad, one = [["h", "i"], ["x", "1"]], [["", "i"], ["x", "1"]], [["h", "i"]]
    rows = [("d", 1, "empty", "", words, [box(good)]), ("d", 2, "prose", "text", words, []), ("d", 3, "table", "t", words, [box(good), box(bad)]), ("d", 4, "table", "t", words, [box([])]), ("d", 5, "table", "t", None, None), ("d", 6, "mixed", "in out", words, [box(one)]), ("d", 7, "mixed", "in out", words, [box(good)]), ("d", 8, "mixed", "in out", words, [box(bad)]), ("d", 9, "visual_routing_required", "††", words, []), ("d", 10, "transcribed", None, None, None)]
    got = ingest.dispatch(spark.createDataFrame(rows, f"doc string, page int, label string, text string, {PAGES}"))
    assert {r.page: r.text for r in got["prose"].collect()} == {2: "text", 6: "in out", 7: "out", 8: "out", 10: ""}
    assert {(r.page, r.grid_no) for r in got["tables"].collect()} == {(3, 0), (7, 0)}
    assert sorted((r.page, r.kind, r.node) for r in got["flags"].collect()) == [(3, "table_validation_failed", "p003_t01"), (4, "needs_manual_transcription", ""), (5, "needs_manual_transcription", ""), (8, "table_validation_failed", "p008_t00"), (9, "needs_manual_transcription", "")]
    assert {r.page: (r.kept, r.rejected) for r in got["stats"].collect()}[3] == (1, 1)
    blocked = quality.all_flags(got["flags"], spark.createDataFrame([("furniture_stripped", "t", "d")], "kind string, text string, doc string"))
    assert blocked.count() == 6 and blocked.columns == ["kind", "node", "text", "doc", "page", "reason"]


def test_caption(spark):
    w = [("far", 0.0, 1.0, 0.0, 5.0), ("B", 5.0, 6.0, 50.0, 58.0), ("A", 1.0, 2.0, 51.0, 56.0), ("low", 9.0, 9.5, 44.0, 59.0), ("below", 1.0, 2.0, 70.0, 75.0)]
    df = spark.createDataFrame([(w, (0.0, 9.0, 60.0, 90.0)), (w, (0.0, 9.0, 3.0, 90.0))], "words array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>, box struct<x0:double,x1:double,top:double,bottom:double>")
    assert [r[0] for r in df.select(ingest.caption(F.col("words"), F.col("box"))).collect()] == ["A B", ""]


def test_packing(spark):
    long = " ".join(f"Word{i} is here." for i in range(400))
    got = ingest.split_long(long)
    assert all(ingest.py_tokens(p) <= 350 for p in got) and got[0].split(". ")[-1].rstrip(".") in got[1]
    df = spark.createDataFrame([("a", long), ("b", "x"), ("c", None), ("d", " ")], "k string, t string")
    assert {r.k: r.n_pieces for r in ingest.pack(df, "k", "t").collect()} == {"a": len(got), "b": 1}


def test_merge_short():
    b = lambda kind, node, sec, n: {"block": 0, "kind": kind, "node": node, "section": sec, "text": " ".join(["w"] * n)}
    out = ingest.merge_short([b("leaf", "1", "1", 20), b("leaf", "1(a)", "1", 2), b("section_header", "2", "2", 3), b("leaf", "2", "2", 30), b("leaf", "3", "3", 2)])
    assert [len(x["text"].split()) for x in out] == [22, 35]
    assert len(ingest.merge_short([b("leaf", "1", "1", 2)])) == 1 and ingest.merge_short([]) == []


def test_tables(spark):
    t = spark.createDataFrame([([["Item", "A", "A"], ["x", "1", "2.5"], ["x", "3"], ["", "", ""], ["", "4", ""], ["x (2)", "5", ""]], [["", "b"]]), ([["", "A"]], [["z", "A"], ["q", "23 9"]]), ([["", "A"]], [["z", "A"], ["q", "9"]]), ([], [["a"]])], "r array<array<string>>, s array<array<string>>")
    a, b, c, d = ingest.table_chunks(t, "r", "s").collect()
    assert a["labels"] == ["x", "x (2)", "row_3", "x (2) (2)"] and a.kept and '"x":{"A":{"d":2.5}}' in a.data_json
    assert not b.kept and len(b.reasons) == 2 and c.kept and c.data_json == '{"q":{"A":{"i":9}}}' and d.summary == "Empty table."


def test_gate(spark):
    rows = [chunk(i, page=i, text="Running head", est_tokens=3) for i in range(1, 6)] + [chunk(6, page=6, text="— 12 —", est_tokens=3), chunk(7, page=7, text=""), chunk(8, kind="front_matter"), chunk(9, kind="front_matter", retrievable=False, node=""), chunk(10, page=None)]
    df = spark.createDataFrame(rows, CHUNK)
    assert sorted(r.seq for r in quality.furniture(df).where("is_furniture").collect()) == [1, 2, 3, 4, 5, 6]
    r = quality.report(df).first()
    assert (r.empty_texts, r.blank_nodes, r.front_matter, r.checks_failed, r.blocked) == (1, 1, 2, 4, True)
    assert quality.index_bound(df, quality.report(df)).count() == 0 and quality.flags(df, quality.report(df)).count() == 1
    n = spark.createDataFrame([("d", x, i) for i, x in enumerate([1, 1, 2, 5, 4, 9])], "doc string, n int, o int")
    assert sorted(tuple(x) for x in quality.continuity(n, "doc", "n", "o").collect()) == [("d", "backward", 4, 5), ("d", "gap", 2, 4), ("d", "gap", 5, 9)]
    assert quality.delivered_once(df.unionByName(df.withColumn("seq", F.col("seq") + 100))).agg(F.max("seq")).first()[0] == 10


def test_parents(spark):
    rows = [chunk(i, est_tokens=200) for i in range(1, 101)] + [chunk(200, section_marker=None), chunk(201, section_marker="", est_tokens=0)]
    children, store = parents.build(spark.createDataFrame(rows, CHUNK))
    kids = dict(children.groupBy("parent_id").count().collect())
    parts = sorted((r.section_title, r.n_children, r.est_tokens) for r in store.where("kind = 'prose'").collect())
    assert [(n, t) for _, n, t in parts] == [(25, 5000)] * 4 and parts[0][0] == "T (part 1/4)"
    assert store.where("kind = 'self'").count() == 2 and sum(kids.values()) == 102


def test_large_sections_are_parted_as_small_ones(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [("d", m, i * 3, rnd.choice([0, 10, 200, 900, 6000])) for m in ("1", "2") for i in range(900)] + [("d", "3", 1, None)]
    df = spark.createDataFrame(rows, "doc string, m string, seq long, t int")
    key = lambda x: sorted(map(tuple, x.select("doc", "m", "seq", "part").collect()))
    want, part, n, t = [], 0, 0, 0
    for d, m, s, x in rows:
        if not s or n == 40 or t + (x or 0) > 5000 or m != last:  # noqa: F821
            part, n, t = (part + 1 if s and m == last else 1), 0, 0  # noqa: F821
        last, n, t = m, n + 1, t + (x or 0)  # noqa: F841
        want.append((d, m, s, part))
    assert key(parents.part_numbers(df, ["doc", "m"], "seq", "t")) == sorted(want)
    monkeypatch.setattr(parents, "FOLDED", 10)
    monkeypatch.setattr(parents, "BUCKET", 64)
    assert key(parents.part_numbers(df, ["doc", "m"], "seq", "t")) == sorted(want)


def test_continuity_across_buckets(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(d, rnd.choice([i // 3, i // 3, rnd.randrange(30), None]), i) for d in ("a", "b", None) for i in range(90)]
    df = spark.createDataFrame(rows, "doc string, n int, o long")
    want = set()
    for d in ("a", "b", None):
        nums, prev, top = [n for e, n, _ in rows if e == d and n is not None], None, None
        for n in nums:
            if n != prev and top is not None and n < top:
                want.add((d, "backward", n, top))
            prev, top = n, max(n, top if top is not None else n)
        u = sorted(set(nums))
        want |= {(d, "gap", a, b) for a, b in zip(u, u[1:], strict=False) if b > a + 1}
    for width in (1 << 16, 7):
        monkeypatch.setattr(quality, "WIDTH", width)
        assert {tuple(r) for r in quality.continuity(df, "doc", "n", "o").collect()} == want


def test_exact_duplicates(spark):
    rows = [chunk(1, text="Same  text", authority_rank="advocacy_report"), chunk(2, text="same text"), chunk(3, text="same text", source_act="B"), chunk(4, text=""), chunk(5, text=None)]
    got = {r.chunk_id: (r.winner, r.is_duplicate) for r in dedup.exact(spark.createDataFrame(rows, CHUNK)).collect()}
    assert got == {"c1": ("c2", True), "c2": ("c2", False), "c3": ("c3", False), "c4": ("c4", False), "c5": ("c5", False)}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(5)
    base = [[rnd.choice(["labour", "worker", "canteen", "gratuity", f"name{rnd.randrange(60)}"]) for _ in range(30)] for _ in range(5)]
    rows = []
    for i in range(60):
        w = rnd.choice(base)[:]
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(30)] = f"other{rnd.randrange(9)}"
        rows.append(chunk(i, doc=f"d{i % 7}", text=" ".join(w), authority_rank=rnd.choice(["official_gazette", None])))
    texts = [r[6] for r in rows]
    grams = []
    for t in texts:
        g = {}
        for w in t.split():
            for x in dedup._grams(w):
                g[x] = g.get(x, 0) + 1
        grams.append(g)
    n = len(rows)
    df = {}
    for g in grams:
        for x in g:
            df[x] = df.get(x, 0) + 1
    vec = [{x: c * (np.log((1 + n) / (1 + df[x])) + 1) for x, c in g.items()} for g in grams]
    norm = [sum(v * v for v in x.values()) ** 0.5 for x in vec]
    want = {tuple(sorted((rows[i][1], rows[j][1]))) for i in range(n) for j in range(i + 1, n) if rows[i][2] != rows[j][2] and sum(v * vec[j].get(x, 0) for x, v in vec[i].items()) / norm[i] / norm[j] >= 0.92}
    got = dedup.near_pairs(spark.createDataFrame(rows, CHUNK)).collect()
    assert {tuple(sorted((r.a, r.b))) for r in got} == want and want
    gone = dedup.near(spark.createDataFrame(rows, CHUNK)).collect()
    lost = {r.chunk_id for r in gone}
    left = {r.chunk_id for r in dedup.exact(spark.createDataFrame(rows, CHUNK)).where("not is_duplicate").collect()}
    assert lost and lost <= left and all(a in lost or b in lost for a, b in want if a in left and b in left)
    rounds = dedup.near(spark.createDataFrame(rows, CHUNK), large=0).collect()
    assert sorted(map(tuple, rounds)) == sorted(map(tuple, gone))


def test_hot_grams_in_blocks(spark, monkeypatch):
    rows = [chunk(i, doc=f"d{i % 5}", text=f"labour worker canteen gratuity wages payment overtime notice {i % 9}") for i in range(40)]
    df = spark.createDataFrame(rows, CHUNK)
    want = sorted((r.a, r.b) for r in dedup.near_pairs(df).collect())
    monkeypatch.setattr(dedup, "HOT", 4)
    assert sorted((r.a, r.b) for r in dedup.near_pairs(df).collect()) == want and want



def test_near_pairs_write_no_vectors(spark, monkeypatch):
    """What is written for a record is its text and a sketch of fixed size: on long texts vectors of 3- to 5-grams took several times the text."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = [chunk(i, doc=f"d{i % 3}", text=" ".join(word() for _ in range(1500))) for i in range(40)]
    rows.append(chunk(40, doc="d9", text=rows[0][6] + " " + word()))
    wrote = []

    def noted(df, *a, **k):
        import pathlib

        out = stored(df, *a, **k)
        wrote.append(sum(p.stat().st_size for p in pathlib.Path(out._stored_at.removeprefix("file://")).rglob("*.parquet")))
        return out

    stored = dedup.stored
    monkeypatch.setattr(dedup, "stored", noted)
    got = dedup.near_pairs(spark.createDataFrame(rows, CHUNK)).collect()
    assert [tuple(sorted((r.a, r.b))) for r in got] == [("c0", "c40")]
    assert sum(wrote) < 1.5 * sum(len(r[6]) for r in rows)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    path = [(i, i + 1) for i in range(400)] + [(5000, k) for k in range(5001, 5400)]  # long, and hot
    got = dict(graph.components(spark.createDataFrame(path, "a long, b long")).collect())
    assert {got[k] for k in range(401)} == {0} and {got[k] for k in range(5000, 5400)} == {5000}


def test_scratch_is_shared_and_released(spark, tmp_path):
    import os

    from chunkwell.functions import storage

    df = storage.stored(spark.range(5))
    assert df.count() == 5 and df._stored_at.startswith(spark.conf.get("spark.checkpoint.dir"))
    storage.release(df)
    assert not os.path.exists(df._stored_at.removeprefix("file://"))

    class Cluster:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Cluster()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        storage._folder(Session())


def test_search_and_fusion(spark):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(200, 8)), rng.normal(size=(7, 8))
    ix = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8)], "k long, vector array<double>").repartition(5)
    qs = spark.createDataFrame([(i // 3, i % 3, v.tolist()) for i, v in enumerate(q)], "query_id long, list_no int, vector array<double>")
    lists = retrieval.search(ix, qs, "k", "vector", 10)
    got = {}
    for r in lists.collect():
        got.setdefault((r.query_id, r.list_no), {})[r["rank"]] = r.k
    s = (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    for i in range(7):
        assert [got[i // 3, i % 3][n] for n in range(1, 11)] == np.argsort(-s[i], kind="stable")[:10].tolist()
    score = {}
    for (a, _), d in got.items():
        for n, k in d.items():
            score[a, k] = score.get((a, k), 0) + 1 / (60 + n)
    fused = retrieval.fuse(lists, "k").collect()
    for r in fused:
        assert abs(r.rrf_score - score[r.query_id, r.k]) < 1e-6
    assert retrieval.search(ix, qs.limit(0), "k", "vector").count() == 0


@pytest.mark.parametrize("tokens,want", [([3000, 2000, 500, 600], [True, False, True, False]), ([9000, 1], [True, False]), ([], [])])
def test_budget(spark, tokens, want):
    df = spark.createDataFrame([(tokens,)], "t array<int>")
    assert df.select(retrieval.within_budget(F.col("t"))).first()[0] == want


def pool_walk(close, alike, place, legacy):
    """Pairs in order, item by item."""
    gone, won, apart = set(), [], []
    for i in range(len(place)):
        if i in gone:
            continue
        for j in range(i + 1, len(place)):
            if j in gone or not close[i][j]:
                continue
            if not alike[i][j]:
                apart.append((i, j))
            elif place[j] < place[i]:
                gone.add(i)
                won.append((j, i))
                if not legacy:
                    break
            else:
                gone.add(j)
                won.append((i, j))
    return [k for k in range(len(place)) if k not in gone], won, apart


@pytest.mark.parametrize("legacy", [False, True])
def test_collapse_equals_walk(legacy):
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(0, 9))
        close, alike, place = rng.random((n, n)) < 0.5, rng.random((n, n)) < 0.7, rng.integers(0, 3, n)
        stays, won, apart = retrieval.collapse(close, alike, place, legacy)
        want = pool_walk(close, alike, place, legacy)
        assert (np.flatnonzero(stays).tolist(), won, apart) == want or legacy and (sorted(set(won)), apart) == (sorted(set(want[1])), want[2])


def test_pool_and_mmr(spark):
    v = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0], None]
    rows = [("q", i, i, 9 - i, v[i], "b", "A", None, f"d{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "query_id string, k long, rrf_rank int, authority int, vector array<double>, text_layer string, source_act string, amends_section string, doc string")
    got = {(r.k, r.outcome, r.other) for r in retrieval.dedup_pool(df, "k", 0.9).collect()}
    assert got == {(1, "kept", None), (2, "kept", None), (3, "kept", None), (0, "collapsed", 1)}
    other = df.withColumn("source_act", F.when(F.col("k") != 1, F.col("source_act")))
    assert {(r.k, r.outcome) for r in retrieval.dedup_pool(other, "k", 0.9).collect()} == {(0, "kept"), (1, "kept"), (2, "kept"), (3, "kept"), (1, "guarded")}
    assert retrieval.dedup_pool(df.where("false"), "k", 0.9).count() == 0
    x, _ = retrieval._units(v[:3])
    assert retrieval.mmr_order(np.array([1.0, 1.0, 1.0]), x @ x.T) == [0, 2, 1] and retrieval.mmr_order(np.array([1.0, 0.9, 0.1]), x @ x.T) == [0, 1, 2]
    top = df.withColumn("final_rank", F.col("rrf_rank") + 1).withColumn("rerank_score", F.lit(1.0)).withColumn("multi_aspect", F.lit(True))
    got = retrieval.diversify(top, "k").collect()
    assert [r.k for r in sorted(got, key=lambda r: r.mmr_rank)] == [0, 1, 2, 3] and {r.mmr_skipped for r in got} == {"mmr_vectors_unavailable"}
    assert [r.k for r in sorted(retrieval.diversify(top.where("k < 3"), "k").collect(), key=lambda r: r.mmr_rank)] == [0, 2, 1]


CONTEXT = "query_id string, k long, text_layer string, section_number string, amends_section string, final_rank int, parent_id string, legal_status string"


def test_overlays_and_parents(spark):
    ctx = spark.createDataFrame([("q", 1, "consolidated_base", "17", None, 1, "p1", None), ("q", 2, "amendment_overlay", None, "307A;17", 2, "p2", "Ratified"), ("q", 3, "amendment_overlay", None, "*", 3, None, None), ("r", 4, "consolidated_base", "17", None, 1, "p9", None), ("q", 5, "amendment_overlay", "3", "17", 5, None, "ratified")], CONTEXT)
    got = {r.k: (r.notes, r.text_label) for r in retrieval.with_overlays(ctx, "k").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: ["amended by 2", "amended by 5"], 2: ["amends 1"], 3: [], 4: [], 5: ["amends 1"]}
    assert got[1][1] == "[earlier text — amended by a later Act]" and got[2][1] == "[current text — enacted amendment]" and got[3][1] == ""
    store = spark.createDataFrame([("p1", "prose", "a " * 3000, None), ("p2", "table", None, "x" * 2000)], "parent_id string, kind string, text string, table_json string")
    assert {r.k: r.label for r in retrieval.resolve(ctx, "k", store).collect()} == {1: "section", 2: "truncated", 3: "missing_parent", 4: "missing_parent", 5: "missing_parent"}


def test_same_provision(spark):
    rows = [(1, "consolidated_base", "17", None, "A · Section 17"), (2, "amendment_overlay", "3", "17; 61A", "B · Section 3"), (3, "consolidated_base", None, None, "Chapter A - (17)"), (4, None, None, None, "a · 17"), (5, "consolidated_base", "3", None, ""), (6, "amendment_overlay", None, "*", None)]
    df = spark.createDataFrame(rows, "k int, text_layer string, section_number string, amends_section string, section_path string")
    x, y = df.alias("x"), df.alias("y")
    side = lambda n: lambda c: F.col(f"{n}.{c}")
    got = {(r[0], r[1]) for r in x.join(y, F.col("x.k") < F.col("y.k")).where(retrieval.same_provision(side("x"), side("y"))).select("x.k", "y.k").collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (3, 4)}
    n = {r.k: r.n_links for r in retrieval.provision_links(df, "k").collect()}
    assert n == {1: 0, 2: 0, 3: 2, 4: 2, 5: 0, 6: 0} or n == {1: 2, 2: 0, 3: 2, 4: 2, 5: 0, 6: 0}


def test_expansion_and_models(spark):
    from chunkwell.operators import models

    q = spark.createDataFrame([("a", "one"), ("b", "boom"), ("c", "blank"), ("d", "bad"), ("e", None)], "query_id string, text string")

    def load():
        return lambda prompts: ['{"variants": ["v1", "v2", "v3", "v4"], "multi_aspect": true}' if p.endswith("one") else "" if p.endswith("blank") else "[1]" for p in prompts]

    reply = models.replier(load)(models.prompt(F.col("text")))
    got = {r.query_id: r for r in retrieval.expand(q, "text", reply).collect()}
    assert got["a"].variants == ["v1", "v2", "v3"] and got["a"].multi_aspect and got["a"].fallback is None
    assert {k: r.fallback for k, r in got.items() if k in "cd"} == {"c": "no_model_output", "d": "malformed_json"} and got["d"].variants == ["bad"] and got["e"].original == ""
    assert {r.fallback for r in retrieval.expand(q, "text").collect()} == {"llm_skipped_by_caller"}

    def broken():
        raise OSError("no model here")

    assert {r.fallback for r in retrieval.expand(q, "text", models.replier(broken)(F.col("text"))).collect()} == {"llm_unavailable"}
    assert {r[0] for r in q.select(models.embed(F.col("text"), load=broken)).collect()} == {None}
    v = q.select(models.embed(F.col("text"), 8).alias("v")).collect()
    assert len(v[0].v) == 8 and abs(sum(x * x for x in v[0].v) - 1) < 1e-6 and v[4].v == [0.0] * 8
    scored = q.select(models.pair_scorer(lambda: lambda a, b: [len(x) for x in a])(F.col("text"), F.col("text")).alias("s"))
    assert [r.s for r in scored.collect()] == [3, 4, 5, 3, 0]


def run_stages(spark, **how):
    from chunkwell.operators import models

    words = ["wage", "leave", "notice", "safety", "bonus"]
    rows = [(i, f"d{i % 3}", f"{words[i % 5]} rule {words[(i + 1) % 5]} {i}", f"p{i % 4}", ["consolidated_base", "amendment_overlay"][i % 2], "ratified" if i % 7 else "superseded", "A", str(i % 3), str(i % 3), i % 5 != 0, "official_gazette") for i in range(40)]
    ix = spark.createDataFrame(rows, "k long, doc string, text string, parent_id string, text_layer string, legal_status string, source_act string, section_number string, amends_section string, in_force boolean, authority_rank string").withColumn("vector", models.embed(F.col("text")))
    q = spark.createDataFrame([("q1", "wage rule", '{"variants": ["wage rule", "leave"], "multi_aspect": true, "historical": true}'), ("q2", "notice", None), ("q3", None, None)], "query_id string, text string, reply string")
    store = spark.createDataFrame([("p0", "prose", "w " * 3500, None), ("p1", "self", "x", None)], "parent_id string, kind string, text string, table_json string")
    return retrieval.stages(ix, retrieval.expand(q, "text", F.col("reply")), store, models.embed, "k", **how)


def test_stages_and_trace(spark, tmp_path):
    done = run_stages(spark)
    sinks.write_traces(retrieval.trace(done, "k"), str(tmp_path / "traces"))
    assert sorted(p.name for p in (tmp_path / "traces").glob("query_id=*")) == ["query_id=q1", "query_id=q2", "query_id=q3"]
    t = {r.query_id: r for r in retrieval.trace(done, "k").collect()}
    assert t["q1"].ok and t["q1"].flags.historical and len(t["q1"].final_context) == 5 and t["q1"].stages["5b"].note == "applied" and not t["q1"].stages["1"].fallbacks
    assert t["q2"].stages["1"].fallbacks == ["no_model_output"] and t["q2"].stages["5b"].note == "multi_aspect_not_flagged"
    assert set(t["q3"].stages) == set(retrieval.STAGES) and t["q3"].problems == ["empty context"]
    assert {"3:empty_fusion", "4:empty_fused_pool", "5:empty_deduped_pool"} <= set(t["q3"].overall_fallbacks)
    hidden = {r.k for r in done["2"].where("query_id = 'q2'").collect()}
    assert all(i % 5 and i % 7 for i in hidden) and {r.k for r in done["2"].where("query_id = 'q1'").collect()} - hidden
    off = run_stages(spark, score=None)
    assert {f for r in retrieval.trace(off, "k").collect() for f in r.stages["5"].fallbacks} == {"reranker_disabled", "empty_deduped_pool"}
    assert [r.rrf_rank for r in off["5"].where("query_id = 'q2'").orderBy("final_rank").collect()] == [1, 2, 3, 4, 5]


def test_measures(spark):
    ranked = spark.createDataFrame([("q", k, i) for i, k in enumerate("abcd", 1)], "query_id string, k string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "z"), ("r", "x")], "query_id string, k string")
    got = {r.query_id: (r.recall, r.rr, r.ndcg) for r in evaluation.measures(ranked, rel, "k").collect()}
    assert got["r"] == (0, 0, 0) and got["q"][:2] == (0.5, 0.5)


def test_pages_are_all_read(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join(f'{{"doc": "d", "page": {i}, "text": "t"}}' for i in range(1, 41)))
    assert corpus.pages(spark, str(tmp_path / "p.json")).count() == 40 and corpus.pages(spark, str(tmp_path / "p.json"), 30).count() == 30


def test_first_delivery(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", 1, "y"), (None, 5, "z"), ("b", 2, None)], "chunk_id string, seq long, text string")
    assert {tuple(r) for r in quality.delivered_once(df).collect()} == {("a", 1, "y"), (None, 5, "z"), ("b", 2, None)} and quality.delivered_once(df).count() == 3
    assert quality.delivered_once(df.where("false")).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "A b.TXT").write_bytes("héllo".encode() + b"\xff")
    (tmp_path / "docs" / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "docs" / "d.bin").write_bytes(b"")
    assert sorted(r.doc for r in corpus.files(spark, str(tmp_path / "docs")).collect()) == ["a_b", "c"]
    assert corpus.text_files(spark, str(tmp_path / "docs")).first().text == "héllo\ufffd"
    t = tmp_path / "tr" / "doc1"
    t.mkdir(parents=True)
    (t / "p001.txt").write_text("# head\nline\n\n  > q  ")
    s = corpus.transcripts(spark, str(tmp_path / "tr"))
    assert [tuple(r) for r in s.collect()] == [("doc1", 1, "line\n> q")]
    pages = spark.createDataFrame([("doc1", 1, "pdf", "prose"), ("doc1", 2, "pdf", "prose")], "doc string, page int, text string, label string")
    assert {r.page: (r.text, r.label, r.pdf_label) for r in corpus.with_transcripts(pages, s).collect()} == {1: ("line\n> q", "transcribed", "prose"), 2: ("pdf", "prose", "prose")}
    df = spark.createDataFrame([chunk(1), chunk(2, kind="front_matter")], CHUNK)
    m = sinks.write_index(df, str(tmp_path / "ix")).first()
    assert (m.children_in, m.indexed, m.excluded) == (2, 1, 1)
    assert sinks.artifacts({"prose_chunks": df}, str(tmp_path / "out")) == ["prose_chunks"]
    with pytest.raises(ValueError):
        sinks.artifacts({"other": df}, str(tmp_path / "out"))


def test_stream_counts_once(spark, tmp_path):
    from chunkwell.streaming import incremental

    df = spark.sql("select 'a' as chunk_id, timestamp'2036-01-01' as ingested_at, 'law' as source_type union all select 'a', timestamp'2036-01-05', 'law' union all select 'b', timestamp'2036-01-02', null")
    df.write.parquet(str(tmp_path / "in"))
    s = incremental.arrivals(spark, str(tmp_path / "in"), df.schema)
    incremental.run_once(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.chunk_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
