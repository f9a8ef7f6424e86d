"""Problems 1, 2, 3, 6, 7: round trips, brute force, edge cases."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwell.llm import furniture, lookalike, mojibake, segment, sentences

BN = "শ্রমিকের মৃত্যু হইলে মজুরি প্রদান করিবেন।"
EN = "The crèche attendant’s résumé — “kept” for review."
READER = lookalike.Reader(lookalike.bigram_scores(np.zeros((lookalike.SIZE, lookalike.SIZE))))


@pytest.mark.parametrize("enc", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251"])
@pytest.mark.parametrize("text", [BN, EN, "工资委员会必须登记。", "اجرت بورڈ رسید نمبر"])
def test_garbled_round_trip(enc, text):
    table = {b: c for c, b in mojibake._single_map(enc).items()} | {b: chr(b) for b in range(128)}
    wrong = "".join(table[b] for b in text.encode())
    assert mojibake.restore(f"Before {wrong}") == (f"Before {text}", mojibake.restore(wrong)[1], True)


def test_garbled_twice_and_lost():
    once = EN.encode().decode("cp1252", "replace")
    assert mojibake.restore("résumé".encode().decode("cp1252").encode().decode("cp1252"))[0] == "résumé"
    new, n, whole = mojibake.restore(once)
    assert n and not whole and "résumé" in new
    assert mojibake.restore("the labour attach茅 shall")[0] == "the labour attaché shall"


def test_garbled_many_times():
    t = "café"
    for _ in range(6):
        t = t.encode().decode("latin-1")
    assert mojibake.restore(t)[0] == "café" and mojibake.restore(t)[2]


def test_double_byte_state():
    common = [bytes([a, b]).decode("gb2312") for a in range(0xB0, 0xD7) for b in range(0xA1, 0xFF)]
    rnd = random.Random(1)
    for _ in range(1500):
        w = rnd.choice(common) + rnd.choice(common)
        try:
            wrong = w.encode().decode("gbk")
        except UnicodeDecodeError:
            continue
        assert mojibake.restore(wrong)[0] == w
        assert mojibake.restore("必须" + wrong + "登记")[0] == "必须" + w + "登记"
    assert mojibake.restore("宸ヨ祫") == ("工资", 3, True)  # with kana
    assert mojibake.restore("必须鍔冲姩登记") == ("必须劳动登记", 3, True)
    assert mojibake.restore("鈥淎sk the clerk鈥檚 desk")[0] == "“Ask the clerk’s desk"
    for _ in range(500):
        clean = "".join(rnd.choice(common) for _ in range(12))
        assert mojibake.restore(clean)[1] == 0
    assert mojibake.restore("dеаrnеѕѕ bеѕіdе")[1] == 0  # Cyrillic look-alikes


def test_clean_text_stays():
    for t in [BN, EN, "São Pellê keeps columns Â, Ê and Î under Ünter-Ålda", "the words договор and фабрика", "每名承包人必须明确登记", "λόγος", "", None]:
        assert mojibake.restore(t) == (t, 0, True)


def test_garbled_frame(spark):
    df = spark.createDataFrame([("a", "rÃ©sumÃ©", 1), ("a", "rÃ©sumÃ©", 1), ("b", None, 2), ("c", "", 3), ("d", "plain", 4), ("e", "x" * 300_000 + " Ã© ", 5)], "chunk_id string, text string, restored int")
    got = sorted(tuple(r) for r in mojibake.garbled(df, "chunk_id", "text").select("chunk_id", "n_garbled").collect())
    assert got == [("a", 4), ("a", 4), ("e", 2)]
    assert mojibake.garbled(df.limit(0), "chunk_id", "text").count() == 0


def test_pieces_cover_fit_and_overlap():
    rnd = random.Random(3)
    for n in (260, 300, 700, 2000):
        words = [rnd.choice(["alpha", "beta", "gamma.", "delta;", "No.", "(a)"]) + ("\n" if rnd.random() < 0.05 else "") for _ in range(n)]
        text = " ".join(words)
        got = segment.pieces(text, "12", 350, 0.15)
        assert got[0][0] == 0 and got[-1][1] == len(text)
        for (a, b, k), (c, d, m) in zip(got, got[1:], strict=False):
            assert a < c <= b < d
            assert len(text[c:b].split()) == max(1, round(0.15 * k))
        assert all(max(1, round(1.3 * len(text[a:b].split()))) <= 350 for a, b, _ in got)


@pytest.mark.parametrize(
    "text,want",
    [("рaботa", "работа"), ("договор рaбочий", "договор рабочий"), ("Мoсква", "Москва"), ("νόμoς", "νόμος"), ("wаge dеаrnеѕѕ", "wage dearness"), ("the сор", "the cop"), ("дaл слово", "дал слово")],
)
def test_words_get_their_own_script(text, want):
    assert READER.form(text) == want and READER.form(want) == want


def test_bigrams(spark):
    texts = ["Ab ba", "ab", "аб вб", "aб", "ba", None, ""]  # the fourth mixes scripts
    got = lookalike.bigrams(spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1), "t")
    n = np.zeros((lookalike.SIZE, lookalike.SIZE))
    for w in ["ab", "ba", "ab", "аб", "вб", "ba"]:
        k = [0, *(lookalike.LETTERS[c] for c in w), 0]
        for a, b in zip(k, k[1:], strict=False):
            n[a, b] += 1
    assert np.allclose(got, lookalike.bigram_scores(n))


def test_split_frame(spark):
    df = spark.createDataFrame([("a", "w " * 400, "1", "x"), ("b", "", "1", "x"), ("c", None, None, "x"), ("d", "short", None, "x"), ("e", "z" * 5000, None, "x")], "id string, t string, node string, piece string")
    got = segment.split_oversized(df, "id", "t", "node", 350, 0.15).groupBy("id").count().collect()
    assert dict(got) == {"a": 2, "b": 1, "d": 1, "e": 1}
    assert segment.split_oversized(df.limit(0), "id", "t", "node", 350, 0.15).count() == 0


def brute_lines(rows):
    def norm(x):
        return "".join(c for c in x.lower() if not c.isspace() and unicodedata.category(c)[0] not in "PSN")

    pages, all_, occ = {}, {}, {}
    for k, doc, page, text in rows:
        if page is not None:
            all_.setdefault(doc, set()).add(page)
        for i, line in enumerate((text or "").split("\n"), 1):
            if line.strip():
                occ.setdefault((doc, norm(line)), set()).add((k, i))
                if page is not None:
                    pages.setdefault((doc, norm(line)), set()).add(page)
    return {o for g, p in pages.items() if len(p) >= 5 and len(p) >= 0.2 * len(all_[g[0]]) for o in occ[g]}


def test_recurring_lines(spark):
    rnd = random.Random(1)
    rows = [(f"k{i}", rnd.choice("AB"), rnd.choice([None, *range(12)]), "\n".join(rnd.choice(["Page 1", "page 2!", "Printed, by X", " ", "- 3 -", "44", f"body {i} {rnd.random()}", f"text {chr(97 + rnd.randrange(26))}"]) for _ in range(4))) for i in range(80)]
    rows += [("n", "A", 1, None), ("e", "A", 2, ""), rows[0]]
    df = spark.createDataFrame(rows, "k string, doc string, page int, text string")
    got = {tuple(r) for r in furniture.recurring_lines(df, "k", "doc", "page", "text").collect()}
    assert got == brute_lines(rows) and got
    cleaned = dict(furniture.without_lines(df, "k", "text", furniture.recurring_lines(df, "k", "doc", "page", "text")).distinct().collect())
    for k, _, _, t in rows:
        assert cleaned[k] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n"), 1) if (k, i) not in got))
    assert furniture.recurring_lines(df.limit(0), "k", "doc", "page", "text").count() == 0


def test_frequent_sequences_of_two(spark):
    rows = [(f"k{i}", "D", i, "Head\nbody %s\nFoot" % "abcdefghij"[i % 10]) for i in range(10)]
    p, _ = furniture.frequent_sequences(spark.createDataFrame(rows, "k string, doc string, page int, text string"), "k", "doc", "page", "text")
    assert sorted((len(r["items"]), r["support"]) for r in p.collect()) == [(1, 10), (1, 10), (1, 10), (2, 10), (2, 10), (2, 10), (3, 10)] or sorted(len(r["items"]) for r in p.collect()) == [1, 1, 2]


def test_frequent_sequences_of_any_length(spark):
    rnd = random.Random(7)
    rows = [(f"k{i}", "D", rnd.choice([None, *range(9)]), "\n".join(x for x in ["North", "East", "South", "West", "North", "Foot"] if rnd.random() < 0.9)) for i in range(25)]
    pages, all_ = {}, {p for _, _, p, _ in rows if p is not None}
    for _, _, p, t in rows:
        v = t.split("\n")
        for mask in range(1, 1 << len(v)):
            if p is not None:
                pages.setdefault(tuple(x for i, x in enumerate(v) if mask >> i & 1), set()).add(p)
    want = sorted((len(s), len(p)) for s, p in pages.items() if len(p) >= 5 and len(p) >= 0.2 * len(all_))
    df = spark.createDataFrame(rows, "k string, doc string, page int, text string")
    p, _ = furniture.frequent_sequences(df, "k", "doc", "page", "text")
    assert sorted((len(r["items"]), r["support"]) for r in p.collect()) == want and want[-1][0] == 6
    assert max(len(r["items"]) for r in furniture.frequent_sequences(df, "k", "doc", "page", "text", max_len=2)[0].collect()) == 2


def test_sentences():
    d = sentences.Divider((np.zeros((3, sentences.ROWS * sentences.BUCKETS), np.float32), sentences.length_scores(np.zeros((2, sentences.LENGTHS)))))

    def cut(t):
        e, s, out = d.ends(t), 0, []
        for x in e:
            out.append(t[s:x].strip())
            s = x
        return out

    assert cut("He paid Dr. Roe 4.50 per Sch. 3, e.g. twice. Then he left!") == ["He paid Dr. Roe 4.50 per Sch. 3, e.g. twice.", "Then he left!"]
    assert cut("The sign reads “Count twice.” and he may go.\nThe clerk wrote, “All is well.” A new day.") == ["The sign reads “Count twice.” and he may go.", "The clerk wrote, “All is well.”", "A new day."]
    assert cut("মালিক ড. রহমান মে. করিম লি. কর্তৃক দিবেন। শ্রমিক পাইবেন কি? হাঁ") == ["মালিক ড. রহমান মে. করিম লি. কর্তৃক দিবেন।", "শ্রমিক পাইবেন কি?", "হাঁ"]
    assert cut("雇主必须登记。学徒可以申请。") == ["雇主必须登记。", "学徒可以申请。"]
    assert cut("One line.Two lines follow:\n(a) first;\n(b) second") == ["One line.", "Two lines follow:\n(a) first;\n(b) second"]
    assert cut("") == [] and cut("  \n") == [] and cut("no mark") == ["no mark"]


def test_sentences_over_many_marks():
    stats = np.zeros((3, sentences.ROWS * sentences.BUCKETS), np.float32)
    stats[1] = -9.0  # nothing opens a sentence, so no closing quotation ends one
    d = sentences.Divider((stats, sentences.length_scores(np.zeros((2, sentences.LENGTHS)))))
    t = "the sign “go!” " * 900 + "stays. " + "x" * 500 + ". Next."
    assert d.ends(t) == [len(t) - 6, len(t)]


def test_length_scores():
    n = np.zeros((2, sentences.LENGTHS))
    n[0, 20], n[1, 1] = 1000, 1000
    got = sentences.length_scores(n)
    assert got[0, 20] == 0 and got[0, 20] > got[0, 15] and got[1, 1] == 0 and got[1, 2] < 0 and got.min() >= sentences.LENGTH_LEAST


def test_sentence_frame(spark):
    df = spark.createDataFrame([("a", "One. Two."), ("b", None), ("c", ""), ("d", "x. " * 5000)], "k string, text string")
    s = sentences.statistics(df, "text")
    got = dict(sentences.sentences(df, "k", "text", s).groupBy("k").count().collect())
    assert got["a"] == 2 and set(got) == {"a", "d"}
    assert sentences.sentences(df.limit(0), "k", "text", s).count() == 0


def test_forms():
    f = READER.form
    assert f("Ｔｈｅ ｑｕａｙ") == "The quay" and f("ofﬁce") == "office" and f("a b c") == "a b c"
    assert f("য়") == f("য়") and f("কো") == "কো" and f("é") == "é" and f("অা") == "আ"
    assert f("t​he s­hall﻿") == "the shall" and f("fire‐drill") == "fire-drill" and f("⼯⼈") == "工人"
    assert f("mοnth аnd ѕhаll") == "month and shall"
    for same in ["the words договор and фабрика, λόγος", "র‍্যাম্প নং.", "“quote” — dash…", "Schedule-ক", BN, "通告，写明：「工」"]:
        assert f(same) == unicodedata.normalize("NFC", same)


def test_changed_frame(spark):
    df = spark.createDataFrame([("a", "o​f"), ("b", "plain"), ("c", None), ("d", ""), ("e", "rÃ©sumÃ©​")], "rec string, text string")
    assert [tuple(r) for r in lookalike.changed(df, "rec", "text").collect()] == [("a", "of")]
    assert lookalike.changed(df.where(F.lit(False)), "rec", "text").count() == 0


def test_forms_of_garbled_texts(spark):
    df = spark.createDataFrame([("a", "o\u200bf"), ("b", "plain"), ("e", "rÃ©sumÃ©\u200b o\u200bf")], "rec string, text string")
    got = dict(lookalike.changed(df, "rec", "text", garbled=True).collect())
    assert set(got) == {"a", "e"} and got["e"].endswith(" of")
