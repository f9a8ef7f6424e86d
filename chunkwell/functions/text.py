"""Scalar text functions as Column builders; nothing here leaves whole-stage code generation for Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits and clause letters of section numbers, ordinal schedules, topic vocabulary, masthead patterns, line marks.
BANGLA_DIGITS = "০১২৩৪৫৬৭৮৯"
CLAUSE_LETTERS = "কখগঘঙচ"
PRINCIPAL_ACT = "Bangladesh Labour Act, 2006"
ORDINALS = ["প্রথম", "দ্বিতীয়", "তৃতীয়", "চতুর্থ", "পঞ্চম", "ষষ্ঠ"]
TARGET_ACT = r"২০০৬\s*সনের\s*৪২\s*নং\s*আইন"
SECTION_LIST = r"ধারা\s+((?:[০-৯]{1,3}[ক-চ]?)(?:\s*(?:,|ও|এবং)\s*[০-৯]{1,3}[ক-চ]?)*)"
ONE_SECTION = r"([০-৯]{1,3}[ক-চ]?)"
WORDS_EVERYWHERE = r"কতিপয়\s*শব্দের\s*সংশোধন"
TOPICS = {
    "termination": ["termination", "dismiss", "discharge", "retrench"],
    "notice_period": ["notice of", "notice period", "one hundred and twenty day"],
    "wages": ["wage", "wages", "remuneration", "payable"],
    "overtime": ["overtime", "over-time"],
    "maternity": ["maternity", "pregnan", "expectant"],
    "leave": ["leave with wages", "casual leave", "annual leave", "sick leave", "earned leave"],
    "working_hours": ["working hour", "hours of work", "spread-over", "interval for rest"],
    "safety": ["safety", "dangerous", "fencing", "explosive"],
    "welfare": ["welfare", "canteen", "washing", "first-aid"],
    "child_labour": ["child", "adolescent", "young person"],
    "trade_union": ["trade union", "collective bargaining", "participation committee"],
    "apprentice": ["apprentice", "apprenticeship"],
}
MASTHEAD = (
    r"(?i)translated\s+from|registered\s+no|gazette|published\s+by\s+the\s+authority|ministry\s+of|dated\s*:|bengali\s+year"
    r"|people['’]?s\s+republic|additional\s+issue|extraordinary|\bs\.?\s?r\.?\s?o\.?\b|(mon|tues|wednes|thurs|fri|satur|sun)day\b"
)
MASTHEAD_STRONG = r"(?i)registered\s+no|published\s+by\s+the\s+authority|translated\s+from|gazette\s+notification|people['’]?s\s+republic"
INSTRUMENT = r"(?i)gazette|rules|act\b|ordinance|order\b|notification|s\.?r\.?o\.?"
FIELDS = {
    "registration_no": r"(?i)Registered\s+No\.?\s*([A-Za-z]+\s*-\s*\S+|\S+)",
    "gazette_name": r"(?i)(The\s+Bangladesh\s+Gazette[^.\n]*?)(?=\s+Published\b|\.|\s*$)",
    "title_line": r"(?i)((?:The\s+)?Bangladesh\s+(?:Labour\s+)?(?:Rules|Act|Ordinance)[^.\n]{0,60})",
    "publication_date": r"((?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)[^,\n]*,\s*[A-Za-z]+\s+\d{1,2},\s*\d{4})",
    "issuing_authority": r"(?i)(Ministry\s+of[^\n.]*)",
    "dated_reference": r"(?i)Dated\s*:\s*(.+)",
}
AUTHORITY = ["official_gazette", "official_translation", "unofficial_translation", "reputable_secondary", "advocacy_report"]


def normalize(t: Column) -> Column:
    """White space runs become one blank, ends trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", " "))


def ascii_digits(t: Column) -> Column:
    return F.translate(t, BANGLA_DIGITS, "0123456789")


def word_count(t: Column) -> Column:
    n = normalize(t)
    return F.when(n == "", 0).otherwise(F.size(F.split(n, " ")))


def estimate_tokens(t: Column) -> Column:
    """1.3 times the words, half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(word_count(t) * F.lit(1.3), 0).cast("int"))


def preview(t: Column, limit: int = 280) -> Column:
    n = normalize(t)
    return F.when(F.length(n) > limit, F.concat(F.substring(n, 1, limit), F.lit(" ..."))).otherwise(n)


def doc_slug(path: Column) -> Column:
    name = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def sequential_id(prefix: str, number: Column) -> Column:
    """Prefix and at least four digits; larger numbers widen."""
    return F.format_string(prefix + "%04d", number)


def content_id(prefix: str, *cols: Column) -> Column:
    """The identifier for scale: no global order is needed."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])), 1, 16))


def coerce_cell(v: Column) -> Column:
    """A cell as struct<i, d, s>: whole number, decimal number, or text."""
    n = ascii_digits(normalize(v))
    whole, dec = n.rlike(r"^-?[0-9][0-9,]*$"), n.rlike(r"^-?[0-9]+\.[0-9]+$")
    return F.struct(
        F.when(whole, F.regexp_replace(n, ",", "").try_cast("bigint")).alias("i"),
        F.when(dec, n.try_cast("double")).alias("d"),
        F.when(~whole & ~dec, normalize(v)).alias("s"),
    )


def section_id(bn: Column) -> Column:
    """Bangla digits with an optional letter as ASCII, the letter as A to F; null for anything else."""
    num = F.regexp_extract(F.trim(bn), r"^([০-৯]{1,3})([ক-চ]?)$", 1)
    letter = F.regexp_extract(F.trim(bn), r"^([০-৯]{1,3})([ক-চ]?)$", 2)
    return F.when(num != "", F.concat(ascii_digits(num).cast("int").cast("string"), F.translate(letter, CLAUSE_LETTERS, "ABCDEF")))


def amended_provisions(title: Column) -> Column:
    """Section identifiers that a heading of the amending instrument names; whole act as '*', schedules as schedule_n."""
    t = F.coalesce(title, F.lit(""))
    none = F.array().cast("array<string>")
    ordinal = F.regexp_extract(t, "(" + "|".join(ORDINALS) + r")\s*তফসিল", 1)
    number = reduce(lambda acc, kv: F.when(ordinal == kv[1], kv[0] + 1).otherwise(acc), list(enumerate(ORDINALS)), F.lit(0))
    rest = F.regexp_replace(t, TARGET_ACT, "")
    listed = F.regexp_extract(rest, SECTION_LIST, 1)
    ids = F.transform(F.regexp_extract_all(listed, F.lit(ONE_SECTION), 1), section_id)
    return (
        F.when(~t.rlike(TARGET_ACT), none)
        .when(t.rlike(WORDS_EVERYWHERE), F.array(F.lit("*")))
        .when(ordinal != "", F.array(F.concat(F.lit("schedule_"), number.cast("string"))))
        .when(listed != "", ids)
        .otherwise(none)
    )


def amends_field(title: Column) -> Column:
    return F.nullif(F.array_join(amended_provisions(title), ";"), F.lit(""))


def topic_tags(text: Column, cap: int = 3) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    tags = [F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), F.lit(tag)) for tag, words in TOPICS.items()]
    return F.slice(F.filter(F.array(*tags), lambda x: x.isNotNull()), 1, cap)


def text_hash(t: Column) -> Column:
    return F.sha1(F.lower(normalize(t)))


def spelled(c: Column) -> Column:
    """A vocabulary value in its usual spelling: lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.trim(F.lower(c)), r"[\s_\-]+", "_")


def authority_order(c: Column) -> Column:
    """Place in the order of authority, 9 when unknown or missing."""
    out = F.lit(9)
    for i, v in reversed(list(enumerate(AUTHORITY))):
        out = F.when(spelled(c) == v, i).otherwise(out)
    return out


def bangla_share(t: Column) -> Column:
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(t, F.lit(r"[\x{0980}-\x{09FF}&&[\p{L}]]")) / letters).otherwise(F.lit(0.0))


def is_bangla(t: Column, share: float = 0.3) -> Column:
    return bangla_share(F.coalesce(t, F.lit(""))) >= share


def looks_bangla(t: Column) -> Column:
    return F.coalesce(t, F.lit("")).rlike(r"[\x{0980}-\x{09FF}]")


def is_masthead(line: Column, in_run: Column) -> Column:
    upper = (F.upper(line) == line) & line.rlike(r"\p{L}")
    return line.rlike(MASTHEAD) | (in_run & upper & (F.length(line) <= 90) & line.rlike(INSTRUMENT))


def masthead_fields(t: Column) -> Column:
    """Six identity fields of a masthead, null where absent."""
    out = []
    for name, pattern in FIELDS.items():
        v = F.regexp_extract(F.coalesce(t, F.lit("")), pattern, 1)
        v = F.regexp_replace(F.regexp_replace(v, r"-\s+", "-"), r"\.+$", "") if name == "registration_no" else normalize(v)
        out.append(F.nullif(v, F.lit("")).alias(name))
    return F.struct(*out)


def section_number(marker: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(marker, F.lit("")), r"^([0-9]{1,3})", 1), F.lit(""))


def line_kind(line: Column) -> Column:
    """What a line begins: the first rule that holds."""
    rules = {
        "quote": r"^>",
        "table_row": r"^\|",
        "section": r"^(?:[০-৯]{1,3}।|[0-9]{1,3}+\.)",
        "subsection": r"^\((?:[০-৯]{1,2}[ক-হ]?|[0-9]{1,2})\)",
        "clause": r"^\((?:[অ-৥]{1,4}|[a-z]{1,2})\)",
        "chapter": r"^(?:PART|CHAPTER)\b",
        "proviso": r"^(?:Provided|তবে শর্ত)",
    }
    out = F.lit("text")
    for kind, pattern in reversed(list(rules.items())):
        out = F.when(line.rlike(pattern), kind).otherwise(out)
    return out


def line_mark(line: Column) -> Column:
    """The number or letter that a structural line begins with, in ASCII digits; empty where it has none."""
    m = F.regexp_extract(line, r"^\(?([০-৯0-9]{1,3}[ক-হ]?|[অ-৥]{1,4}|[a-z]{1,2})[।.)]", 1)
    return ascii_digits(m)


def section_path(doc: Column, chapter: Column, kind: Column, node: Column, marker: Column, page: Column) -> Column:
    """Chapter, section, sub-section and clause of a chunk, joined by a middle dot; coarse paths for tables, mastheads and parts."""
    node, marker = F.coalesce(node, F.lit("")), F.coalesce(marker, F.lit(""))
    chapter = F.trim(F.coalesce(chapter, F.lit("")))
    marks = F.regexp_extract_all(F.when(node.startswith(marker), F.substring(node, F.length(marker) + 1, F.length(node))).otherwise(""), F.lit(r"\(([^)]+)\)"), 1)
    named = F.transform(marks, lambda m: F.when(m.rlike(r"^\p{Nd}+$"), F.concat(F.lit("Sub-section ("), m, F.lit(")"))).when(m.rlike(r"^\p{L}+$"), F.concat(F.lit("Clause ("), m, F.lit(")"))).otherwise(m))
    head = F.when((chapter != "") & (chapter != doc), chapter)
    section = F.when(marker.rlike("^[0-9]{1,3}$"), F.concat(F.lit("Section "), marker))
    inner = node.startswith(marker) & node.contains("(")
    coarse = F.when(~inner & head.isNull() & section.isNull(), F.when(node == "", F.lit("unnumbered")).otherwise(node))
    body = (
        F.when(kind == "table", F.array(F.concat(F.lit("page "), F.coalesce(page.cast("string"), F.lit("None")), F.lit(" table "), node)))
        .when(kind == "front_matter", F.array(F.lit("front matter")))
        .when(node.rlike("^part[0-9]+$"), F.array(F.concat(F.lit("prose part "), F.replace(node, F.lit("part"), F.lit("")))))
        .otherwise(F.concat(F.array(section, coarse), F.when(inner, named).otherwise(F.array().cast("array<string>"))))
    )
    return F.array_join(F.filter(F.concat(F.array(head), body), lambda x: x.isNotNull() & (x != "")), " · ")


def embed_prefix(act: Column, doc: Column, chapter: Column, path: Column, title: Column, kind: Column, amends: Column, principal: str = PRINCIPAL_ACT) -> Column:
    """What is put before a chunk's text when it is embedded: act, chapter, path, heading of a leaf, provisions amended; each once."""
    chapter = F.trim(F.coalesce(chapter, F.lit("")))
    parts = F.concat(
        F.array(F.coalesce(F.nullif(act, F.lit("")), doc), F.when(chapter != doc, chapter)),
        F.split(F.coalesce(path, F.lit("")), " · "),
        F.array(F.when(kind == "leaf", title), F.when(F.coalesce(amends, F.lit("")) != "", F.concat(F.lit(f"amends {principal} section "), F.replace(amends, F.lit(";"), F.lit(", "))))),
    )
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (x != ""))), " · ")


def embed_text(prefix: Column, text: Column) -> Column:
    return F.concat_ws(" — ", F.nullif(prefix, F.lit("")), F.coalesce(text, F.lit("")))


def flat_metadata(df, cols: list[str]) -> list[Column]:
    """Scalars only: null as '', lists joined by '; ', whole numbers -1 when missing."""
    kinds = dict(df.dtypes)
    out = []
    for c in cols:
        k = kinds[c]
        v = F.coalesce(F.array_join(c, "; "), F.lit("")) if k.startswith("array") else F.coalesce(F.col(c), F.lit(-1)) if k in ("int", "bigint") else F.coalesce(F.col(c).cast("string"), F.lit(""))
        out.append(v.alias(c))
    return out


def unflat_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def unflat_int(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(-1))


def unflat_bool(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin("true", "1", "yes")


def envelope(reply: Column, original: Column, most: int = 3) -> Column:
    """A model's JSON reply as struct<original, variants, multi_aspect, historical, degraded>; strict booleans.

    Anything but an object with at least one usable variant degrades to the original query alone.
    """
    v = F.try_parse_json(reply)
    many = F.try_variant_get(v, "$.variants", "array<string>")
    one = F.try_variant_get(v, "$.variants", "string")
    got = F.filter(F.transform(F.slice(F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>")), 1, most), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & (F.size(got) > 0)
    flag = lambda k: ok & F.coalesce(F.try_variant_get(v, f"$.{k}", "boolean"), F.lit(False))
    return F.struct(original.alias("original"), F.when(ok, got).otherwise(F.array(original)).alias("variants"), flag("multi_aspect").alias("multi_aspect"), flag("historical").alias("historical"), (~ok).alias("degraded"))


def cosine(a: Column, b: Column) -> Column:
    """Of two float arrays; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def content_tokens(kind: Column, text: Column, table_json: Column) -> Column:
    """Tokens of a parent: of its text, or a quarter of the characters of its JSON."""
    return F.when(kind == "table", F.greatest(F.lit(1), F.bround(F.length(F.coalesce(table_json, F.lit(""))) / 4.0, 0).cast("int"))).otherwise(estimate_tokens(text))


def parent_content(kind: Column, text: Column, table_json: Column) -> Column:
    return F.when(kind == "table", F.coalesce(table_json, F.lit(""))).otherwise(F.coalesce(text, F.lit("")))
