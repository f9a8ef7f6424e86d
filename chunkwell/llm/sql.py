"""SQL that checks the queries which SQL can express.

Comparisons of texts need no reading of words in their own script: a skeleton, in which every look-alike letter is the Latin one, is equal
where the one form is. It is made by the rules of the Unicode character database and the lists of look-alike letters.
"""

from __future__ import annotations

from chunkwell.llm import lookalike as L

SPACE = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

P2_FOUND = rf"""SELECT DISTINCT chunk_id FROM prose_chunks, size_limits WHERE limit_name = 'chunk_cap'
AND greatest(1, CAST(round_even(len(list_filter(regexp_split_to_array(text, '[{SPACE}\x1c-\x1f]+'), lambda w: w <> '')) * 1.3, 0) AS INT)) > max_size"""

P3_FOUND = rf"""WITH c AS (SELECT DISTINCT chunk_id, doc, page, string_split(text, chr(10)) AS a FROM prose_chunks WHERE text IS NOT NULL),
l AS (SELECT chunk_id, doc, page, CAST(unnest(range(1, len(a) + 1)) AS INT) AS line_no, unnest(a) AS line FROM c),
n AS (SELECT *, regexp_replace(lower(line), '[{SPACE}\pN\pP\pS]+', '', 'g') AS k FROM l WHERE regexp_matches(line, '[^{SPACE}]')),
p AS (SELECT doc, count(DISTINCT page) AS np FROM prose_chunks GROUP BY doc),
f AS (SELECT doc, k, count(DISTINCT page) AS m FROM n GROUP BY doc, k)
SELECT DISTINCT n.chunk_id, n.line_no FROM n JOIN f USING (doc, k) JOIN p USING (doc) WHERE m >= 5 AND m * 5 >= np"""

P3_CLEANED = f"""WITH g AS (SELECT chunk_id, list(line_no) AS gone FROM ({P3_FOUND}) GROUP BY 1)
SELECT DISTINCT chunk_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, CAST(i AS INT))), chr(10)) END AS cleaned FROM prose_chunks LEFT JOIN g USING (chunk_id)"""


def skeleton(x: str) -> str:
    pairs = {chr(o): v for o, v in L._rules()["single"].items() if o < 0x10000 and len(v) == 1} | dict(zip(L.CYRILLIC + L.GREEK + L.OTHER, L.CYRILLIC_AS + L.GREEK_AS + L.OTHER_AS, strict=True))
    gone = "".join(f"\\x{{{ord(c):x}}}" for c in L.IGNORABLE + "\u200c\u200d")
    for a, b in (L.SEQUENCES | {c: L._rules()["single"][ord(c)] for c in "ﬀﬁﬂﬃﬄﬅﬆ"}).items():
        x = f"replace({x}, '{a}', '{b}')"
    to = "".join(pairs.values()).replace("'", "''")
    return f"nfc_normalize(translate(regexp_replace({x}, '[{gone}]', '', 'g'), '{''.join(pairs)}', '{to}'))"


_split = lambda x: f"list_filter(regexp_split_to_array({x}, '[{SPACE}\x1c-\x1f]+'), lambda w: w <> '')"
_bare = lambda x: f"list_filter(list_transform({_split(f'lower({x})')}, lambda w: regexp_replace(w, '[\\pP\\pS]+', '', 'g')), lambda w: w <> '')"

PAIRS = f"""c AS (SELECT DISTINCT chunk_id, source_act, section_number, text, {skeleton("text")} AS t FROM prose_chunks WHERE text IS NOT NULL),
w AS (SELECT chunk_id, coalesce('v' || source_act, 'n') || '/' || coalesce('v' || section_number, 'n') AS g, {_bare("t")} AS w FROM c WHERE len({_split("t")}) >= 40),
r AS (SELECT DISTINCT chunk_id, g, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS r FROM w), n AS (SELECT chunk_id, count(*) AS n FROM r GROUP BY 1),
s AS (SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS both_ FROM r x JOIN r y ON x.g = y.g AND x.r = y.r AND x.chunk_id < y.chunk_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM s JOIN n p ON p.chunk_id = a JOIN n q ON q.chunk_id = b WHERE both_ >= 0.6 * (p.n + q.n - both_))"""
P4_FOUND = f"WITH {PAIRS} SELECT a AS chunk_id_a, b AS chunk_id_b FROM pairs"

_plain = lambda c: rf"regexp_replace(trim(lower({c})), '[\s_\-]+', '_', 'g')"
_place = lambda c, order: "CASE " + " ".join(f"WHEN {_plain(c)} = '{v}' THEN {i}" for i, vs in enumerate(order) for v in vs) + f" ELSE {len(order)} END"
P5_FOUND = f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT x, x AS y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
g AS (SELECT x AS chunk_id, min(y) AS g FROM reach GROUP BY x), m AS (SELECT g.g, p.*, row_number() OVER (PARTITION BY g.g ORDER BY
{_place("authority_rank", [["official_gazette"], ["official_translation"], ["unofficial_translation"], ["reputable_secondary"], ["advocacy_report"]])}, {_place("legal_status", [["ratified"], ["pending_ratification"], ["unverified"], ["superseded"]])},
{_place("translation_status", [["original_bangla", "original_english"], ["official_english"], ["unofficial"]])}, length(text) DESC, p.chunk_id) AS k FROM g JOIN prose_chunks p USING (chunk_id)) SELECT DISTINCT chunk_id FROM m WHERE k = 1"""

_DIGITS = "".join(map(chr, (o for o in range(0x80, 0x10000) if chr(o).isdecimal())))
_TO = "".join(str(int(c)) for c in _DIGITS)
_words = lambda x: _bare(f"translate({skeleton(x)}, '{_DIGITS}', '{_TO}')")
_runs = lambda table, key: f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS r FROM (SELECT {key}, {_words('text')} AS w FROM {table} WHERE text IS NOT NULL)"
P9_FOUND = f"SELECT DISTINCT doc_id, item_id FROM ({_runs('documents', 'doc_id')}) d JOIN ({_runs('eval_passages', 'item_id')}) p USING (r)"
