"""Pieces of the SQL that checks the queries, written independently of the DataFrame code; the fixed patterns and words are repeated here."""

from __future__ import annotations

SPACE = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DIGITS = "০১২৩৪৫৬৭৮৯"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'), ' ')"


def words(x: str) -> str:
    return f"(CASE WHEN {norm(x)} = '' THEN 0 ELSE len(string_split({norm(x)}, ' ')) END)"


def tokens(x: str) -> str:
    return f"greatest(1, CAST(round_even(CAST({words(x)} AS DOUBLE) * 1.3, 0) AS INT))"


def spelled(x: str) -> str:
    return rf"regexp_replace(trim(lower({x})), '[\s_\-]+', '_', 'g')"


def authority(x: str) -> str:
    names = ["official_gazette", "official_translation", "unofficial_translation", "reputable_secondary", "advocacy_report"]
    return f"CASE {spelled(x)} " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names)) + " ELSE 9 END"


ONCE = "SELECT * FROM prose_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY seq) = 1"
APPLICABLE = f"coalesce(in_force, false) AND coalesce({spelled('legal_status')}, '') <> 'superseded'"
MASTHEAD = r"(?i)translated\s+from|registered\s+no|gazette|published\s+by\s+the\s+authority|ministry\s+of|dated\s*:|bengali\s+year|people[''’]?s\s+republic|additional\s+issue|extraordinary|\bs\.?\s?r\.?\s?o\.?\b|(mon|tues|wednes|thurs|fri|satur|sun)day\b"

SECTION_PATH = r"""array_to_string(list_filter(list_concat(
[CASE WHEN trim(coalesce(chapter, '')) NOT IN ('', doc) THEN trim(chapter) END],
CASE WHEN kind = 'table' THEN ['page ' || coalesce(CAST(page AS VARCHAR), 'None') || ' table ' || coalesce(node, '')]
WHEN kind = 'front_matter' THEN ['front matter']
WHEN regexp_matches(coalesce(node, ''), '^part[0-9]+$') THEN ['prose part ' || replace(node, 'part', '')]
WHEN starts_with(coalesce(node, ''), coalesce(section_marker, '')) AND contains(node, '(') THEN list_concat([CASE WHEN regexp_matches(section_marker, '^[0-9]{1,3}$') THEN 'Section ' || section_marker END],
list_transform(regexp_extract_all(substr(node, length(coalesce(section_marker, '')) + 1), '\(([^)]+)\)', 1), lambda m: CASE WHEN regexp_matches(m, '^\p{Nd}+$') THEN 'Sub-section (' || m || ')' WHEN regexp_matches(m, '^\pL+$') THEN 'Clause (' || m || ')' ELSE m END))
WHEN regexp_matches(coalesce(section_marker, ''), '^[0-9]{1,3}$') THEN ['Section ' || section_marker]
WHEN trim(coalesce(chapter, '')) NOT IN ('', doc) THEN []
ELSE [CASE WHEN coalesce(node, '') = '' THEN 'unnumbered' ELSE node END] END), lambda x: x IS NOT NULL AND x <> ''), ' · ')"""

EMBED_PREFIX = """(SELECT string_agg(x, ' · ' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT list_concat(
[coalesce(nullif(source_act, ''), doc), CASE WHEN trim(coalesce(chapter, '')) <> doc THEN trim(coalesce(chapter, '')) END], string_split(coalesce(section_path, ''), ' · '),
[CASE WHEN kind = 'leaf' THEN section_title END, CASE WHEN coalesce(amends_section, '') <> '' THEN 'amends Bangladesh Labour Act, 2006 section ' || replace(amends_section, ';', ', ') END]) AS l)) WHERE x IS NOT NULL AND x <> '' GROUP BY x))"""

LINES = rf"""l0 AS (SELECT doc, seq AS page, string_split(text, chr(10)) AS a FROM ({ONCE}) WHERE text IS NOT NULL),
l1 AS (SELECT doc, page, CAST(unnest(range(len(a))) AS INT) AS line_no, trim(unnest(a), ' ') AS line FROM l0),
l2 AS (SELECT *, CASE WHEN regexp_matches(line, '^>') THEN 'quote' WHEN regexp_matches(line, '^\|') THEN 'table_row' WHEN regexp_matches(line, '^(?:[০-৯]{{1,3}}।|[0-9]{{1,3}}\.)') THEN 'section'
WHEN regexp_matches(line, '^\((?:[০-৯]{{1,2}}[ক-হ]?|[0-9]{{1,2}})\)') THEN 'subsection' WHEN regexp_matches(line, '^\((?:[অ-৥]{{1,4}}|[a-z]{{1,2}})\)') THEN 'clause'
WHEN regexp_matches(line, '^(?:PART|CHAPTER)\b') THEN 'chapter' WHEN regexp_matches(line, '^(?:Provided|তবে শর্ত)') THEN 'proviso' ELSE 'text' END AS kind,
translate(regexp_extract(line, '^\(?([০-৯0-9]{{1,3}}[ক-হ]?|[অ-৥]{{1,4}}|[a-z]{{1,2}})[।.)]', 1), '{DIGITS}', '0123456789') AS mark FROM l1 WHERE line <> '')"""

HIERARCHY = f"""WITH {LINES}, h AS (SELECT *,
last_value(CASE WHEN kind = 'chapter' THEN line END IGNORE NULLS) OVER w AS chapter,
coalesce(last_value(CASE WHEN kind = 'section' THEN mark WHEN kind = 'chapter' THEN '' END IGNORE NULLS) OVER w, '') AS section_marker,
coalesce(last_value(CASE WHEN kind IN ('section', 'chapter', 'table_row') THEN '' WHEN kind = 'subsection' THEN '(' || mark || ')' END IGNORE NULLS) OVER w, '') AS base,
coalesce(last_value(CASE WHEN kind = 'clause' THEN '(' || mark || ')' WHEN kind = 'proviso' THEN '(proviso)' WHEN kind IN ('section', 'subsection', 'chapter', 'table_row') THEN '' END IGNORE NULLS) OVER w, '') AS suffix,
CAST(sum(CASE WHEN kind <> 'text' THEN 1 ELSE 0 END) OVER p AS BIGINT) + CASE WHEN first_value(kind) OVER p = 'text' THEN 1 ELSE 0 END AS block
FROM l2 WINDOW w AS (PARTITION BY doc ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY doc, page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc, page, line_no, chapter, section_marker, section_marker || CASE WHEN suffix <> '' THEN suffix ELSE base END AS node, block FROM h"""

_LIKE = f"""len(list_filter(ls, lambda x: len(list_filter(string_split({norm("x")}, ' '), lambda w: w <> '')) >= 4 AND len(list_filter(string_split({norm("x")}, ' '), lambda w: w <> '')) * 6 < length(x) - 4))"""
TEXT_LABEL = f"""(SELECT CASE WHEN {norm("text")} = '' THEN 'empty' WHEN {_LIKE} >= 3 AND {_LIKE} > len(ls) * 0.3 THEN 'table'
WHEN {_LIKE} >= 2 OR len(list_filter(ls, lambda x: regexp_matches(x, '^{SPACE}*{SPACE.replace("[", "[^", 1)}+{SPACE}{{2,}}{SPACE.replace("[", "[^", 1)}'))) > 0 THEN 'mixed' ELSE 'prose' END
FROM (SELECT list_filter(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r'), lambda x: {norm("x")} <> '') AS ls))"""

EXACT = f"""WITH c AS ({ONCE}), r AS (SELECT chunk_id, CASE WHEN {norm("text")} <> '' THEN lower({norm("text")}) ELSE 'empty ' || chunk_id END AS h, coalesce(text_layer, '') AS a, coalesce(source_act, '') AS b, coalesce(amends_section, '') AS d, {authority("authority_rank")} AS rank, coalesce(est_tokens, 0) AS n, seq FROM c),
w AS (SELECT *, first_value(chunk_id) OVER (PARTITION BY h, a, b, d ORDER BY rank, n DESC, seq) AS winner FROM r) SELECT chunk_id, winner, winner <> chunk_id AS is_duplicate FROM w"""

FURNITURE = f"""WITH c AS ({ONCE}), q AS (SELECT chunk_id, doc, page, string_split(text, chr(10)) AS a FROM c WHERE text IS NOT NULL), l AS (SELECT chunk_id, doc, page, CAST(unnest(range(1, len(a) + 1)) AS INT) AS line_no, unnest(a) AS line FROM q),
b AS (SELECT chunk_id, line_no, doc, page, lower({norm("line")}) AS t, {tokens("line")} <= 10 AND {norm("line")} <> '' AS cand FROM l),
p AS (SELECT doc, count(DISTINCT page) AS n FROM b GROUP BY 1), s AS (SELECT doc, t, count(DISTINCT coalesce(page, -1)) AS k FROM b WHERE cand GROUP BY 1, 2)
SELECT b.chunk_id, b.line_no FROM b JOIN p USING (doc) JOIN s USING (doc, t) WHERE cand AND (k >= greatest(3, floor(0.4 * n)) OR regexp_matches(t, '^(?:page\\s*)?[-–—\\s]*[0-9০-৯]{{1,4}}[-–—\\s]*(?:of\\s*[0-9]+)?$'))"""

REPORT = f"""WITH c AS ({ONCE}), a AS (SELECT doc, count(*) AS items, count(*) FILTER (WHERE kind = 'leaf') AS leaves, count(*) FILTER (WHERE kind = 'leaf' AND contains(coalesce(node, ''), '(') AND coalesce(section_marker, '') = '') AS parentless_leaves,
count_if(coalesce(node, '') = '') AS blank_nodes, count_if({norm("text")} = '') AS empty_texts, count_if(kind = 'front_matter') AS front_matter, count_if(kind = 'front_matter' AND retrievable) AS rf,
count(*) FILTER (WHERE pollution = 'page_furniture') AS furniture_stripped, count(DISTINCT nullif(section_marker, '')) AS sections_seen FROM c GROUP BY doc),
f AS (SELECT *, parentless_leaves > leaves * 0.5 AS bad, blank_nodes + empty_texts + rf + CASE WHEN front_matter > 1 THEN 1 ELSE 0 END + CASE WHEN parentless_leaves > leaves * 0.5 THEN 1 ELSE 0 END AS checks_failed FROM a)
SELECT doc, items, leaves, parentless_leaves, blank_nodes, empty_texts, front_matter, furniture_stripped, sections_seen, items + 5 AS checks_total, checks_failed, checks_failed = 0 AS ok, checks_failed > 0 AS blocked, round(1 - checks_failed / greatest(1, items + 5), 3) AS pass_rate FROM f"""

PAGE_EVIDENCE = f"""WITH w AS (SELECT doc, page, unnest(string_split({norm("text")}, ' ')) AS w FROM prose_chunks), g AS (SELECT doc, page, w, count(*) AS n FROM w WHERE w <> '' GROUP BY 1, 2, 3)
SELECT doc, page, CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(n * length(w)) + sum(n) - 1 AS BIGINT) AS n_chars, round(sum(CASE WHEN length(w) <= 1 THEN n ELSE 0 END) / sum(n), 6) AS one_letter_share,
round(max(n) / sum(n), 6) AS top_token_share, round(sum(CASE WHEN regexp_matches(w, '[†‡]') THEN n ELSE 0 END) / sum(n), 6) AS dagger_share, round(sum(CASE WHEN contains(w, '(cid:') THEN n ELSE 0 END) / sum(n), 6) AS cid_share FROM g GROUP BY 1, 2"""

CONTINUITY = f"""WITH c AS ({ONCE}), n AS (SELECT doc, try_cast(section_number AS INT) AS n, seq FROM c), o AS (SELECT *, lag(n) OVER (PARTITION BY doc ORDER BY seq) AS prev FROM n WHERE n IS NOT NULL),
m AS (SELECT *, max(n) OVER (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o WHERE prev IS NULL OR prev <> n), u AS (SELECT DISTINCT doc, n FROM m)
SELECT doc, 'backward' AS "check", n AS at, top AS detail FROM m WHERE n < top UNION ALL SELECT doc, 'gap', n, nxt FROM (SELECT *, lead(n) OVER (PARTITION BY doc ORDER BY n) AS nxt FROM u) WHERE nxt > n + 1"""

INDEXED = f"""c AS ({ONCE}), c0 AS (SELECT * REPLACE ({SECTION_PATH} AS section_path) FROM c WHERE coalesce(retrievable, false) AND coalesce(kind, '') <> 'front_matter'),
ct AS (SELECT seq, doc, text, text_layer, source_act, section_number, {authority("authority_rank")} AS authority, {APPLICABLE} AS open, lower({norm(f"concat_ws(' — ', nullif({EMBED_PREFIX}, ''), coalesce(text, ''))")}) AS e FROM c0)"""


def vectors(name: str, source: str, key: str, text: str) -> str:
    """Counts of words by md5 in 64 places, to unit length as single precision."""
    return f"""{name}_w AS (SELECT {key} AS id, unnest(string_split({text}, ' ')) AS w FROM {source}),
{name}_n AS (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS k, count(*) AS n FROM {name}_w WHERE w <> '' GROUP BY 1, 2),
{name}_u AS (SELECT id, k, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS x FROM {name}_n),
{name} AS (SELECT i.id, list(coalesce(u.x, 0.0) ORDER BY j.k) AS v FROM (SELECT DISTINCT id FROM {name}_u) i CROSS JOIN range(64) AS j(k) LEFT JOIN {name}_u u ON u.id = i.id AND u.k = j.k GROUP BY i.id)"""


ENVELOPES = """env0 AS (SELECT query_id, coalesce(query_bangla, '') AS original, verified_by IS NOT NULL AS known, list_filter([trim(query_bangla, ' '), trim(query_english, ' ')], lambda x: x IS NOT NULL AND x <> '') AS vs, multi_aspect_expected AS ma, historical_expected AS hi FROM test_queries),
env AS (SELECT query_id, original, CASE WHEN known AND len(vs) > 0 THEN vs ELSE [original] END AS variants, known AND len(vs) > 0 AND coalesce(ma, false) AS multi_aspect, known AND len(vs) > 0 AND coalesce(hi, false) AS historical,
CASE WHEN NOT known THEN 'no_model_output' WHEN len(vs) = 0 THEN 'malformed_json' END AS fallback FROM env0)"""

RANKED = f"""{INDEXED}, {vectors("cv", "ct", "seq", "e")}, {ENVELOPES},
qt AS (SELECT query_id, historical, CAST(generate_subscripts(variants, 1) - 1 AS INT) AS list_no, unnest(variants) AS variant FROM env),
ql AS (SELECT query_id || '#' || list_no AS id, * FROM qt), {vectors("qv", "ql", "id", f"lower({norm('variant')})")},
sc AS (SELECT query_id, list_no, ct.seq, list_cosine_similarity(qv.v, cv.v) AS score FROM ql JOIN qv USING (id), ct JOIN cv ON cv.id = ct.seq WHERE open OR historical),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, list_no ORDER BY round(score, 12) DESC, seq) AS INT) AS rank FROM sc QUALIFY rank <= 10)"""

FUSED = """fg AS (SELECT query_id, seq, sum(1.0 / (60 + rank)) AS rrf, CAST(count(*) AS INT) AS appears_in, min(list_no * 1000 + rank) AS first FROM ranked GROUP BY 1, 2),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, first, seq) AS INT) AS rrf_rank FROM fg QUALIFY rrf_rank <= 30)"""

# the item with number i drops what it beats, until an item beats it; ``gone`` grows from item to item
COLLAPSE = """pl AS (SELECT f.query_id, f.seq, f.rrf_rank AS i, authority AS a, coalesce(text_layer, '') || '/' || coalesce(source_act, '') AS g, cv.v FROM fused f JOIN ct USING (seq) JOIN cv ON cv.id = f.seq),
near AS (SELECT x.query_id, x.i, list({'j': y.i, 'same': x.g = y.g, 'wins': y.a < x.a} ORDER BY y.i) AS ys FROM pl x JOIN pl y ON x.query_id = y.query_id AND x.i < y.i WHERE list_cosine_similarity(x.v, y.v) >= 0.92 GROUP BY 1, 2),
walk AS (SELECT DISTINCT query_id, 0 AS i, CAST([] AS INT[]) AS gone, CAST([] AS STRUCT(l INT, w INT, outcome VARCHAR)[]) AS o FROM pl
UNION ALL SELECT query_id, i, list_concat(gone, list_transform(list_filter(n, lambda z: z.outcome = 'collapsed'), lambda z: z.l)), n FROM (
SELECT query_id, i, gone, list_transform(list_filter(ys, lambda y: NOT list_contains(gone, y.j) AND y.j <= coalesce(list_min(list_transform(list_filter(ys, lambda z: z.same AND z.wins AND NOT list_contains(gone, z.j)), lambda z: z.j)), 99)),
lambda y: {'l': CASE WHEN y.same AND y.wins THEN i ELSE y.j END, 'w': CASE WHEN y.same AND y.wins THEN y.j ELSE i END, 'outcome': CASE WHEN y.same THEN 'collapsed' ELSE 'guarded' END}) AS n
FROM (SELECT w.query_id, w.i + 1 AS i, w.gone, CASE WHEN list_contains(w.gone, w.i + 1) THEN [] ELSE coalesce(near.ys, []) END AS ys FROM walk w LEFT JOIN near ON near.query_id = w.query_id AND near.i = w.i + 1 WHERE w.i < 30))),
pairs AS (SELECT query_id, unnest(o) AS p FROM walk), last AS (SELECT query_id, gone FROM walk WHERE i = 30),
outcome AS (SELECT pl.query_id, pl.seq, pl.i AS rrf_rank, 'kept' AS outcome, CAST(NULL AS BIGINT) AS other FROM pl JOIN last USING (query_id) WHERE NOT list_contains(gone, pl.i)
UNION ALL SELECT p.query_id, a.seq, a.i, p.p.outcome, b.seq FROM pairs p JOIN pl a ON a.query_id = p.query_id AND a.i = p.p.l JOIN pl b ON b.query_id = p.query_id AND b.i = p.p.w)"""

_WORDS = lambda x: rf"list_distinct(list_filter(string_split(regexp_replace(lower({norm(x)}), '[\pP\pS]+', '', 'g'), ' '), lambda w: w <> ''))"
SCORED = f"""scored AS (SELECT f.query_id, f.seq, f.rrf_rank, round(CASE WHEN len({_WORDS("env.original")}) > 0 THEN len(list_intersect({_WORDS("env.original")}, {_WORDS("ct.text")})) / len({_WORDS("env.original")}) ELSE 0 END, 6) AS rerank_score FROM fused f JOIN ct USING (seq) JOIN env USING (query_id))"""

MEASURES = """h AS (SELECT o.query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM one o JOIN rel USING (query_id, seq) GROUP BY 1)
SELECT query_id, round(coalesce(hits / n_rel, 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS rr, round(coalesce(dcg / list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM n LEFT JOIN h USING (query_id)"""

VECTOR_SEARCH = """SELECT q.vec_id AS query_id, i.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 6) AS score,
CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 12) DESC, i.vec_id) AS INT) AS rank FROM embeddings q JOIN embeddings i ON i.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10"""

_STATUS = spelled("legal_status")
LAYER_NOTE = f"""SELECT seq, CASE coalesce(text_layer, '') WHEN '' THEN NULL
WHEN 'amendment_overlay' THEN CASE {_STATUS} WHEN 'pending_ratification' THEN 'Amendment overlay: operative text, ratification pending - supersedes the consolidated base where they overlap' WHEN 'ratified' THEN 'Amendment overlay: enacted amendment not yet merged into the consolidated base - supersedes the base where they overlap' ELSE 'Amendment overlay layer (status: ' || coalesce({_STATUS}, 'None') || ')' END
WHEN 'consolidated_base' THEN CASE WHEN {_STATUS} = 'ratified' THEN 'Consolidated base text (Act + ratified amendments)' ELSE 'Consolidated base text layer (status: ' || coalesce({_STATUS}, 'None') || ')' END
WHEN 'historical_base' THEN 'Historical text of the Act - superseded, shown only to say what the law used to be' ELSE 'Not part of the consolidated law layers' END AS note FROM prose_chunks"""
OVERLAY_LABELS = f"""SELECT seq, CASE {_STATUS} WHEN 'ratified' THEN '[earlier text — amended by a later Act]' WHEN 'pending_ratification' THEN '[settled law since 2018]' ELSE '[base text — an amendment covers this provision]' END AS base,
CASE {_STATUS} WHEN 'ratified' THEN '[current text — enacted amendment]' WHEN 'pending_ratification' THEN '[current text — ratification pending]' ELSE '[amendment text — status unverified]' END AS overlay FROM prose_chunks"""
PARENT_LABELS = "SELECT c.seq, CASE WHEN p.parent_id IS NULL THEN '[bare chunk — parent missing]' WHEN p.kind = 'self' THEN '[self-parented — no broader section context]' ELSE '' END AS label FROM prose_chunks c LEFT JOIN parent_store p USING (parent_id)"
PROVISION_LINKS = f"""WITH c AS ({ONCE}), p AS (SELECT chunk_id, coalesce(text_layer, '') = 'amendment_overlay' AS side, nullif(section_number, '') AS num,
CASE WHEN coalesce(section_path, '') <> '' THEN array_to_string(list_filter(string_split(trim(regexp_replace(lower(section_path), '[^\\pL\\pN_]+', ' ', 'g')), ' '), lambda w: w NOT IN ('section', 'chapter', 'sub-section', 'clause', 'page', 'table', 'front', 'matter')), ' ') END AS path FROM c)
SELECT a.chunk_id, count(b.chunk_id) AS n_links FROM p a LEFT JOIN p b ON a.side = b.side AND a.chunk_id <> b.chunk_id AND CASE WHEN a.num IS NOT NULL AND b.num IS NOT NULL THEN a.num = b.num ELSE a.path = b.path END GROUP BY 1"""

INSTRUMENT = r"(?i)gazette|rules|act\b|ordinance|order\b|notification|s\.?r\.?o\.?"
STRONG = r"(?i)registered\s+no|published\s+by\s+the\s+authority|translated\s+from|gazette\s+notification|people[''’]?s\s+republic"
MASTHEAD_CUT = f"""WITH RECURSIVE t AS (SELECT seq, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')[1:25] AS a FROM prose_chunks WHERE text IS NOT NULL),
l0 AS (SELECT seq, CAST(generate_subscripts(a, 1) - 1 AS INT) AS i, trim(unnest(a), ' ') AS line FROM t),
l AS (SELECT seq, i, regexp_matches(line, '{MASTHEAD}') AS m, upper(line) = line AND regexp_matches(line, '\\pL') AND length(line) <= 90 AND regexp_matches(line, '{INSTRUMENT}') AS u, regexp_matches(line, '{STRONG}') AS s FROM l0),
w AS (SELECT seq, 0 AS i, 0 AS cut, false AS strong, false AS done FROM t
UNION ALL SELECT seq, i + 1, CASE WHEN hit AND NOT stop THEN i + 1 ELSE cut END, strong OR (hit AND NOT stop AND s), stop FROM (
SELECT w.*, l.s, l.m OR (cut > 0 AND l.u) AS hit, done OR (NOT (l.m OR (cut > 0 AND l.u)) AND (cut > 0 OR w.i >= 2)) AS stop FROM w JOIN l USING (seq, i)))
SELECT * FROM (SELECT seq, max_by(CASE WHEN strong THEN cut ELSE 0 END, i) AS cut FROM w GROUP BY seq) WHERE cut > 0"""

_COST = lambda w: f"greatest(1, CAST(round_even(({w}) * CAST(1.3 AS DOUBLE), 0) AS INT))"
_SENTENCES = lambda x: rf"string_split(regexp_replace(trim(regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g'), ' '), '([.!?।॥]){SPACE}+', '\1' || chr(1), 'g'), chr(1))"


def packing(by: str) -> str:
    """Units are walked one by one: each document's streams of lines between oversized ones and of sentences of these, or of all its sentences."""
    lines = f"""li AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS o, unnest(string_split(text, chr(10))) AS line FROM long),
lb AS (SELECT *, {tokens("line")} > 350 AS big, sum(CASE WHEN {tokens("line")} > 350 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY o) AS g FROM li),
st AS (SELECT doc_id, min(o) AS o, 0 AS least, list(line ORDER BY o) AS u FROM lb WHERE NOT big GROUP BY doc_id, g UNION ALL SELECT doc_id, o, 1, {_SENTENCES("line")} FROM lb WHERE big)"""
    streams = lines if by == "lines" else f"st AS (SELECT doc_id, 1 AS o, 1 AS least, {_SENTENCES('text')} AS u FROM long)"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, text FROM documents WHERE {norm("text")} <> ''), long AS (SELECT * FROM d WHERE {tokens("text")} > 350), {streams},
n AS (SELECT row_number() OVER () AS sid, *, list_transform(u, lambda x: {words("x")}) AS ws FROM st), m AS (SELECT *, list_transform(range(len(ws) + 1), lambda i: CAST(coalesce(list_sum(ws[1:i]), 0) AS INT)) AS w FROM n),
walk AS (SELECT sid, 0 AS k, 0 AS s, 0 AS size, -1 AS a, -1 AS b FROM m
UNION ALL SELECT sid, k + 1, CASE WHEN flush THEN s2 ELSE s END, CASE WHEN flush THEN CASE WHEN s2 < k THEN {_COST("w[k + 1] - w[s2 + 1]")} ELSE 0 END ELSE size END + {_COST("ws[k + 1]")}, CASE WHEN flush THEN s ELSE -1 END, CASE WHEN flush THEN k ELSE -1 END FROM (
SELECT x.*, m.w, m.ws, k > s AND size + {_COST("m.ws[k + 1]")} > 350 AS flush, k - greatest(least, CAST(floor((k - s) * CAST(0.15 AS DOUBLE)) AS INT)) AS s2 FROM walk x JOIN m USING (sid) WHERE k < len(m.ws))),
p AS (SELECT sid, a, b FROM walk WHERE a >= 0 UNION ALL SELECT walk.sid, s, k FROM walk JOIN m USING (sid) WHERE k = len(ws)),
q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o, b) AS piece, count(*) OVER (PARTITION BY doc_id) AS n_pieces, array_to_string(u[a + 1:b], ' ') AS text FROM p JOIN m USING (sid))
SELECT doc_id, CAST(piece AS INT) AS piece, CAST(n_pieces AS INT) AS n_pieces, CASE WHEN n_pieces > 1 THEN piece || '/' || n_pieces END AS split_part, text FROM q
UNION ALL SELECT doc_id, 1, 1, NULL, text FROM d WHERE {tokens("text")} <= 350"""


_ID = lambda *x: "'par' || substr(sha1(" + " || chr(1) || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in x) + "), 1, 16)"
PARENTS = f"""WITH RECURSIVE c AS ({ONCE}), k AS (SELECT *, coalesce(CASE WHEN est_tokens > 0 THEN est_tokens END, {tokens("text")}) AS t, coalesce(section_marker, '') AS m FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY doc, m ORDER BY seq) AS i FROM k WHERE m <> ''),
w AS (SELECT seq, doc, m, i, 1 AS n, t AS used, 1 AS part FROM o WHERE i = 1
UNION ALL SELECT o.seq, o.doc, o.m, o.i, CASE WHEN w.n >= 40 OR used + o.t > 5000 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 40 OR used + o.t > 5000 THEN o.t ELSE used + o.t END, part + CASE WHEN w.n >= 40 OR used + o.t > 5000 THEN 1 ELSE 0 END FROM w JOIN o ON o.doc = w.doc AND o.m = w.m AND o.i = w.i + 1),
g AS (SELECT w.doc, w.m, part, min_by(section_title, CASE WHEN section_title <> '' THEN seq END) AS title, min_by(chapter, CASE WHEN chapter <> '' THEN seq END) AS chapter, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY seq) AS text,
array_to_string(list_sort(list_distinct(list(page))), ',') AS pages, count(*) AS n, CAST(sum(t) AS INT) AS tokens, count(*) OVER (PARTITION BY w.doc, w.m) AS parts FROM w JOIN k USING (seq) GROUP BY 1, 2, 3)
SELECT {_ID("'prose'", "doc", "m", "part")} AS parent_id, 'prose' AS kind, doc, m AS section_marker, CASE WHEN parts > 1 THEN coalesce(title, '') || ' (part ' || part || '/' || parts || ')' ELSE coalesce(title, '') END AS section_title, chapter, text, coalesce(pages, '') AS pages, CAST(n AS INT) AS n_children, tokens AS est_tokens FROM g
UNION ALL SELECT {_ID("'self'", "doc", "seq")}, 'self', doc, '', coalesce(section_title, ''), chapter, text, coalesce(CAST(page AS VARCHAR), ''), 1, t FROM k WHERE m = ''"""

TABLES = """WITH r0 AS (SELECT l_orderkey, l_linenumber, l_returnflag AS f, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q, format('{:,.2f}', l_extendedprice) AS p FROM lineitem),
r1 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, f, q, p) AS i FROM r0), r2 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, f ORDER BY i) AS k FROM r1),
r AS (SELECT *, f || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END AS label FROM r2),
j AS (SELECT *, '"' || label || '":{"Quantity":{"i":' || q || '},"Price":' || CASE WHEN contains(p, ',') THEN '{"s":"' || p || '"}' ELSE '{"d":' || CAST(CAST(p AS DOUBLE) AS VARCHAR) || '}' END || '}' AS cell FROM r)
SELECT l_orderkey, 'Structured data table with 3 columns: Flag, Quantity, Price. It contains ' || count(*) || ' data rows and ' || (3 * count(*) + 3) || ' populated cells; sample values: Flag, Quantity, Price, ' || min_by(f, i) || ', ' || min_by(q, i) || '.' AS summary,
string_agg(label, '|' ORDER BY i) AS labels, '{' || string_agg(cell, ',' ORDER BY i) || '}' AS data_json, true AS kept FROM j GROUP BY l_orderkey"""

AMENDED = r"CASE WHEN regexp_matches(coalesce(section_title, ''), '২০০৬\s*সনের\s*৪২\s*নং\s*আইন') THEN 'named' END"

_FIELDS = {
    "gazette_name": r"(?i)(The\s+Bangladesh\s+Gazette[^.\n]*?)(?:\s+Published\b|\.|\s*$)",
    "title_line": r"(?i)((?:The\s+)?Bangladesh\s+(?:Labour\s+)?(?:Rules|Act|Ordinance)[^.\n]{0,60})",
    "publication_date": r"((?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)[^,\n]*,\s*[A-Za-z]+\s+\d{1,2},\s*\d{4})",
    "issuing_authority": r"(?i)(Ministry\s+of[^\n.]*)",
    "dated_reference": r"(?i)Dated\s*:\s*(.+)",
}
_field = lambda p: norm(f"regexp_extract(text, '{p}', 1)")
MASTHEAD_FIELDS = r"""SELECT seq, nullif(regexp_replace(regexp_replace(regexp_extract(text, '(?i)Registered\s+No\.?\s*([A-Za-z]+\s*-\s*\S+|\S+)', 1), '-\s+', '-', 'g'), '\.+$', ''), '') AS registration_no, """ + ", ".join(f"nullif({_field(p)}, '') AS {n}" for n, p in _FIELDS.items()) + " FROM prose_chunks"
