"""All registered queries of the core, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwell.functions import text as T
from chunkwell.functions.ordered import numbered
from chunkwell.functions.storage import stored
from chunkwell.operators import dedup, evaluation, ingest, models, parents, quality, retrieval
from chunkwell.plans import sql as S
from chunkwell.sources import corpus, sinks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
c = F.col


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "prose_chunks")


def once(spark: SparkSession, d: str) -> DataFrame:
    return quality.delivered_once(chunks(spark, d))


def simple(name: str, columns: dict[str, tuple], key: str = "seq", source: str = "prose_chunks") -> None:
    """A projection of one table: output name -> (Spark column builder, SQL)."""
    sql = f"SELECT {key}, " + ", ".join(f"{q} AS {n}" for n, (_, q) in columns.items()) + f" FROM {source}"
    register(name, sql)(lambda s, d: table(s, d, source).select(key, *[f().alias(n) for n, (f, _) in columns.items()]))


# --- FN: scalar functions -------------------------------------------------------------------------------------------

simple("fn_01_normalize", {"norm": (lambda: T.normalize(c("text")), S.norm("text"))})
simple("fn_02_digits", {"node_ascii": (lambda: T.ascii_digits(c("node")), f"translate(node, '{T.BANGLA_DIGITS}', '0123456789')")})
simple("fn_03_tokens", {"tokens": (lambda: T.estimate_tokens(c("text")), S.tokens("text"))})
simple("fn_04_preview", {"preview": (lambda: T.preview(c("text")), f"CASE WHEN length({S.norm('text')}) > 280 THEN substr({S.norm('text')}, 1, 280) || ' ...' ELSE {S.norm('text')} END")})
simple("fn_05_slug", {"slug": (lambda: T.doc_slug(c("path")), r"trim(regexp_replace(lower(regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '\.[^.]*$', '')), '[^a-z0-9]+', '_', 'g'), '_')")})
simple("fn_06_cells_clean", {"cell": (lambda: T.normalize(c("section_title")), S.norm("section_title"))}, "parent_id", "parent_store")


@register("fn_07_ids", "SELECT seq, printf('chk%04d', row_number() OVER (PARTITION BY doc ORDER BY seq)) AS local_id FROM prose_chunks")
def _(s, d):

    return numbered(chunks(s, d).select("doc", "seq"), "doc", "seq", "n").select("seq", T.sequential_id("chk", c("n")).alias("local_id"))


@register(
    "fn_08_cells",
    f"""WITH w AS (SELECT DISTINCT unnest(string_split({S.norm("text")}, ' ')) AS cell FROM prose_chunks), n AS (SELECT cell, translate(cell, '{T.BANGLA_DIGITS}', '0123456789') AS a FROM w)
SELECT cell, CASE WHEN regexp_matches(a, '^-?[0-9][0-9,]*$') THEN try_cast(replace(a, ',', '') AS BIGINT) END AS i,
CASE WHEN regexp_matches(a, '^-?[0-9]+\\.[0-9]+$') THEN try_cast(a AS DOUBLE) END AS d,
CASE WHEN NOT regexp_matches(a, '^-?[0-9][0-9,]*$') AND NOT regexp_matches(a, '^-?[0-9]+\\.[0-9]+$') THEN cell END AS s FROM n""",
)
def _(s, d):
    w = chunks(s, d).select(F.explode(F.split(T.normalize(c("text")), " ")).alias("cell")).distinct()
    return w.select("cell", T.coerce_cell(c("cell")).alias("v")).select("cell", "v.*")


simple("fn_09_section_ids", {"sid": (lambda: T.section_id(F.regexp_replace("section_marker", "[।.]", "")), f"CASE WHEN regexp_matches(m, '^[০-৯]{{1,3}}[ক-চ]?$') THEN CAST(CAST(translate(regexp_extract(m, '^[০-৯]+'), '{T.BANGLA_DIGITS}', '0123456789') AS INT) AS VARCHAR) || translate(regexp_extract(m, '[ক-চ]$'), '{T.CLAUSE_LETTERS}', 'ABCDEF') END")}, "seq", "prose_chunks")
_SQL["fn_09_section_ids"] = _SQL["fn_09_section_ids"].replace("FROM prose_chunks", "FROM (SELECT seq, trim(regexp_replace(section_marker, '[।.]', '', 'g')) AS m FROM prose_chunks)")

HEADINGS = [
    ("২০০৬ সনের ৪২ নং আইনের ধারা ১৭ এর সংশোধন", "17"),
    ("২০০৬ সনের ৪২ নং আইনে নূতন ধারা ৩০৭ক ও ৩০৭খ এর সন্নিবেশ", "307A;307B"),
    ("২০০৬ সনের ৪২ নং আইনের ধারা ৩৪৫ক, ৩৪৫খ ও ৩৪৫গ এর সংশোধন", "345A;345B;345C"),
    ("২০০৬ সনের ৪২ নং আইনের প্রথম তফসিল প্রতিস্থাপন", "schedule_1"),
    ("২০০৬ সনের ৪২ নং আইনের কতিপয় শব্দের সংশোধন", "*"),
    ("সংক্ষিপ্ত শিরোনাম ও প্রবর্তন", None),
]


@register("fn_10_amended", "SELECT * FROM (VALUES " + ", ".join(f"('{h}', {'NULL' if v is None else repr(v)})" for h, v in HEADINGS) + f") AS t(heading, amends) UNION ALL SELECT section_title, {S.AMENDED} FROM (SELECT DISTINCT section_title FROM prose_chunks)")
def _(s, d):
    given = s.createDataFrame([(h,) for h, _ in HEADINGS], "heading string").unionByName(chunks(s, d).select(c("section_title").alias("heading")).distinct())
    return given.select("heading", T.amends_field(c("heading")).alias("amends"))


simple("fn_12_topics", {"tags": (lambda: F.array_join(T.topic_tags(c("text")), ";"), "array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in ws) + f" THEN '{t}' END" for t, ws in T.TOPICS.items()) + "], lambda x: x IS NOT NULL)[1:3], ';')")})
simple("fn_13_path", {"path": (lambda: T.section_path(c("doc"), c("chapter"), c("kind"), c("node"), c("section_marker"), c("page")), S.SECTION_PATH)})
simple("fn_14_prefix", {"prefix": (lambda: T.embed_prefix(c("source_act"), c("doc"), c("chapter"), c("section_path"), c("section_title"), c("kind"), c("amends_section")), S.EMBED_PREFIX)})
simple("fn_15_embed_text", {"embed_text": (lambda: T.embed_text(c("source_act"), c("text")), "concat_ws(' — ', nullif(source_act, ''), coalesce(text, ''))")})
FLAT = {"doc": "", "page": -1, "kind": "", "node": "", "chapter": "", "section_marker": "", "section_title": "", "est_tokens": -1, "source_type": "", "source_act": "", "effective_date": "", "legal_status": "", "in_force": "", "authority_rank": "", "translation_status": "", "text_layer": "", "section_number": "", "amends_section": "", "text_source": "", "retrievable": "", "topic_tags": ""}


def flat_sql(n: str) -> str:
    return f"coalesce({n}, -1) AS {n}" if FLAT[n] == -1 else f"coalesce(array_to_string({n}, '; '), '') AS {n}" if n == "topic_tags" else f"coalesce(CAST({n} AS VARCHAR), '') AS {n}"


@register("fn_16_flat", "SELECT seq, " + ", ".join(map(flat_sql, FLAT)) + " FROM prose_chunks")
def _(s, d):
    t = chunks(s, d)
    return t.select("seq", *T.flat_metadata(t, list(FLAT)))


@register("fn_17_unflat", "SELECT seq, coalesce(array_to_string(topic_tags, '|'), '') AS tags, coalesce(page, -1) AS page, coalesce(est_tokens, -1) AS est_tokens, coalesce(in_force, false) AS in_force, coalesce(retrievable, false) AS retrievable FROM prose_chunks")
def _(s, d):
    t = chunks(s, d)
    flat = t.select("seq", *[x.cast("string").alias(n) for x, n in zip(T.flat_metadata(t, list(FLAT)), FLAT, strict=True)])
    return flat.select("seq", F.array_join(T.unflat_list(c("topic_tags")), "|").alias("tags"), *[T.unflat_int(c(x)).alias(x) for x in ("page", "est_tokens")], *[T.unflat_bool(c(x)).alias(x) for x in ("in_force", "retrievable")])


simple("fn_20_hash", {"h": (lambda: T.text_hash(c("text")), f"sha1(lower({S.norm('text')}))")})
simple("fn_21_authority", {"place": (lambda: T.authority_order(c("authority_rank")), S.authority("authority_rank"))})
simple("fn_22_bangla", {"bangla": (lambda: T.is_bangla(c("text")), r"coalesce(len(regexp_extract_all(text, '[\x{0985}-\x{09B9}\x{09CE}\x{09DC}-\x{09E1}\x{09F0}\x{09F1}\x{09FC}\x{0980}\x{09BD}]')) * 1.0 / nullif(len(regexp_extract_all(text, '\pL')), 0), 0) >= 0.3")})
simple("fn_23_looks_bangla", {"bangla": (lambda: T.looks_bangla(c("query_bangla")), r"regexp_matches(coalesce(query_bangla, ''), '[\x{0980}-\x{09FF}]')")}, "query_id", "test_queries")


@register("fn_24_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(s, d):
    e = table(s, d, "embeddings")
    return e.join(e.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("other")), "vec_id").select("vec_id", F.round(T.cosine(c("embedding"), c("other")), 6).alias("sim"))


@register("fn_25_envelope", "SELECT * FROM (VALUES (1, 'a;b', false, true, false), (2, 'solo', false, false, false), (3, 'q', false, false, true), (4, 'q', false, false, true)) AS t(k, variants, multi_aspect, historical, degraded)")
def _(s, d):
    rows = [(1, '{"variants": ["a", " b ", ""], "historical": true}'), (2, '{"variants": "solo", "multi_aspect": "false"}'), (3, "no json"), (4, None)]
    e = s.createDataFrame(rows, "k int, reply string").select("k", T.envelope(c("reply"), F.lit("q")).alias("e"))
    return e.select("k", F.array_join("e.variants", ";").alias("variants"), "e.multi_aspect", "e.historical", "e.degraded")


simple("fn_26_amends_list", {"amends": (lambda: F.array_join(T.unflat_list(c("amends_section")), "|"), "array_to_string(list_filter(list_transform(string_split(coalesce(amends_section, ''), ';'), lambda x: trim(x)), lambda x: x <> ''), '|')")})
simple("fn_30_parent_content", {"content": (lambda: T.parent_content(c("kind"), c("text"), c("table_json")), "CASE WHEN kind = 'table' THEN coalesce(table_json, '') ELSE coalesce(text, '') END")}, "parent_id", "parent_store")
simple("fn_31_parent_tokens", {"tokens": (lambda: T.content_tokens(c("kind"), c("text"), c("table_json")), f"CASE WHEN kind = 'table' THEN greatest(1, CAST(round_even(length(coalesce(table_json, '')) / 4.0, 0) AS INT)) ELSE {S.tokens('text')} END")}, "parent_id", "parent_store")
register("fn_33_masthead_fields", S.MASTHEAD_FIELDS)(lambda s, d: chunks(s, d).select("seq", T.masthead_fields(c("text")).alias("f")).select("seq", "f.*"))
simple("fn_36_section_number", {"num": (lambda: T.section_number(c("section_marker")), "nullif(regexp_extract(coalesce(section_marker, ''), '^([0-9]{1,3})', 1), '')")})


@register("fn_32_masthead_lines", f"""WITH l AS (SELECT seq, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM prose_chunks) SELECT seq, count(*) AS n FROM l WHERE regexp_matches(line, '{S.MASTHEAD}') GROUP BY seq""")
def _(s, d):
    lines = chunks(s, d).select("seq", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    return lines.where(T.is_masthead(c("line"), F.lit(False))).groupBy("seq").agg(F.count("*").alias("n"))


def doc_lines(s, d):
    """The lines of every chunk, a chunk taken as a page of its document."""
    return ingest.line_table(once(s, d), "doc", "seq", "text")


@register("fn_35_line_kinds", f"WITH {S.LINES} SELECT doc, page, line_no, kind, mark FROM l2")
def _(s, d):
    return doc_lines(s, d).select("doc", "page", "line_no", "kind", "mark")


# --- FLT, JN ---------------------------------------------------------------------------------------------------------


@register("src_07_gold", "SELECT query_id, category, gold_section_number, multi_aspect_expected, historical_expected, dual_layer_expected FROM test_queries")
def _(s, d):
    return table(s, d, "test_queries").select("query_id", "category", "gold_section_number", "multi_aspect_expected", "historical_expected", "dual_layer_expected")


@register("src_08_parents", "SELECT kind, count(*) AS n, sum(n_children) AS children FROM parent_store GROUP BY kind")
def _(s, d):
    return corpus.saved(s, f"{d}/parent_store.parquet").groupBy("kind").agg(F.count("*").alias("n"), F.sum("n_children").alias("children"))


@register("src_10_lookup", f"WITH c AS ({S.ONCE}) SELECT a.chunk_id, c.kind, c.source_act FROM (SELECT DISTINCT chunk_id FROM sentence_audit) a LEFT JOIN c USING (chunk_id)")
def _(s, d):
    return retrieval.lookup(table(s, d, "sentence_audit").select("chunk_id").distinct(), "chunk_id", once(s, d), ["kind", "source_act"])


@register("src_11_text_lookup", f"WITH c AS ({S.ONCE}) SELECT a.chunk_id, coalesce(c.text, '') AS text FROM (SELECT DISTINCT chunk_id FROM sentence_audit) a LEFT JOIN c USING (chunk_id)")
def _(s, d):
    return retrieval.lookup(table(s, d, "sentence_audit").select("chunk_id").distinct(), "chunk_id", once(s, d), ["text"], blank=True)


@register("flt_01_applicable", f"SELECT seq FROM prose_chunks WHERE {S.APPLICABLE}")
def _(s, d):
    return retrieval.applicable(chunks(s, d)).select("seq")


@register("flt_02_historical", "SELECT seq FROM prose_chunks")
def _(s, d):
    return retrieval.applicable(chunks(s, d), historical=True).select("seq")


@register("flt_03_degraded", "SELECT query_id, historical_expected AND NOT multi_aspect_expected AS historical FROM test_queries")
def _(s, d):
    return table(s, d, "test_queries").select("query_id", retrieval.effective_historical(c("historical_expected"), c("multi_aspect_expected")).alias("historical"))


@register("flt_04_index_bound", "SELECT seq FROM prose_chunks c WHERE retrievable AND EXISTS (SELECT 1 FROM validation_report v WHERE v.doc = c.doc AND NOT v.blocked)")
def _(s, d):
    return quality.index_bound(chunks(s, d), table(s, d, "validation_report")).select("seq")


@register("flt_05_indexable", "SELECT seq FROM prose_chunks WHERE coalesce(retrievable, false) AND coalesce(kind, '') <> 'front_matter'")
def _(s, d):
    return quality.indexable(chunks(s, d)).select("seq")


@register("flt_06_near_candidates", "SELECT seq FROM prose_chunks WHERE retrievable AND coalesce(est_tokens, 0) >= 6")
def _(s, d):
    return dedup.candidates(chunks(s, d)).select("seq")


@register("flt_10_first_masthead", "SELECT doc, min(seq) AS seq FROM prose_chunks WHERE kind = 'front_matter' GROUP BY doc")
def _(s, d):
    return ingest.first_mastheads(chunks(s, d).select("doc", "kind", "seq"), "doc", "seq")


REGISTRY = ["source_type", "legal_status", "in_force", "authority_rank"]


@register("jn_02_registry", "SELECT c.seq, coalesce(r.source_type, 'unknown') AS source_type, r.legal_status, coalesce(r.in_force, false) AS in_force, r.authority_rank FROM prose_chunks c LEFT JOIN doc_metadata r USING (doc)")
def _(s, d):
    return corpus.registry(chunks(s, d), table(s, d, "doc_metadata"), REGISTRY, {"source_type": "unknown", "in_force": False}).select("seq", *REGISTRY)


@register("jn_07_parents", "SELECT c.seq, p.kind AS parent_kind, CASE WHEN p.parent_id IS NULL THEN 'missing_parent' ELSE 'found' END AS label FROM prose_chunks c LEFT JOIN parent_store p USING (parent_id)")
def _(s, d):
    return retrieval.with_parents(chunks(s, d).select("seq", "parent_id"), table(s, d, "parent_store")).select("seq", "parent_kind", F.when(c("label") == "missing_parent", "missing_parent").otherwise("found").alias("label"))


@register(
    "jn_08_overlay_pairs",
    f"""WITH c AS ({S.ONCE}), o AS (SELECT DISTINCT chunk_id, trim(unnest(string_split(amends_section, ';'))) AS section FROM c WHERE text_layer = 'amendment_overlay'),
b AS (SELECT section_number AS section, count(*) AS n FROM c WHERE text_layer = 'consolidated_base' AND section_number IS NOT NULL GROUP BY 1)
SELECT o.chunk_id, CAST(sum(b.n) AS BIGINT) AS n_base FROM o JOIN b USING (section) WHERE section <> '' GROUP BY 1""",
)
def _(s, d):
    return retrieval.amendment_counts(once(s, d), "chunk_id")


@register("jn_09_same_provision", S.PROVISION_LINKS)
def _(s, d):
    return retrieval.provision_links(once(s, d), "chunk_id")


@register("fn_18_layer_note", S.LAYER_NOTE)
def _(s, d):
    return chunks(s, d).select("seq", retrieval.layer_note(c("text_layer"), c("legal_status")).alias("note"))


@register("fn_28_overlay_labels", S.OVERLAY_LABELS)
def _(s, d):
    return chunks(s, d).select("seq", retrieval.overlay_labels(c("legal_status")).alias("l")).select("seq", "l.*")


@register("fn_29_parent_labels", S.PARENT_LABELS)
def _(s, d):
    return retrieval.with_parents(chunks(s, d).select("seq", "parent_id"), table(s, d, "parent_store")).select("seq", retrieval.parent_label(c("parent_kind")).alias("label"))


@register("jn_12_gold_labels", f"WITH c AS ({S.ONCE}), n AS (SELECT doc, section_number, count(*) AS n FROM c GROUP BY 1, 2) SELECT q.query_id, coalesce(n.n, 0) AS n_relevant FROM test_queries q LEFT JOIN n ON n.doc = q.gold_source_doc AND n.section_number = q.gold_section_number")
def _(s, d):
    return evaluation.gold_counts(table(s, d, "test_queries"), once(s, d)).select("query_id", "n_relevant")


# --- AGG, WIN, SET ------------------------------------------------------------------------------------------------------


@register("once_delivered", f"WITH c AS ({S.ONCE}) SELECT chunk_id, seq FROM c")
def _(s, d):
    return once(s, d).select("chunk_id", "seq")


@register("agg_01_routes", f"SELECT doc, {S.TEXT_LABEL} AS label, count(*) AS n FROM prose_chunks GROUP BY 1, 2")
def _(s, d):
    return chunks(s, d).groupBy("doc", ingest.text_label(c("text")).alias("label")).agg(F.count("*").alias("n"))


@register("agg_02_exact_duplicates", S.EXACT)
def _(s, d):
    return dedup.exact(once(s, d))


@register("agg_04_furniture", S.FURNITURE)
def _(s, d):
    """Of each chunk's lines, taken as short chunks of their own."""
    lines = once(s, d).select("chunk_id", "doc", "page", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.select("chunk_id", "doc", "page", (c("at") + 1).alias("line_no"), c("line").alias("text"), F.lit(True).alias("retrievable"), T.estimate_tokens(c("line")).alias("est_tokens"))
    return quality.furniture(lines).where("is_furniture").select("chunk_id", "line_no")


@register("agg_05_report", S.REPORT)
def _(s, d):
    return quality.report(once(s, d)).select("doc", "items", "leaves", "parentless_leaves", "blank_nodes", "empty_texts", "front_matter", "furniture_stripped", "sections_seen", "checks_total", "checks_failed", "ok", "blocked", "pass_rate")


@register("agg_06_sections", f"WITH c AS ({S.ONCE}) SELECT doc, section_marker, count(*) AS n_children, min_by(section_title, CASE WHEN section_title <> '' THEN seq END) AS title, min_by(chapter, CASE WHEN chapter <> '' THEN seq END) AS chapter, coalesce(array_to_string(list_sort(list_distinct(list(page))), ','), '') AS pages, length(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY seq)) AS chars FROM c WHERE coalesce(section_marker, '') <> '' GROUP BY 1, 2")
def _(s, d):
    return parents.sections(once(s, d))


@register("agg_08_totals", "SELECT count(*) AS n, count(DISTINCT doc) AS docs, count(*) FILTER (WHERE retrievable) AS retrievable, count(*) FILTER (WHERE kind = 'leaf') AS leaves, sum(est_tokens) AS tokens FROM prose_chunks")
def _(s, d):
    return chunks(s, d).agg(F.count("*").alias("n"), F.countDistinct("doc").alias("docs"), F.count_if("retrievable").alias("retrievable"), F.count_if(c("kind") == "leaf").alias("leaves"), F.sum("est_tokens").alias("tokens"))


def page_words(s, d):
    return chunks(s, d).select("doc", "page", F.explode(F.split(T.normalize(c("text")), " ")).alias("w")).where("w <> ''")


@register("agg_09_page_evidence", S.PAGE_EVIDENCE)
def _(s, d):
    return ingest.page_evidence(page_words(s, d), ["doc", "page"], "w")


@register("tbl_01_router", f"WITH e AS ({S.PAGE_EVIDENCE}) SELECT doc, page, CASE WHEN (n_words > 60 AND (one_letter_share > 0.45 OR top_token_share > 0.30 OR n_chars / n_words > 40 OR dagger_share > 0.10)) OR (n_words >= 5 AND cid_share > 0.10) THEN 'visual_routing_required' WHEN n_words < 15 THEN 'empty' ELSE 'prose' END AS label FROM e")
def _(s, d):
    return ingest.page_evidence(page_words(s, d), ["doc", "page"], "w").select("doc", "page", ingest.page_label().alias("label"))


simple("tbl_02_text_router", {"label": (lambda: ingest.text_label(c("text")), S.TEXT_LABEL)}, "doc_id", "documents")


@register("win_04_continuity", S.CONTINUITY)
def _(s, d):
    return quality.continuity(once(s, d), "doc", "section_number", "seq")


@register("win_01_hierarchy", S.HIERARCHY)
def _(s, d):
    return ingest.hierarchy(doc_lines(s, d)).select("doc", "page", "line_no", "chapter", "section_marker", "node", "block")


@register("tbl_14_nodes", f"WITH c AS ({S.ONCE}) SELECT chunk_id, CASE WHEN coalesce(node, '') = '' THEN printf('blk%03d', row_number() OVER (PARTITION BY doc ORDER BY seq)) ELSE node END AS node FROM c")
def _(s, d):
    return quality.fill_nodes(once(s, d)).select("chunk_id", "node")


@register("set_01_union", "SELECT 'chunk' AS origin, doc, count(*) AS n FROM prose_chunks GROUP BY doc UNION ALL SELECT 'table', doc, count(*) FROM parent_store WHERE kind = 'table' GROUP BY doc")
def _(s, d):
    t = table(s, d, "parent_store").where("kind = 'table'").select("doc", F.lit("table").alias("origin"))
    return chunks(s, d).select("doc", F.lit("chunk").alias("origin")).unionByName(t).groupBy("origin", "doc").agg(F.count("*").alias("n"))


@register("set_02_unregistered", "SELECT DISTINCT doc FROM prose_chunks EXCEPT SELECT doc FROM doc_metadata")
def _(s, d):
    return chunks(s, d).select("doc").distinct().join(table(s, d, "doc_metadata").select("doc"), "doc", "left_anti")


@register("top_05_audit", f"WITH c AS ({S.ONCE}) SELECT chunk_id, seq FROM c WHERE coalesce(text, '') = '' ORDER BY seq LIMIT 200")
def _(s, d):
    return once(s, d).where("coalesce(text, '') = ''").orderBy("seq").limit(200).select("chunk_id", "seq")


PAGES = "words array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>, tables array<struct<x0:double,x1:double,top:double,bottom:double,rows:array<array<string>>>>"


@register("tbl_17_dispatch", f"WITH l AS (SELECT doc_id, {S.TEXT_LABEL} AS label FROM documents) SELECT doc_id, CASE WHEN label IN ('prose', 'mixed') THEN 'prose' ELSE 'flag' END AS branch, label AS route, 0 AS kept FROM l WHERE label <> 'empty'")
def _(s, d):
    """Documents as pages without grids: a page of tables that gave none is flagged."""
    words, tables = (F.lit(None).cast(t.split(" ", 1)[1]) for t in PAGES.split(", "))
    got = ingest.dispatch(table(s, d, "documents").select(c("doc_id").alias("doc"), F.lit(1).alias("page"), "text", words.alias("words"), tables.alias("tables"), ingest.text_label(c("text")).alias("label")))
    branch = got["prose"].select("doc", F.lit("prose").alias("branch")).unionByName(got["flags"].select("doc", F.lit("flag").alias("branch")))
    return branch.join(got["stats"], "doc").select(c("doc").alias("doc_id"), "branch", "route", "kept")


# --- TBL: folds with feedback, checked against brute force in the tests ---------------------------------------------------


@register("tbl_03_masthead", S.MASTHEAD_CUT)
def _(s, d):
    return chunks(s, d).select("seq", ingest.masthead_cut(c("text")).alias("cut")).where("cut > 0")


@register("tbl_04_walker", None)
def walked(s, d):
    return ingest.walked(table(s, d, "documents").select(c("doc_id").cast("string").alias("doc"), F.lit(1).alias("page"), "text"), "doc", "page", "text")


@register("tbl_05_short_leaves", None)
def _(s, d):
    return walked(s, d).select("doc", "page", "block", "kind", "node", c("section_marker").alias("section"), "text")


@register("tbl_06_packing", S.packing("lines"))
def _(s, d):
    return ingest.pack(table(s, d, "documents"), "doc_id", "text")


@register("tbl_06_sentences", S.packing("sentences"))
def _(s, d):
    return ingest.pack(table(s, d, "documents"), "doc_id", "text", by="sentences")


@register("tbl_07_near_duplicates", None)
def _(s, d):
    return dedup.near(once(s, d))


@register("tbl_11_parents", S.PARENTS)
def _(s, d):
    return parents.build(once(s, d))[1].withColumn("pages", F.array_join("pages", ","))


@register("tbl_12_tables", S.TABLES)
def _(s, d):
    """Grids built from the lines of orders."""
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.array(c("l_returnflag"), c("l_quantity").cast("int").cast("string"), F.format_number("l_extendedprice", 2)).alias("r")))).alias("x"))
    g = li.select("l_orderkey", F.concat(F.array(F.array(F.lit("Flag"), F.lit("Quantity"), F.lit("Price"))), F.transform("x", lambda v: v.r)).alias("rows"))
    return ingest.table_chunks(g, "rows").select("l_orderkey", "summary", F.array_join("labels", "|").alias("labels"), "data_json", "kept")


# --- RET: search, fusion, context ---------------------------------------------------------------------------------------


def index(s, d):
    """Every indexable chunk, delivered once, with the vector of its embedded text."""
    return sinks.index_rows(once(s, d)).withColumnRenamed("embedding", "vector")


def envelopes(s, d):
    """The test queries with the replies on record: a verified query's gives both its forms, the others have none and fall back to the original."""
    reply = F.when(c("verified_by").isNotNull(), F.to_json(F.struct(F.array("query_bangla", "query_english").alias("variants"), c("multi_aspect_expected").alias("multi_aspect"), c("historical_expected").alias("historical"))))
    t = table(s, d, "test_queries")
    return retrieval.expand(t, "query_bangla", reply)


def ranked(s, d):
    return retrieval.search(index(s, d), retrieval.variant_lists(envelopes(s, d), models.embed), "seq", "vector", eligible=retrieval.applies())


@register("ret_1_expand", f"WITH {S.ENVELOPES} SELECT query_id, original, array_to_string(variants, ' | ') AS variants, multi_aspect, historical, fallback FROM env")
def _(s, d):
    return envelopes(s, d).withColumn("variants", F.array_join("variants", " | "))


@register("jn_06_search", f"WITH {S.RANKED} SELECT query_id, list_no, seq, round(score, 6) AS score, rank FROM ranked")
def _(s, d):
    return ranked(s, d).select("query_id", "list_no", "seq", F.round("score", 6).alias("score"), "rank")


@register("jn_06_vectors", S.VECTOR_SEARCH)
def given(s, d):
    """The given vectors whose number is divisible by 20 against all given vectors."""
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(c("vec_id").alias("query_id"), F.lit(0).alias("list_no"), c("embedding").alias("vector"))
    return retrieval.search(e, q, "vec_id", "embedding", exclude_self=True).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@register("agg_03_fusion", f"WITH {S.RANKED}, {S.FUSED} SELECT query_id, seq, round(rrf, 6) AS rrf_score, appears_in, rrf_rank FROM fused")
def _(s, d):
    return retrieval.fuse(ranked(s, d), "seq")


@register("win_11_relevance", f"WITH {S.RANKED} SELECT query_id, list_no, seq, round(CASE WHEN hi = lo THEN 0.5 ELSE (score - lo) / (hi - lo) END, 5) AS rel FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM ranked WINDOW w AS (PARTITION BY query_id, list_no))")
def _(s, d):
    w = Window.partitionBy("query_id", "list_no")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return ranked(s, d).select("query_id", "list_no", "seq", F.round(F.when(hi == lo, 0.5).otherwise((c("score") - lo) / (hi - lo)), 5).alias("rel"))


def pool(s, d):
    """The fused pool with what deduplication and reranking need."""
    meta = index(s, d).select("seq", "doc", "text", "text_layer", "source_act", "amends_section", "vector", T.authority_order(c("authority_rank")).alias("authority"))
    return retrieval.fuse(ranked(s, d), "seq").join(meta, "seq")


@register("ret_4_dedup_pool", f"WITH RECURSIVE {S.RANKED}, {S.FUSED}, {S.COLLAPSE} SELECT query_id, seq, rrf_rank, outcome, other FROM outcome")
def _(s, d):
    return retrieval.dedup_pool(stored(pool(s, d).drop("text")), "seq", retrieval.NEAR).drop("sim")


@register("ret_5_final", f"WITH {S.RANKED}, {S.FUSED}, {S.SCORED} SELECT query_id, seq, rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_rank) AS INT) AS final_rank FROM scored QUALIFY final_rank <= 5")
def final(s, d):
    """The best of the fused pool by the scorer against the original query."""
    p = pool(s, d).select("query_id", "seq", "rrf_rank", "text").join(envelopes(s, d).select("query_id", "original"), "query_id")
    return retrieval.rerank(p, "seq", models.lexical_score(c("original"), c("text"))).select("query_id", "seq", "rerank_score", "final_rank")


@register("ret_5_disabled", f"WITH {S.RANKED}, {S.FUSED} SELECT query_id, seq, rrf_rank AS final_rank FROM fused WHERE rrf_rank <= 5")
def _(s, d):
    """The reranker switched off: the fused order stands."""
    return retrieval.rerank(retrieval.fuse(ranked(s, d), "seq"), "seq", None).select("query_id", "seq", "final_rank")


def stages(s, d):
    return retrieval.stages(stored(index(s, d)), envelopes(s, d), table(s, d, "parent_store"), models.embed, "seq")


@register("ret_8_retrieve", None)
def _(s, d):
    return retrieval.context(stages(s, d), "seq")


@register("ret_9_trace", None)
def _(s, d):
    t = retrieval.trace(stages(s, d), "seq")
    return t.select("query_id", F.array_join("variants", " | ").alias("variants"), "flags.multi_aspect", "flags.historical", F.to_json("stages").alias("stages"), F.array_join("overall_fallbacks", ",").alias("fallbacks"), F.size("final_context").alias("n_context"), F.size("dual_layer_pairs").alias("n_pairs"), F.array_join("problems", ",").alias("problems"), "ok")


@register("eval_measures", f"""WITH {S.RANKED}, rel AS (SELECT DISTINCT q.query_id, ct.seq FROM test_queries q JOIN ct ON ct.doc = q.gold_source_doc AND ct.section_number = q.gold_section_number),
n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1), one AS (SELECT query_id, seq, rank FROM ranked WHERE list_no = 0), {S.MEASURES}""")
def _(s, d):
    """The first list of each query against the chunks of its gold section."""
    rel = table(s, d, "test_queries").select("query_id", c("gold_source_doc").alias("doc"), c("gold_section_number").alias("section_number")).join(index(s, d).select("seq", "doc", "section_number"), ["doc", "section_number"])
    return evaluation.measures(ranked(s, d).where("list_no = 0"), rel, "seq")


@register("eval_vectors", f"""WITH one AS ({S.VECTOR_SEARCH}), rel AS (SELECT q.vec_id AS query_id, i.vec_id FROM embeddings q JOIN embeddings i ON i.label = q.label WHERE q.vec_id % 20 = 0 AND i.vec_id <> q.vec_id),
n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1), {S.MEASURES.replace("seq", "vec_id")}""")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label")
    rel = e.where("vec_id % 20 = 0").select(c("vec_id").alias("query_id"), "label").join(e, "label").where("vec_id <> query_id")
    return evaluation.measures(given(s, d), rel, "vec_id")


@register("udf_01_index", None)
def _(s, d):
    return sinks.index_rows(once(s, d)).select("chunk_id", F.xxhash64("embed_text").alias("text_hash"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 4).alias("norm2"))


@register("snk_04_manifest", f"WITH c AS ({S.ONCE}) SELECT count(*) AS children_in, count(*) FILTER (WHERE retrievable AND kind <> 'front_matter') AS indexed, count(*) - count(*) FILTER (WHERE retrievable AND kind <> 'front_matter') AS excluded, 'hashed_words' AS model, 64 AS dims, 'cosine' AS space FROM c")
def _(s, d):
    t = once(s, d)
    return sinks.manifest(t, quality.indexable(t), 64)


def entry(spark: SparkSession, d: str) -> DataFrame:
    return final(spark, d)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
