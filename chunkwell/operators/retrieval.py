"""Batches of queries against the chunk index: expansion, search, fusion, deduplication, reranking, diversity, parents, overlays, trace."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from chunkwell.functions import text as T
from chunkwell.functions.storage import stored
from chunkwell.operators.models import lexical_score

PER_LIST, RRF_K, POOL, FINAL, NEAR, MMR_LAMBDA, BUDGET, VARIANTS = 10, 60, 30, 5, 0.92, 0.6, 4000, 3
#: Queries of one matrix product, products of one scan, index rows of one product.
QUERY_BLOCK, SCAN_BLOCKS, ROWS = 1024, 64, 2048


def applies() -> Column:
    """Whether a chunk is in force and not superseded; a missing status counts as not superseded."""
    return F.coalesce("in_force", F.lit(False)) & (F.coalesce(T.spelled(F.col("legal_status")), F.lit("")) != "superseded")


def applicable(df: DataFrame, historical: bool = False) -> DataFrame:
    """The default filter; historical queries do without it."""
    return df if historical else df.where(applies())


def effective_historical(historical: Column, degraded: Column) -> Column:
    """A degraded expansion never searches historically."""
    return F.coalesce(historical, F.lit(False)) & ~F.coalesce(degraded, F.lit(False))


# --- 1: expansion ------------------------------------------------------------------------------------------------------


def expand(queries: DataFrame, original: str, reply: Column | None = None, most: int = VARIANTS) -> DataFrame:
    """(query_id, original, variants, multi_aspect, historical, fallback) of each row of ``queries`` (query_id, ``original``).

    ``reply`` is a model's answer, a string or ``models.replier``'s struct. Where it can't be used the original is the only
    variant, both flags are false, and ``fallback`` says why: llm_skipped_by_caller (no ``reply`` column), llm_unavailable,
    no_model_output or malformed_json. A null query is an empty one.
    """
    q = queries.select("query_id", F.coalesce(F.col(original), F.lit("")).alias("original"), (F.lit(None).cast("string") if reply is None else reply).alias("r"))
    nested = isinstance(q.schema["r"].dataType, StructType)
    q = q.select("query_id", "original", F.col("r.reply" if nested else "r").alias("r"), (F.coalesce(F.col("r.failed"), F.lit(False)) if nested else F.lit(False)).alias("failed"))
    q = q.withColumn("e", T.envelope(F.col("r"), F.col("original"), most))
    why = F.when(F.lit(reply is None), "llm_skipped_by_caller").when(F.col("failed"), "llm_unavailable").when(T.normalize(F.col("r")) == "", "no_model_output").when(F.col("e.degraded"), "malformed_json")
    return q.select("query_id", "original", "e.variants", "e.multi_aspect", "e.historical", why.alias("fallback"))


def variant_lists(envelopes: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(query_id, list_no, variant, historical, vector): one list per variant that isn't blank; a variant that can't be embedded has no vector."""
    v = envelopes.select("query_id", "historical", F.posexplode("variants").alias("list_no", "variant")).where(T.normalize(F.col("variant")) != "")
    return v.withColumn("vector", embed(F.col("variant")))


# --- 2, 3: search and fusion ---------------------------------------------------------------------------------------------


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims))


def _best(x: np.ndarray, open_: np.ndarray, keys: np.ndarray, block: tuple, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows; rows come in the order of their keys, which decides ties."""
    ids, q, qn, all_rows = block
    n = np.outer(np.linalg.norm(x, axis=1), qn)
    s = np.divide(x @ q.T, n, out=np.zeros_like(n), where=n > 0)
    r = np.round(s, 12)
    r[np.ix_(~open_, ~all_rows)] = -np.inf
    if exclude_self:
        r[keys[:, None] == ids[None, :]] = -np.inf
    if len(r) > k:
        last = np.partition(r, len(r) - k, axis=0)[len(r) - k]
        above, level = r > last, r == last
        keep = above | (level & (np.cumsum(level, axis=0) <= k - above.sum(0)))
    else:
        keep = np.ones(r.shape, bool)
    row, query = np.nonzero(keep & (r > -np.inf))
    return query, row, s[row, query]


def search(index: DataFrame, queries: DataFrame, key: str, vector: str, k: int = PER_LIST, exclude_self: bool = False, eligible: Column | None = None) -> DataFrame:
    """Ranked lists (query_id, list_no, key, score, rank) by exact cosine.

    ``queries`` (query_id, list_no, vector, and historical where some queries see every row) are a stated set, taken in blocks as matrix
    products; one scan of the index serves SCAN_BLOCKS of them. ``eligible`` says which rows other queries see. Each batch of
    rows keeps its own best k per query, so what is shuffled is k rows per query and batch. Null vectors have no score, those of
    other lengths than the first query's neither; zero vectors score 0. Ties go to the smaller key.
    """
    spark, sc = index.sparkSession, index.sparkSession.sparkContext
    lists = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("list_no", IntegerType()), StructField("key", index.schema[key].dataType), StructField("score", DoubleType())])
    arrow = to_arrow_schema(lists)
    hist = F.coalesce(F.col("historical"), F.lit(False)) if "historical" in queries.columns else F.lit(True)
    stated = queries.select("query_id", "list_no", F.col("vector").cast("array<double>").alias("vector"), hist.alias("h")).where("vector is not null")

    def job(rows: list, dims: int) -> DataFrame:
        blocks = []
        for i in range(0, len(rows), QUERY_BLOCK):
            part = rows[i : i + QUERY_BLOCK]
            q = np.array([r[2] for r in part], np.float64).reshape(-1, dims)
            ids = np.empty(len(part), object)
            ids[:] = [r[0] for r in part]
            blocks.append(((ids, q, np.linalg.norm(q, axis=1), np.array([r[3] for r in part], bool)), np.array([r[1] for r in part], np.int32)))
        given = sc.broadcast(blocks)  # at most QUERY_BLOCK * SCAN_BLOCKS vectors

        def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in it:
                for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                    keys = b.column(0).to_numpy(zero_copy_only=False)
                    order = np.argsort(keys, kind="stable")
                    keys, x, open_ = keys[order], _matrix(b.column(1), dims)[order], b.column(2).to_numpy(zero_copy_only=False).astype(bool)[order]
                    for block, nos in given.value:
                        query, row, s = _best(x, open_, keys, block, k, exclude_self)
                        cols = (block[0][query].tolist(), nos[query], keys[row].tolist(), s)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

        fits = index.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), (F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))).alias("open"))
        return fits.where(F.col("key").isNotNull() & (F.size("vector") == dims)).mapInArrow(go, lists)

    parts, held, dims = [], [], 0
    for r in stated.toLocalIterator():
        dims = dims or len(r[2])
        if len(r[2]) == dims:
            held.append(r)
        if len(held) == QUERY_BLOCK * SCAN_BLOCKS:
            parts.append(job(held, dims))
            held = []
    if held:
        parts.append(job(held, dims))
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], lists)
    w = Window.partitionBy("query_id", "list_no").orderBy(F.round("score", 12).desc(), "key")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("key", key)


def fuse(lists: DataFrame, key: str, k: int = RRF_K, pool: int = POOL) -> DataFrame:
    """Reciprocal rank fusion: (query_id, key, rrf_score, appears_in, rrf_rank), the pool of best; ties by first appearance."""
    g = lists.groupBy("query_id", key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"), F.count("*").cast("int").alias("appears_in"), F.min(F.struct("list_no", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), "first", key)
    return g.withColumn("rrf_rank", F.row_number().over(w)).where(F.col("rrf_rank") <= pool).select("query_id", key, F.round("rrf", 6).alias("rrf_score"), "appears_in", "rrf_rank")


# --- 4: deduplication of the pool -----------------------------------------------------------------------------------------


def _units(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length, and which of them are there at all; zero rows stay zero."""
    there = np.array([v is not None for v in vectors], bool)
    dims = max((len(v) for v in vectors if v is not None), default=1)
    x = np.array([v if v is not None and len(v) == dims else [0.0] * dims for v in vectors], np.float64).reshape(-1, dims)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=x, where=n > 0), there


def collapse(close: np.ndarray, alike: np.ndarray, place: np.ndarray, legacy: bool = False) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
    """(who stays, pairs of winner and loser, pairs held apart) of items in fused order.

    ``close`` and ``alike`` are square: near enough, and allowed to collapse. The smaller ``place`` wins, of equals the earlier item.
    An item is measured against all later ones that are left; from the first that beats it on it is out of the race, unless ``legacy``.
    """
    stays = np.ones(len(place), bool)
    won: list[tuple[int, int]] = []
    apart: list[tuple[int, int]] = []
    for i in range(len(place)):
        if not stays[i]:
            continue
        near = i + 1 + np.flatnonzero(close[i, i + 1 :] & stays[i + 1 :])
        beats = alike[i, near] & (place[near] < place[i])
        if beats.any() and not legacy:
            near, beats = near[: np.argmax(beats) + 1], beats[: np.argmax(beats) + 1]
        losing = alike[i, near] & ~beats
        stays[near[losing]] = False
        stays[i] = not beats.any()
        apart += [(i, j) for j in near[~alike[i, near]].tolist()]
        won += [(j, i) if b else (i, j) for j, b, ok in zip(near.tolist(), beats.tolist(), alike[i, near].tolist(), strict=True) if ok]
    return stays, won, apart


def dedup_pool(pool: DataFrame, key: str, threshold: float = NEAR, guard: str = "retrieval", legacy: bool = False) -> DataFrame:
    """(query_id, key, rrf_rank, outcome, other, sim): outcome kept, collapsed (into other) or guarded. A group is one query's pool.

    Items of another layer or act never collapse; with the guard of ingestion nor do those of another amended section or of the same document.
    """
    kinds = dict(pool.dtypes)
    same = ["text_layer", "source_act"] + (["amends_section"] if guard == "ingestion" else [])

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rrf_rank")
        q, keys, rank = pdf["query_id"].iloc[0], pdf[key].tolist(), pdf["rrf_rank"].tolist()
        x, there = _units(pdf["vector"].tolist())
        sim = x @ x.T
        code = pdf[same].fillna("").agg("\0".join, axis=1).to_numpy()
        alike = code[:, None] == code[None, :]
        if guard == "ingestion":
            doc = pdf["doc"].fillna("").to_numpy()
            alike &= doc[:, None] != doc[None, :]
        stays, won, apart = collapse((sim >= threshold) & there[:, None] & there[None, :], alike, pdf["authority"].to_numpy(), legacy)
        rows = [(q, keys[i], rank[i], "kept", None, None) for i in np.flatnonzero(stays)]
        rows += [(q, keys[b], rank[b], what, keys[a], round(float(sim[a, b]), 6)) for what, pairs in (("collapsed", won), ("guarded", apart)) for a, b in pairs]
        return pd.DataFrame(rows, columns=["query_id", "key", "rrf_rank", "outcome", "other", "sim"])

    return pool.groupBy("query_id").applyInPandas(go, f"query_id {kinds['query_id']}, key {kinds[key]}, rrf_rank int, outcome string, other {kinds[key]}, sim double").withColumnRenamed("key", key)


# --- 5: reranking and diversity ---------------------------------------------------------------------------------------------


def rerank(pool: DataFrame, key: str, score: Column | None, final: int = FINAL) -> DataFrame:
    """Adds ``rerank_score`` (6 places), ``rerank_fallback`` and ``final_rank``; ties leave the fused order.

    Without a scorer, or where one gave a query's item no score, all of the query's scores are 0 and the fused order stands.
    """
    q = Window.partitionBy("query_id")
    out = pool.withColumn("__s", F.lit(0.0) if score is None else score)
    why = F.lit("reranker_disabled") if score is None else F.when(F.max(F.col("__s").isNull()).over(q), "reranker_load_or_inference_failed")
    out = out.withColumn("rerank_fallback", why.cast("string"))
    out = out.withColumn("rerank_score", F.when(F.col("rerank_fallback").isNull(), F.round("__s", 6)).otherwise(0.0)).drop("__s")
    return out.withColumn("final_rank", F.row_number().over(q.orderBy(F.col("rerank_score").desc(), "rrf_rank", key))).where(F.col("final_rank") <= final)


def mmr_order(rel: np.ndarray, sim: np.ndarray, lam: float = MMR_LAMBDA) -> list[int]:
    """Positions by maximal marginal relevance, the top item first; of equals the first. Relevance is scaled to 0..1, 0.5 where flat."""
    span = np.ptp(rel)
    gain = lam * ((rel - rel.min()) / span if span else np.full(len(rel), 0.5))
    cost, order, i = np.zeros(len(rel)), [], 0
    for _ in rel:
        order.append(i)
        gain[i] = -np.inf
        cost = np.maximum(cost, sim[i])
        i = int(np.argmax(gain - (1 - lam) * cost))
    return order


def diversify(top: DataFrame, key: str, lam: float = MMR_LAMBDA) -> DataFrame:
    """(query_id, key, mmr_rank, mmr_skipped) of queries with ``multi_aspect`` and all vectors; others keep ``final_rank``, with the reason."""
    kinds = dict(top.dtypes)

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("final_rank")
        x, there = _units(pdf["vector"].tolist())
        why = "multi_aspect_not_flagged" if not pdf["multi_aspect"].iloc[0] else None if there.all() else "mmr_vectors_unavailable"
        order = list(range(len(pdf))) if why else mmr_order(pdf["rerank_score"].to_numpy(np.float64), x @ x.T, lam)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "key": pdf[key].to_numpy()[order], "mmr_rank": np.arange(1, len(pdf) + 1), "mmr_skipped": why})

    some = top.select("query_id", F.col(key), "final_rank", "rerank_score", F.coalesce("multi_aspect", F.lit(False)).alias("multi_aspect"), "vector")
    return some.groupBy("query_id").applyInPandas(go, f"query_id {kinds['query_id']}, key {kinds[key]}, mmr_rank int, mmr_skipped string").withColumnRenamed("key", key)


# --- 6: parents --------------------------------------------------------------------------------------------------------------

# What the reader of a context is told.
PARENT_MISSING = "[bare chunk — parent missing]"
TRUNCATED = "[truncated: parent exceeds token budget]"
SELF_PARENTED = "[self-parented — no broader section context]"
AMENDED_BY = {"ratified": ("[earlier text — amended by a later Act]", "[current text — enacted amendment]"), "pending_ratification": ("[settled law since 2018]", "[current text — ratification pending]")}
AMENDED_OTHERWISE = ("[base text — an amendment covers this provision]", "[amendment text — status unverified]")
LAYER_NOTES = {
    ("amendment_overlay", "pending_ratification"): "Amendment overlay: operative text, ratification pending - supersedes the consolidated base where they overlap",
    ("amendment_overlay", "ratified"): "Amendment overlay: enacted amendment not yet merged into the consolidated base - supersedes the base where they overlap",
    ("amendment_overlay", None): "Amendment overlay layer (status: %s)",
    ("consolidated_base", "ratified"): "Consolidated base text (Act + ratified amendments)",
    ("consolidated_base", None): "Consolidated base text layer (status: %s)",
    ("historical_base", None): "Historical text of the Act - superseded, shown only to say what the law used to be",
}
NO_LAYER = "Not part of the consolidated law layers"
PATH_WORDS = ["section", "chapter", "sub-section", "clause", "page", "table", "front", "matter"]


def layer_note(layer: Column, status: Column) -> Column:
    """What a chunk's layer and status mean, in a sentence; null where it has no layer. A missing status reads None."""
    status = T.spelled(status)
    out = F.lit(NO_LAYER)
    for (name, state), note in reversed(LAYER_NOTES.items()):
        hit = layer == name if state is None else (layer == name) & (status == state)
        out = F.when(F.coalesce(hit, F.lit(False)), F.format_string(note, F.coalesce(status, F.lit("None"))) if "%s" in note else F.lit(note)).otherwise(out)
    return F.when(F.coalesce(layer, F.lit("")) != "", out)


def overlay_labels(status: Column) -> Column:
    """struct<base, overlay> labels by the overlay's legal status."""
    pair = lambda p: F.struct(F.lit(p[0]).alias("base"), F.lit(p[1]).alias("overlay"))
    out = pair(AMENDED_OTHERWISE)
    for state, labels in AMENDED_BY.items():
        out = F.when(T.spelled(status) == state, pair(labels)).otherwise(out)
    return out


def parent_label(kind: Column, base: Column | None = None) -> Column:
    """The label that a chunk gets for its parent's kind (null: missing), after one that it has."""
    base = F.coalesce(base, F.lit("")) if base is not None else F.lit("")
    return F.when(kind.isNull(), PARENT_MISSING).when(kind == "self", F.trim(F.concat(base, F.lit(" " + SELF_PARENTED)))).otherwise(base)


def within_budget(tokens: Column, budget: int = BUDGET) -> Column:
    """For an array of tokens in order, whether each item is in: one that would go over is left out and not counted, smaller later ones may fit; the first always does."""
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("out"))

    def step(s, t):
        over = (s.used > 0) & (s.used + t > budget)
        return F.struct(F.when(over, s.used).otherwise(s.used + t).alias("used"), F.concat(s.out, F.array(~over)).alias("out"))

    return F.aggregate(F.transform(tokens, lambda t: t.cast("bigint")), zero, step, lambda s: s.out)


def with_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children with ``parent_kind``, ``content``, ``tokens`` and ``label``: missing_parent, self, table or section; none is dropped."""
    p = parents.select(F.col("parent_id"), F.col("kind").alias("parent_kind"), T.parent_content(F.col("kind"), F.col("text"), F.col("table_json")).alias("content"), T.content_tokens(F.col("kind"), F.col("text"), F.col("table_json")).alias("tokens"))
    return children.join(p, "parent_id", "left").withColumn("label", F.when(F.col("parent_kind").isNull(), "missing_parent").when(F.col("parent_kind") == "prose", "section").otherwise(F.col("parent_kind")))


def resolve(top: DataFrame, key: str, parents: DataFrame, budget: int = BUDGET, dedupe_parents: bool = False) -> DataFrame:
    """``with_parents``, and the label truncated where a parent goes over the budget. A walk is one query's few rows."""
    j = with_parents(top, parents)
    if dedupe_parents:
        w = Window.partitionBy("query_id", "parent_id").orderBy("final_rank")
        j = j.withColumn("__again", F.row_number().over(w) > 1).withColumn("tokens", F.when(F.col("__again"), 0).otherwise(F.col("tokens"))).drop("__again")
    all_ = Window.partitionBy("query_id").orderBy("final_rank", key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.col("parent_kind").isNotNull()
    place = F.count(F.when(here, 1)).over(Window.partitionBy("query_id").orderBy("final_rank", key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = F.try_element_at(within_budget(F.collect_list(F.when(here, F.col("tokens"))).over(all_), budget), place.cast("int"))
    return j.withColumn("__fits", fits).withColumn("label", F.when(here & ~F.col("__fits"), "truncated").otherwise(F.col("label"))).drop("__fits")


# --- 7: overlays and provisions ---------------------------------------------------------------------------------------------


def path_tokens(path: Column) -> Column:
    """The words of a section path in order, without those that any path has; null for an empty path."""
    words = F.split(F.trim(F.regexp_replace(F.lower(path), r"[^\p{L}\p{N}_]+", " ")), " ")
    return F.when(F.coalesce(path, F.lit("")) != "", F.array_join(F.filter(words, lambda w: ~w.isin(PATH_WORDS)), " "))


def same_provision(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether two chunks cover the same provision; ``a`` and ``b`` give their columns.

    An overlay covers the base sections that it says it amends. On the same side section numbers decide, or paths where one is missing.
    """
    over = lambda x: F.coalesce(x("text_layer"), F.lit("")) == "amendment_overlay"
    number = lambda x: F.nullif(x("section_number"), F.lit(""))
    names = lambda o, base: F.coalesce(F.array_contains(T.unflat_list(o("amends_section")), number(base)), F.lit(False))
    same = F.when(number(a).isNotNull() & number(b).isNotNull(), number(a) == number(b)).otherwise(F.coalesce(path_tokens(a("section_path")) == path_tokens(b("section_path")), F.lit(False)))
    return F.when(over(a) & ~over(b), names(a, b)).when(over(b) & ~over(a), names(b, a)).otherwise(same)


def provision_links(df: DataFrame, key: str) -> DataFrame:
    """(key, n_links): how many other chunks of its side cover each chunk's provision. Counts by number and by path are joined, so no pairs arise."""
    c = df.select(F.col(key), (F.coalesce("text_layer", F.lit("")) == "amendment_overlay").alias("side"), F.nullif("section_number", F.lit("")).alias("num"), path_tokens(F.col("section_path")).alias("path"))
    num = c.where("num is not null").groupBy("side", "num").agg(F.count("*").alias("n_num"))
    path = c.where("path is not null").groupBy("side", "path").agg(F.count("*").alias("n_path"), F.count_if(F.col("num").isNull()).alias("n_bare"))
    z = lambda x: F.coalesce(F.col(x), F.lit(0))
    n = F.when(F.col("num").isNotNull(), z("n_num") - 1 + z("n_bare")).otherwise(F.greatest(z("n_path") - 1, F.lit(0)))
    return c.join(num, ["side", "num"], "left").join(path, ["side", "path"], "left").select(key, n.alias("n_links"))


def amended_sections(df: DataFrame, *cols: str) -> DataFrame:
    """(cols, section) for each section that an overlay amends; the join with base sections is one of equality."""
    over = df.where("text_layer = 'amendment_overlay'")
    return over.select(*cols, F.explode(F.array_distinct(T.unflat_list(F.col("amends_section")))).alias("section"))


def base_sections(df: DataFrame) -> DataFrame:
    return df.where("text_layer = 'consolidated_base' and section_number <> ''").withColumn("section", F.col("section_number"))


def amendment_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, n_base): of each overlay chunk how many base chunks it amends. Base chunks are counted by section before they are joined."""
    n = base_sections(df).groupBy("section").agg(F.count("*").alias("n"))
    return amended_sections(df, key).join(n, "section").groupBy(key).agg(F.sum("n").alias("n_base"))


def overlays(context: DataFrame, key: str) -> DataFrame:
    """(query_id, base, overlay, labels): base chunks and the amending chunks of the same context that name their section; a whole-act overlay pairs with none."""
    over = amended_sections(context, "query_id", F.col(key).alias("overlay"), overlay_labels(F.col("legal_status")).alias("labels"), F.col("final_rank").alias("o_rank"))
    base = base_sections(context).select("query_id", F.col(key).alias("base"), "section", F.col("final_rank").alias("b_rank"))
    return base.join(over, ["query_id", "section"]).drop("section").distinct()


def with_overlays(context: DataFrame, key: str) -> DataFrame:
    """Adds ``notes``, the partners' keys, and ``text_label``: the parent's label and those of the chunk's pairs, each once, in order. Nothing is dropped or moved."""
    o = overlays(context, key)
    at = F.struct("b_rank", "o_rank").alias("at")
    each = o.select("query_id", F.col("base").alias(key), at, F.concat(F.lit("amended by "), F.col("overlay")).alias("n"), F.col("labels.base").alias("l")).unionByName(o.select("query_id", F.col("overlay").alias(key), at, F.concat(F.lit("amends "), F.col("base")).alias("n"), F.col("labels.overlay").alias("l")))
    got = each.groupBy("query_id", key).agg(F.array_sort(F.collect_set("n")).alias("notes"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "l"))), lambda x: x.l)).alias("labels"))
    out = context.join(got, ["query_id", key], "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))
    own = parent_label(F.col("parent_kind")) if "parent_kind" in context.columns else F.lit("")
    return out.withColumn("text_label", F.array_join(F.filter(F.concat(F.array(own), F.coalesce("labels", F.array().cast("array<string>"))), lambda x: x != ""), " ")).drop("labels")


def lookup(keys: DataFrame, key: str, table: DataFrame, cols: list[str], blank: bool = False, order: str | None = None) -> DataFrame:
    """The columns of each key's first record in ``table`` by ``order`` (without one the least); null, or '' for texts with ``blank``, where it has none."""
    r = F.struct(*cols)
    one = table.groupBy(key).agg((F.min_by(r, order) if order else F.min(r)).alias("r")).select(key, "r.*")
    out = keys.join(one, key, "left")
    return out.select(*keys.columns, *[F.coalesce(c, F.lit("")).alias(c) if blank else F.col(c) for c in cols])


# --- all stages ---------------------------------------------------------------------------------------------------------------

META = ["doc", "text", "parent_id", "text_layer", "legal_status", "source_act", "section_number", "amends_section", "vector"]


def stages(index: DataFrame, envelopes: DataFrame, parents: DataFrame, embed: Callable[[Column], Column], key: str = "chunk_id", near: float = NEAR, score: Callable[[Column, Column], Column] | None = lexical_score) -> dict[str, DataFrame]:
    """All queries through all stages; ``index``: chunk columns and vector, ``envelopes``: see ``expand``. What several stages read is stored once."""
    env = stored(envelopes)
    variants = stored(variant_lists(env, embed))
    lists = stored(search(index, variants, key, "vector", eligible=applies()))
    meta = index.select(key, *META, T.authority_order(F.col("authority_rank")).alias("authority"))
    pool = stored(fuse(lists, key).join(meta, key).join(env.select("query_id", "original", "multi_aspect"), "query_id"))
    outcome = stored(dedup_pool(pool.select("query_id", key, "rrf_rank", "doc", "text_layer", "source_act", "amends_section", "authority", "vector"), key, near))
    kept = outcome.where("outcome = 'kept'").select("query_id", key)
    top = rerank(pool.join(kept, ["query_id", key], "left_semi"), key, score(F.col("original"), F.col("text")) if score else None)
    top = stored(top.select("query_id", key, "rrf_rank", "final_rank", "rerank_score", "rerank_fallback", "multi_aspect", *[c for c in META if c != "text"]))
    order = diversify(top, key)
    ranked = top.join(order, ["query_id", key]).withColumn("final_rank", F.col("mmr_rank")).drop("mmr_rank", "vector", "multi_aspect")
    final = stored(with_overlays(resolve(ranked, key, parents), key))
    return {"1": env, "2v": variants, "2": lists, "3": pool, "4": outcome, "5": top, "6": final}


def context(done: dict[str, DataFrame], key: str) -> DataFrame:
    return done["6"].select("query_id", key, "final_rank", "rrf_rank", "rerank_score", "parent_id", "label", "text_label", "tokens", "notes")


def retrieve(index: DataFrame, envelopes: DataFrame, parents: DataFrame, embed: Callable[[Column], Column], key: str = "chunk_id", **how) -> DataFrame:
    """The final context of every query, in order."""
    return context(stages(index, envelopes, parents, embed, key, **how), key)


# --- trace ---------------------------------------------------------------------------------------------------------------

STAGES = ["1", "2", "3", "4", "5", "5b", "6", "7"]


def trace(done: dict[str, DataFrame], key: str, required: list[str] = STAGES) -> DataFrame:
    """One row per query: variants, flags, a record of each stage (rows, fallbacks, note), all fallbacks, the context, the labelled pairs, problems.

    Every query has every stage, also where it came to nothing. Fallbacks are those that a stage had to take: see ``expand`` for stage 1;
    variant_failed, empty_fusion, empty_fused_pool, empty_deduped_pool, the reranker's, mmr_vectors_unavailable, missing_parent, parent_truncated.
    """
    env = done["1"]
    n, none = F.count("*"), F.array().cast("array<string>")
    reason = lambda hit, name: F.array_compact(F.array(F.when(hit, name)))
    per = {
        "2": done["2"].groupBy("query_id").agg(n.alias("n2")),
        "2v": done["2v"].groupBy("query_id").agg(F.count_if(F.col("vector").isNull()).alias("failed")),
        "3": done["3"].groupBy("query_id").agg(n.alias("n3")),
        "4": done["4"].groupBy("query_id").agg(F.count_if(F.col("outcome") == "kept").alias("n4"), F.count_if(F.col("outcome") == "collapsed").alias("collapsed"), F.count_if(F.col("outcome") == "guarded").alias("guarded")),
        "5": done["5"].groupBy("query_id").agg(n.alias("n5"), F.max("rerank_fallback").alias("f5")),
        "6": done["6"].groupBy("query_id").agg(n.alias("n6"), F.max("mmr_skipped").alias("f5b"), F.max(F.col("label") == "missing_parent").alias("bare"), F.max(F.col("label") == "truncated").alias("cut"), F.array_sort(F.collect_list(F.struct("final_rank", F.col(key).alias("key"), "label", "text_label"))).alias("final_context")),
        "7": overlays(done["6"], key).groupBy("query_id").agg(n.alias("n7"), F.array_sort(F.collect_list(F.struct("base", "overlay", "labels"))).alias("dual_layer_pairs")),
    }
    j = reduce(lambda a, b: a.join(b, "query_id", "left"), per.values(), env)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    mmr = F.when(z("n6") == 0, "empty").otherwise(F.col("f5b"))
    record = {
        "1": (F.size("variants").cast("long"), reason(F.col("fallback").isNotNull(), F.col("fallback")), F.lit("")),
        "2": (z("n2"), reason(z("failed") > 0, "variant_failed"), F.lit("")),
        "3": (z("n3"), reason(z("n3") == 0, "empty_fusion"), F.lit("")),
        "4": (z("n4"), reason(z("n3") == 0, "empty_fused_pool"), F.format_string("collapsed %d, guarded %d", z("collapsed"), z("guarded"))),
        "5": (z("n5"), F.when(z("n4") == 0, F.array(F.lit("empty_deduped_pool"))).otherwise(reason(F.col("f5").isNotNull(), F.col("f5"))), F.lit("")),
        "5b": (z("n6"), reason(mmr == "mmr_vectors_unavailable", mmr), F.coalesce(mmr, F.lit("applied"))),
        "6": (z("n6"), F.array_compact(F.array(F.when(F.col("bare"), "missing_parent"), F.when(F.col("cut"), "parent_truncated"))), F.lit("")),
        "7": (z("n7"), none, F.lit("")),
    }
    cells = [F.struct(F.lit(s), F.struct(r.alias("rows"), F.coalesce(f, none).alias("fallbacks"), t.alias("note"))) for s, (r, f, t) in record.items()]
    j = j.withColumn("stages", F.map_from_entries(F.array(*cells)))
    j = j.withColumn("overall_fallbacks", F.flatten(F.transform(F.map_entries("stages"), lambda e: F.transform(e.value.fallbacks, lambda r: F.concat(e.key, F.lit(":"), r)))))
    pairs = F.coalesce("dual_layer_pairs", F.array().cast(j.schema["dual_layer_pairs"].dataType))
    entries = F.coalesce("final_context", F.array().cast(j.schema["final_context"].dataType))
    j = j.withColumn("dual_layer_pairs", pairs).withColumn("final_context", entries)
    out = j.select("query_id", "original", "variants", F.struct("multi_aspect", "historical").alias("flags"), "stages", "overall_fallbacks", "final_context", "dual_layer_pairs")
    return out.withColumn("problems", problems(required)).withColumn("ok", F.size("problems") == 0)


def problems(required: list[str] = STAGES) -> Column:
    """What is wrong with a trace: stages missing, no context, diversity neither applied nor excused, fallbacks not covered, pairs not labelled."""
    s = F.col("stages")
    labelled = F.transform(F.filter("final_context", lambda c: c.text_label != ""), lambda c: c.key)
    bare = F.exists("dual_layer_pairs", lambda p: ~F.array_contains(labelled, p.base) | ~F.array_contains(labelled, p.overlay))
    covered = F.transform(F.filter(F.map_entries(s), lambda e: F.size(e.value.fallbacks) > 0), lambda e: e.key)
    known = F.transform("overall_fallbacks", lambda x: F.substring_index(x, ":", 1))
    gone = F.array_except(F.array(*[F.lit(x) for x in required]), F.map_keys(s))
    checks = [
        F.when(F.size(gone) > 0, F.concat(F.lit("missing stages: "), F.array_join(F.array_sort(gone), ","))),
        F.when(F.size("final_context") == 0, F.lit("empty context")),
        F.when(F.coalesce(s["5b"]["note"], F.lit("")) == "", F.lit("diversity neither applied nor excused")),
        F.when(F.size(F.array_except(covered, known)) > 0, F.lit("fallback not covered")),
        F.when(bare, F.lit("pair without labels")),
    ]
    return F.array_compact(F.array(*checks))
