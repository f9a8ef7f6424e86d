"""Where models are plugged in: an embedder, a scorer of pairs, a model that replies in JSON.

A loader is a function without arguments that gives the model; it runs once per task on the executor, so a model is never sent
through the plan. Models take whole Arrow batches. What a model raises costs its batch, not the job: an embedder's and a scorer's
rows become null and a replier's are marked as failed, which the stages record as fallbacks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkwell.functions import text as T

Embed = Callable[[list[str]], np.ndarray]
Score = Callable[[list[str], list[str]], np.ndarray]
Reply = Callable[[list[str]], list[str | None]]


def embedder(load: Callable[[], Embed]) -> Callable[[Column], Column]:
    """Text -> array<float>; null texts are empty ones."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for texts in batches:
            try:
                model = model or load()
                yield pd.Series(list(np.asarray(model(texts.fillna("").tolist()), np.float32)), dtype=object)
            except Exception:  # noqa: BLE001  (whatever a model raises)
                yield pd.Series([None] * len(texts), dtype=object)

    return vectors


def pair_scorer(load: Callable[[], Score]) -> Callable[[Column, Column], Column]:
    """(query, text) -> double."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = None
        for a, b in batches:
            try:
                model = model or load()
                yield pd.Series(np.asarray(model(a.fillna("").tolist(), b.fillna("").tolist()), np.float64))
            except Exception:  # noqa: BLE001
                yield pd.Series([None] * len(a), dtype="float64")

    return scores


def replier(load: Callable[[], Reply]) -> Callable[[Column], Column]:
    """Prompt -> struct<reply string, failed boolean>."""

    @F.pandas_udf("reply string, failed boolean")
    def replies(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = None
        for prompts in batches:
            try:
                model = model or load()
                yield pd.DataFrame({"reply": model(prompts.fillna("").tolist()), "failed": False})
            except Exception:  # noqa: BLE001
                yield pd.DataFrame({"reply": [None] * len(prompts), "failed": True})

    return replies


def prompt(query: Column, most: int = 3) -> Column:
    """What a replier is asked."""
    return F.concat(F.lit(f"Rewrite the query in up to {most} ways that a statute would put it. Answer with one JSON object: variants (list of strings), multi_aspect (boolean), historical (boolean).\nQuery: "), query)


def hashed_words(dims: int = 64) -> Callable[[], Embed]:
    """The deterministic stand-in for an embedding model: counts of words, each in one of ``dims`` places by its md5, to unit length; blank texts are zero."""

    def load() -> Embed:
        known: dict[str, int] = {}

        def place(w: str) -> int:
            k = known.get(w)
            if k is None:
                k = int.from_bytes(hashlib.md5(w.encode(), usedforsecurity=False).digest()[:4], "big") % dims
                if len(known) < 500_000:
                    known[w] = k
            return k

        def model(texts: list[str]) -> np.ndarray:
            words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
            n = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            enc = words.flatten().dictionary_encode()
            at = np.array([place(w) if w else dims for w in enc.dictionary.to_pylist()], np.int64)[enc.indices.to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(len(texts)), n)
            out = np.bincount(row[at < dims] * dims + at[at < dims], minlength=len(texts) * dims).reshape(-1, dims).astype(np.float64)
            norm = np.sqrt((out**2).sum(1, keepdims=True))
            return np.divide(out, norm, out=out, where=norm > 0)

        return model

    return load


def embed(text: Column, dims: int = 64, load: Callable[[], Embed] | None = None) -> Column:
    """The vector of a text; the stand-in sees words in lower case, white space made one blank."""
    return embedder(load)(text) if load else embedder(hashed_words(dims))(F.lower(T.normalize(text)))


def lexical_score(query: Column, text: Column) -> Column:
    """The stand-in for a cross-encoder: the share of the query's distinct words that the text has."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(T.normalize(t)), r"[\p{P}\p{S}]+", ""), " +"), lambda w: w != ""))
    n = F.size(words(query))
    return F.when(n > 0, F.size(F.array_intersect(words(query), words(text))) / n).otherwise(F.lit(0.0))
