"""Pluggable models: encoders, rerankers, identifier generators; deterministic stand-ins for tests."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Retriever(Protocol):
    """What an evaluation needs: an index of a corpus, and a ranking (query_id, file_id, score, rk) of queries."""

    def index(self, corpus: DataFrame) -> DataFrame: ...
    def search(self, queries: DataFrame, index: DataFrame, k: int) -> DataFrame: ...


def bag_of_words(text: Column, dim: int = 64) -> Column:
    """Hashed word counts of unit length, as built-in functions."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    return F.transform(counts, lambda x: x / F.greatest(F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, b: a + b * b)), F.lit(1e-12)))


def encode(rows: DataFrame, load, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, tokens): load() makes a model once a worker; model(list of texts) gives a list of token matrices."""
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + ", tokens array<array<double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield b[keep].assign(tokens=[np.asarray(m).tolist() for m in model(b[text].fillna("").tolist())])

    return rows.select(*keep, text).mapInPandas(run, schema)


def jaccard(a: Column, b: Column) -> Column:
    """Cross-encoder stand-in: shared words of all distinct words."""
    words = lambda x: F.array_distinct(F.filter(F.split(x, " "), lambda w: w != ""))
    x, y = words(a), words(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def score_pairs(pairs: DataFrame, load, query: str = "query_text", document: str = "doc_text") -> DataFrame:
    """pairs with score from a model of (query, document) lists, in Arrow batches; load() runs once a worker."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, d in batches:
            yield pd.Series(model(q.tolist(), d.tolist()), dtype=float)

    return pairs.withColumn("score", score(query, document))


def expand_identifiers(idents: DataFrame, generated: DataFrame, most: int = 20) -> DataFrame:
    """Identifiers (query_id, idents) followed by new generated ones (query_id, generated), at most most of these."""
    both = idents.join(generated, "query_id", "left")
    new = F.slice(F.coalesce("generated", F.array().cast("array<string>")), 1, most)
    return both.select("query_id", F.array_distinct(F.concat("idents", new)).alias("idents"))


def last_position(spans: DataFrame, by: list[str], order: str, vec: str = "vec") -> DataFrame:
    """The vector at the last position."""
    return spans.groupBy(*by).agg(F.max_by(vec, order).alias(vec))


def decayed_mean(spans: DataFrame, by: list[str], order: str, vec: str = "vec", decay: float = 0.5) -> DataFrame:
    """Stand-in for encoding a file from its functions: a recurrence s = decay * s + (1 - decay) * v over ordered spans.

    A file's spans are bounded (MAX_SPANS), so they are gathered; files without spans have no row.
    """
    rows = spans.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, vec))).alias("x"))
    first = F.transform(F.get("x", F.lit(0))[vec], lambda a: F.lit(0.0))
    return rows.select(*by, F.aggregate("x", first, lambda s, p: F.zip_with(s, p[vec], lambda a, b: a * decay + b * (1 - decay))).alias(vec))
