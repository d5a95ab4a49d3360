"""Ranking: dedup to file, top k, over-fetch, rerank, min-max fusion, routing, rank ensembles.

A ranking is (query_id, file_id, score, rk); scores are rounded to 6 places before they are ranked and ties go to the
file that sorts first, so that ranks are the same on every engine and cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import min_max


def ranked(scores: DataFrame, k: int = 20, by: str = "query_id", extra: list | None = None) -> DataFrame:
    """The best k rows of each query; Spark keeps k a partition before it shuffles (WindowGroupLimit)."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), *(extra or []), "file_id")
    return scores.withColumn("score", F.round("score", 6)).withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)


def best_per_file(scores: DataFrame) -> DataFrame:
    return scores.groupBy("query_id", "file_id").agg(F.max("score").alias("score"))


def top_files(scores: DataFrame, k: int = 20) -> DataFrame:
    """Chunks to their file, then the best k files."""
    return ranked(best_per_file(scores), k)


def over_fetched(scores: DataFrame, k: int = 20, n: int | None = None) -> DataFrame:
    """Only the best n chunks are looked at, max(10 k, 100) by default, so fewer than k files may be left."""
    n = n or max(10 * k, 100)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "file_id", "chunk_id")
    first = scores.withColumn("score", F.round("score", 6)).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)
    return top_files(first, k)


def reranked(shortlist: DataFrame, scores: DataFrame, k: int = 20) -> DataFrame:
    """A shortlist in order of new scores; ties keep the shortlist's order. Files without a new score are left out."""
    both = shortlist.select("query_id", "file_id", F.col("rk").alias("old_rk")).join(scores.select("query_id", "file_id", "score"), ["query_id", "file_id"])
    return ranked(both, k, extra=["old_rk"]).select("query_id", "file_id", "score", "rk")


def scaled(scores: DataFrame, name: str) -> DataFrame:
    """(query_id, file_id, name): scores on each query's range."""
    w = Window.partitionBy("query_id")
    return scores.select("query_id", "file_id", min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w)).alias(name))


def by_level(parts: dict[str, DataFrame]) -> DataFrame:
    """(query_id, file_id, a column per level): the best score of each, null where a level lacks the file.

    Levels (query_id, file_id, score) may have several rows a file. They are dealt out by query once, and what follows for
    a query's files (ranges, ranks) stays there.
    """
    rows = reduce(DataFrame.unionByName, (df.select("query_id", "file_id", F.lit(i).cast("byte").alias("level"), "score") for i, df in enumerate(parts.values())))
    best = (F.max(F.when(F.col("level") == i, F.col("score"))).alias(name) for i, name in enumerate(parts))
    return rows.repartition("query_id").groupBy("query_id", "file_id").agg(*best)


def fused(parts: dict[str, DataFrame], how: str = "sum", weight: float = 0.25) -> DataFrame:
    """Scores of several levels, each scaled on a query's range, as one: weighted sum or maximum; of files that all levels have."""
    w = Window.partitionBy("query_id")
    both = by_level(parts).select("query_id", "file_id", *(min_max(F.col(n), F.min(n).over(w), F.max(n).over(w)).alias(n) for n in parts), reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in parts)).alias("_all"))
    cols = [F.col(n) for n in parts]
    score = F.greatest(*cols) if how == "max" else reduce(lambda a, b: a + b, (c * weight for c in cols))
    return both.filter("_all").select("query_id", "file_id", score.alias("score"))


def routed(parts: dict[str, DataFrame], routes: DataFrame) -> DataFrame:
    """Each query's scores at its one level; routes: (query_id, level)."""
    every = reduce(DataFrame.unionByName, (df.select("query_id", "file_id", "score", F.lit(name).alias("level")) for name, df in parts.items()))
    return every.join(routes, ["query_id", "level"]).select("query_id", "file_id", "score", "level")


def scaled_with_missing(scores: DataFrame, grid: DataFrame, name: str) -> DataFrame:
    """Scaled over the files of a query; a missing file has 0, and with fewer than two present all have 0.5."""
    w = Window.partitionBy("query_id")
    both = grid.join(scores.select("query_id", "file_id", "score"), ["query_id", "file_id"], "left")
    value = min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w))
    return both.select("query_id", "file_id", F.when(F.count("score").over(w) < 2, F.lit(0.5)).otherwise(F.coalesce(value, F.lit(0.0))).alias(name))


def composite(levels: dict[str, DataFrame]) -> DataFrame:
    """Mean of levels, each scaled on a query's range, over all files that any level has: a missing file has 0 in a level, and where fewer than two are present all have 0.5."""
    w = Window.partitionBy("query_id")
    scaled = lambda n: F.when(F.count(n).over(w) < 2, F.lit(0.5)).when(F.col(n).isNull(), F.lit(0.0)).otherwise(min_max(F.col(n), F.min(n).over(w), F.max(n).over(w)))
    both = by_level(levels).select("query_id", "file_id", *(scaled(n).alias(n) for n in levels))
    return both.select("query_id", "file_id", (reduce(lambda a, b: a + b, (F.col(n) for n in levels)) / len(levels)).alias("score"))


def rank_ensemble(rankings: DataFrame, k: int = 20) -> DataFrame:
    """Best rank of a file over methods (query_id, method_order, file_id, rk); ties by where it first stood."""
    best = rankings.groupBy("query_id", "file_id").agg(F.min("rk").alias("best"), F.min(F.struct("method_order", "rk")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy("best", "seen")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "file_id", (1 - F.col("best")).cast("double").alias("score"), F.col("rank").alias("rk"))
