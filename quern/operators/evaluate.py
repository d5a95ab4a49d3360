"""Retrieval evaluation: recall, reciprocal rank, roll-ups, latency medians, method against method, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Recall cut-offs.
CUTOFFS = (1, 5, 10, 20)
#: Verdict ladders by experiment: (measure, least, verdict), first that holds, and what else holds.
LADDERS: dict[str, tuple[list[tuple[str, float, str]], str]] = {
    "maxsim": ([("r", 0.50, "STRONG_SIGNAL"), ("r", 0.20, "MIXED_SIGNAL")], "BET_WRONG"),
    "frozen": ([("delta", 0.05, "STRONG_HEADROOM"), ("delta", 0.02, "MODEST_HEADROOM")], "CEILING"),
    "hybrid": ([("r", 0.75, "COMPETITIVE"), ("r", 0.55, "IMPROVEMENT_NOT_COMPETITIVE"), ("over", 0.02, "MARGINAL_GAIN")], "FILTER_LIMITED"),
    "multigranular": ([("delta", 0.06, "STRONG_MULTIGRAN"), ("delta", 0.02, "MODEST_MULTIGRAN"), ("delta", -0.02, "NO_LIFT")], "HURTS"),
    "nested": ([("r", 0.50, "STRONG_HIERARCHICAL"), ("delta", 0.012, "MODEST_HIERARCHICAL"), ("delta", -0.02, "NO_LIFT")], "HURTS"),
    "routing": ([("r", 0.55, "STRONG_LIFT"), ("r", 0.46, "MODEST_LIFT"), ("delta", -0.02, "NO_LIFT")], "HURTS"),
}


def verdict(experiment: str, r: Column, delta: Column) -> Column:
    """Verdict for a recall at 10 and its difference to the baseline; 'over' is strict."""
    steps, other = LADDERS[experiment]
    out = None
    for measure, least, name in steps:
        holds = delta > least if measure == "over" else (r if measure == "r" else delta) >= least
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise(other)


def instance_metrics(ranking: DataFrame, gold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, query_id, n_gold, recall_1 .. recall_20, mrr): a row for each query of gold and each method of the ranking.

    ranking: (by, query_id, file_id, rk); gold: (query_id, file_id, ...), no row or a null file for empty gold, which has
    recall 0.
    """
    by = by or []
    queries = gold.groupBy("query_id").agg(F.count_distinct("file_id").alias("n_gold"))
    if by:
        queries = queries.join(F.broadcast(ranking.select(*by).distinct()), on=F.lit(True), how="inner")
    hits = ranking.join(gold.select("query_id", "file_id").distinct(), ["query_id", "file_id"])
    hits = hits.groupBy(*by, "query_id").agg(*(F.count_if(F.col("rk") <= k).alias(f"hit_{k}") for k in CUTOFFS), F.min("rk").alias("first"))
    both = queries.join(hits, [*by, "query_id"], "left")
    recall = [F.when(F.col("n_gold") > 0, F.coalesce(F.col(f"hit_{k}"), F.lit(0)) / F.col("n_gold")).otherwise(F.lit(0.0)).alias(f"recall_{k}") for k in CUTOFFS]
    return both.select(*by, "query_id", "n_gold", *recall, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def means(metrics: DataFrame, by: list[str]) -> DataFrame:
    cols = [f"recall_{k}" for k in CUTOFFS] + ["mrr"]
    return metrics.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in cols))


def repo_rollup(metrics: DataFrame) -> DataFrame:
    """Per repository and over all (repo null): raw and indexable recall at 10, MRR; metrics has repo and gold_in_index."""
    indexable = F.when(F.col("gold_in_index"), F.col("recall_10"))
    return metrics.rollup("repo").agg(
        F.count("*").alias("n"), F.count_if("gold_in_index").alias("n_indexable"),
        F.round(F.avg("recall_10"), 6).alias("recall_10"), F.round(F.avg(indexable), 6).alias("indexable_recall_10"), F.round(F.avg("mrr"), 6).alias("mrr"),
    )


def hardest_easiest(per_repo: DataFrame) -> DataFrame:
    """The repositories with the least and the greatest recall at 10; the first by name of equal ones."""
    rows = per_repo.filter(F.col("repo").isNotNull())
    return rows.agg(F.min_by("repo", F.struct("recall_10", "repo")).alias("hardest"), F.min_by("repo", F.struct(-F.col("recall_10"), "repo")).alias("easiest"))


def latency_medians(log: DataFrame, by: str, latency: str) -> DataFrame:
    """Median of positive latencies (0 if none), median of all, and the upper median: the element at n // 2 when sorted.

    The upper median is picked by rank in a window, so no group is gathered into one array.
    """
    x = F.col(latency)
    w = Window.partitionBy(by)
    ranked = log.filter(x.isNotNull()).withColumn("_rn", F.row_number().over(w.orderBy(x))).withColumn("_n", F.count("*").over(w))
    upper = ranked.groupBy(by).agg(F.max(F.when(F.col("_rn") == F.floor(F.col("_n") / 2) + 1, x)).alias("upper_median"))
    both = log.groupBy(by).agg(F.coalesce(F.median(F.when(x > 0, x)), F.lit(0.0)).alias("positive_median"), F.median(x).alias("median"), F.avg(x).alias("mean"))
    return both.join(upper, by)


def rescues(ranking: DataFrame, first_gold: DataFrame, baseline: str, k: int = 10) -> DataFrame:
    """Per method, queries whose first gold file it has among k and the baseline hasn't, and the reverse."""
    hit = ranking.join(first_gold, ["query_id", "file_id"]).filter(F.col("rk") <= k).select("method", "query_id").distinct()
    base = hit.filter(F.col("method") == baseline).select("query_id", F.lit(True).alias("base"))
    grid = first_gold.select("query_id").distinct().join(F.broadcast(ranking.select("method").distinct()), on=F.lit(True))
    flags = grid.join(hit.withColumn("hit", F.lit(True)), ["method", "query_id"], "left").join(base, "query_id", "left")
    h, b = F.coalesce("hit", F.lit(False)), F.coalesce("base", F.lit(False))
    return flags.groupBy("method").agg(F.count_if(h & ~b).alias("rescues"), F.count_if(~h & b).alias("regressions"), F.count_if(h & b).alias("both"))


def overlap(a: DataFrame, b: DataFrame, k: int = 10, least: int = 5) -> DataFrame:
    """Per query, how many of the first k files two rankings share and whether that is enough."""
    pick = lambda r: r.filter(F.col("rk") <= k).select("query_id", "file_id")
    both = pick(a).join(pick(b), ["query_id", "file_id"]).groupBy("query_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return a.select("query_id").distinct().join(both, "query_id", "left").select("query_id", n.alias("overlap"), (n >= least).alias("sanity_ok"))


def strict_then_expanded(rows: DataFrame, strict: Column, expanded: Column, trigger: int = 30, size: int = 80, seed: int = 42) -> DataFrame:
    """Strict rows; if fewer than trigger, expanded ones too; at most size of them in order of a seeded hash, by id."""
    classed = rows.withColumn("tier", F.when(strict, "strict").when(expanded, "expanded")).filter("tier is not null")
    counts = classed.agg(F.count_if(F.col("tier") == "strict").alias("n_strict"))
    kept = classed.join(F.broadcast(counts), on=F.lit(True)).filter((F.col("tier") == "strict") | (F.col("n_strict") < trigger))
    return seeded_sample(kept.select("query_id", "tier"), "query_id", size, seed)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in order of an md5 of key and seed: the same rows on every cluster."""
    return rows.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))).orderBy("_h", key).limit(n).drop("_h")


def popularity(ranking: DataFrame, k: int = 10) -> DataFrame:
    """Share of all queries that have a file among their first k, by file."""
    n = ranking.select("query_id").distinct().agg(F.count("*").alias("n_queries"))
    found = ranking.filter(F.col("rk") <= k).groupBy("file_id").agg(F.count_distinct("query_id").alias("n"))
    return found.join(F.broadcast(n), on=F.lit(True)).select("file_id", "n", F.round(F.col("n") / F.col("n_queries"), 6).alias("share"))


def method_deltas(summary: DataFrame, baseline: str) -> DataFrame:
    """Each method's means less the baseline's."""
    cols = ["recall_10", "mrr"]
    base = summary.filter(F.col("method") == baseline).select(*(F.col(c).alias(f"b_{c}") for c in cols))
    return summary.join(F.broadcast(base), on=F.lit(True)).select("method", *(F.round(F.col(c) - F.col(f"b_{c}"), 6).alias(f"delta_{c}") for c in cols))
