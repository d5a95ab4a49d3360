"""Vector-quality statistics, drift between two encodings, histograms, memory estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import cosine, dot, norm

#: Mean above and deviation below which pairwise cosines have collapsed; sample; histogram bins.
COLLAPSE_MEAN, COLLAPSE_STD, SAMPLE, BINS = 0.9, 0.05, 1000, 10


def _r(c):
    return F.round(c, 6)


def sampled(vectors: DataFrame, n: int = SAMPLE, seed: int = 0) -> DataFrame:
    """At most n vectors (id, v), the first by a seeded md5 of the id."""
    return vectors.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"|{seed}"))), "id").limit(n)


def pairwise(vectors: DataFrame, n: int = SAMPLE) -> DataFrame:
    """(cos) of every two of a bounded sample, which is the feature: n * (n - 1) / 2 rows at most."""
    some = sampled(vectors, n).withColumn("u", F.transform("v", lambda x: x / F.greatest(norm(F.col("v")), F.lit(1e-12)))).select("id", "u")
    other = F.broadcast(some.select(F.col("id").alias("id2"), F.col("u").alias("u2")))
    return some.join(other, F.col("id") < F.col("id2")).select(dot(F.col("u"), F.col("u2")).alias("cos"))


def norm_stats(vectors: DataFrame, by: list[str] | None = None) -> DataFrame:
    x = norm(F.col("v"))
    return vectors.withColumn("_n", x).groupBy(*(by or [])).agg(F.count("*").alias("n"), _r(F.avg("_n")).alias("norm_mean"), _r(F.stddev_pop("_n")).alias("norm_std"), _r(F.min("_n")).alias("norm_min"), _r(F.max("_n")).alias("norm_max"))


def centroid(vectors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean vector by dimension: a row for each dimension is summed in each task before it moves."""
    by = by or []
    means = vectors.select(*by, F.posexplode("v")).groupBy(*by, "pos").agg(F.avg("col").alias("m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))


def centroid_alignment(vectors: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    center = centroid(vectors, by)
    both = vectors.join(center, by) if by else vectors.join(F.broadcast(center), on=F.lit(True))
    return both.groupBy(*by).agg(_r(F.avg(cosine(F.col("v"), F.col("centroid")))).alias("centroid_cos_mean"))


def pairwise_stats(vectors: DataFrame, n: int = SAMPLE) -> DataFrame:
    c = F.col("cos")
    out = pairwise(vectors, n).agg(F.count("*").alias("n_pairs"), F.avg(c).alias("m"), F.stddev_pop(c).alias("s"), _r(F.min(c)).alias("cos_min"), _r(F.max(c)).alias("cos_max"), _r(F.percentile(c, F.lit(0.5))).alias("cos_p50"), _r(F.percentile(c, F.lit(0.95))).alias("cos_p95"))
    return out.select("n_pairs", _r("m").alias("cos_mean"), _r("s").alias("cos_std"), "cos_min", "cos_max", "cos_p50", "cos_p95", ((F.col("m") > COLLAPSE_MEAN) & (F.col("s") < COLLAPSE_STD)).alias("collapsed"))


def histogram(values: DataFrame, value: str, bins: int = BINS, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """(bin from 1, n): equal bins on [low, high], the last closed; what rounding puts outside counts at the edge."""
    b = F.floor((F.col(value) - low) / (high - low) * bins).cast("int") + 1
    return values.groupBy(F.greatest(F.lit(1), F.least(F.lit(bins), b)).alias("bin")).agg(F.count("*").alias("n"))


def drift(pairs: DataFrame) -> DataFrame:
    """Cosine and absolute differences of two encodings (a, b) of the same rows."""
    both = pairs.select(cosine(F.col("a"), F.col("b")).alias("cos"), F.zip_with("a", "b", lambda x, y: F.abs(x - y)).alias("d"))
    rows = both.agg(_r(F.avg("cos")).alias("cos_mean"), _r(F.min("cos")).alias("cos_min"), _r(F.percentile("cos", F.lit(0.05))).alias("cos_p5"))
    flat = both.select(F.explode("d").alias("d")).agg(F.round(F.avg("d"), 9).alias("diff_mean"), F.round(F.max("d"), 9).alias("diff_max"), F.round(F.percentile("d", F.lit(0.95)), 9).alias("diff_p95"))
    return rows.join(F.broadcast(flat), on=F.lit(True))


def memory_bytes(chunks: DataFrame, dim: int, item: int = 4) -> DataFrame:
    """Bytes of all token vectors."""
    return chunks.agg(F.sum(F.size("tokens").cast("long") * dim * item).alias("bytes"))


def count_stats(counts: DataFrame, c: str, by: list[str] | None = None) -> DataFrame:
    """Mean, least, greatest, truncated median and zeros of a count."""
    x = F.col(c)
    return counts.groupBy(*(by or [])).agg(F.count("*").alias("n"), _r(F.avg(x)).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.floor(F.median(x)).cast("long").alias("median"), F.count_if(x == 0).alias("zeros"))
