"""Corpora and instances: file scans, filter statistics, JSON data sets, cached tables, result sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import decoded, file_class, gold_files

INSTANCE = "instance_id string, repo string, base_commit string, problem_statement string, issue string, patch string, _split string"


def _binary(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def scan_files(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """(path relative to root, size, mtime in seconds, content) of all files below root; the reader leaves empty ones out."""
    base = root.rstrip("/") + "/"
    at = F.instr("path", F.lit(base))
    return _binary(spark, root, glob).select(F.substring(F.col("path"), at + len(base), F.length("path")).alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), "content")


def count_listed(spark: SparkSession, root: str, glob: str = "*.py") -> int:
    """Files below root, empty ones too, from the listing that the reader makes."""
    return len(_binary(spark, root, glob).inputFiles())


def eligible_files(files: DataFrame) -> DataFrame:
    """Files that aren't empty, too big or excluded, in order of their path's parts."""
    return files.filter(file_class(F.col("path"), F.col("size")) == "kept").orderBy(F.split("path", "/"))


def smoke_files(files: DataFrame, n: int = 10) -> DataFrame:
    """The first n files of more than 64 bytes outside .git."""
    return files.filter(~F.array_contains(F.split("path", "/"), ".git") & (F.col("size") > 64)).orderBy(F.split("path", "/")).limit(n)


def filter_stats(files: DataFrame, listed: int | None = None) -> DataFrame:
    """Files by class; listed: how many there are if the scan left empty ones out."""
    kind = file_class(F.col("path"), F.col("size"))
    out = files.select(kind.alias("k")).agg(F.count("*").alias("total"), *(F.count_if(F.col("k") == k).alias(k) for k in ("kept", "pattern", "too_big", "empty")))
    if listed is None:
        return out
    return out.select(F.lit(listed).cast("long").alias("total"), "kept", "pattern", "too_big", (F.col("empty") + F.lit(listed) - F.col("total")).alias("empty"))


def read_texts(files: DataFrame) -> DataFrame:
    return files.select("path", decoded(F.col("content")).alias("content"))


def load_instances(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Instances of a JSON array, with gold files from their patches."""
    rows = spark.read.schema(INSTANCE).option("multiLine", True).json(path)
    rows = rows.filter(F.col("_split") == split) if split else rows
    return rows.select("instance_id", "repo", "base_commit", F.coalesce("problem_statement", "issue").alias("problem_statement"), gold_files(F.coalesce("patch", F.lit(""))).alias("gold_files"), F.col("_split").alias("split"))


def tag_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """All splits as one, each row with its split's name."""
    out = None
    for name, df in splits.items():
        tagged = df.withColumn("_split", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def signature(files: DataFrame, salt: str, by: list[str] | None = None, stamp: Column | None = None) -> DataFrame:
    """First 16 hex digits of the SHA-256 over salt and each path and stamp (size-mtime), in order of the paths."""
    stamp = F.concat_ws("-", "size", "mtime") if stamp is None else stamp
    entries = F.array_sort(F.collect_list(F.struct(F.col("path").alias("p"), stamp.alias("s"))))
    text = F.concat(F.lit(salt), F.array_join(F.transform(entries, lambda x: F.concat(x["p"], x["s"])), ""))
    return files.groupBy(*(by or [])).agg(F.substring(F.sha2(text, 256), 1, 16).alias("signature"))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, built and written if it isn't there in full."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_results(results: DataFrame, path: str, by: str = "repo") -> None:
    """Results of some repositories; a repository that is written again replaces its own part only."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)


def first_commit(instances: DataFrame, position: str) -> DataFrame:
    """The first observed commit of each repository, by input position."""
    return instances.groupBy("repo").agg(F.min_by("base_commit", position).alias("base_commit"))
