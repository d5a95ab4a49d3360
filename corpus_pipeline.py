"""A corpus pipeline: quality rules, line dedup, near dedup, decontamination, packing.

Each stage works on what its predecessor kept, written as Parquet and read again. All stages but the last return the
columns of documents; packing returns pieces of sequences. SQL can't encode tokens, so there is no oracle; tests hold
the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Workspace
from quern.llm.decontaminate import remove_hits
from quern.llm.linededup import dedup_lines
from quern.llm.neardup import keep_one
from quern.llm.packing import pack
from quern.llm.quality import keep_good
from quern.llm.tokens import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules accept."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus; those that had words and lose all of them go."""
    own = {c: f"_own_{c}" for c in docs.columns if c in ("n_lines", "n_removed")}
    out = dedup_lines(docs.withColumnsRenamed(own)).filter("n_removed < n_lines or n_lines = 0")
    new = {"n_chars": F.char_length("text").cast("long")} | {c: F.col(o) for c, o in own.items()}
    return out.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two or more benchmark items go; a single item's passages are cut out of others."""
    return remove_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    work, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs
