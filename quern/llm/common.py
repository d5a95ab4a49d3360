"""Shared folder, written tables and small Column helpers of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one 8-byte key that may be broadcast (about 16 MB once hashed); beyond it the join shuffles.
BROADCAST_KEYS = 500_000
#: Shuffle partitions that one task of a small table reads: each holds the memory of its sorts and maps until the task ends.
MERGED = 8
#: Space, and tab to carriage return: what separates words.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on one machine (tests), a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def few_tasks(spark: SparkSession, wanted: int) -> int:
    """Tasks for a small table: as many as wanted, and more where that would read over MERGED shuffle partitions each."""
    return max(wanted, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // MERGED))


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders on any file system that Spark knows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


class Workspace:
    """A folder of its own below the shared one, for the tables that one call of an operator writes.

    What the returned DataFrame reads stays until the session ends; ``drop`` removes the rest earlier.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.saved = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", []
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            remove(self.spark, self.path)
        except Exception:  # the session is gone, and the folder's owner cleans up
            pass

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write a table and read it again: cuts lineage, survives lost executors."""
        to = f"{self.path}/{name}"
        self.saved.append(name)
        df.write.mode("overwrite").option("compression", codec).parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, *names: str) -> None:
        remove(self.spark, *(f"{self.path}/{n}" for n in names))
        self.saved = [n for n in self.saved if n not in names]

    def clear(self, since: int, *keep: str) -> None:
        """Drop what was saved after the first ``since`` tables, but for those to keep."""
        self.drop(*(n for n in self.saved[since:] if n not in keep))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, unchanged; none for null."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, the same in every engine."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyed_semi(df: DataFrame, keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """Rows of df whose key is in keys (distinct). A counted, small set of keys is broadcast; a larger one shuffles."""
    return df.join(F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys, key, "left_semi")
