"""Exact substring dedup by a log-structured fingerprint index.

A window is ``window`` consecutive words. A word goes if a window that covers it also starts anywhere else, in its own
document or another; all copies go, the first too.

Windows enter the index by a fingerprint: the least hash of the ``gram``-word grams in the window. Equal windows have
equal fingerprints, and neighbouring windows mostly share theirs, so the index holds about 2 / (window - gram + 2) of an
entry per word. A batch becomes a sorted immutable run of (fingerprint, times); runs are bucketed and sorted by
fingerprint, so a new batch is merge-joined with history without a shuffle, and runs are compacted into one.

Candidates are verified: documents with repeated fingerprints are read again, and the 128-bit BLAKE2b digest of the bytes
of each of their windows with such a fingerprint is counted; only windows that occur twice count. The digest shares
nothing with the word hashes that fingerprints are made of.

Documents with equal word sequences (SHA-256 of their words) are one entry of the index; of two or more of them, every
word of a window goes. They and documents shorter than a window take no part in later joins.

An index can be kept: a later call takes it with the documents that it holds as ``history``, which are only read, and its
batches are merge-joined with the runs of all calls before, then compacted into one.

Defined results: null and wordless texts have no words. Texts of fewer words than a window stay whole. Rows that repeat
an id and a text are copies of each other. Extra columns are not used.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_KEYS, Workspace
from quern.llm.words import U64, Words, blocks, scan

#: Words of a window and of the grams whose least hash is its fingerprint; batches of the query.
WINDOW, GRAM, BATCHES = 35, 8, 2


class FingerprintIndex:
    """Runs of (fp, times), each a table bucketed and sorted by fp."""

    def __init__(self, work: Workspace, buckets: int | None = None):
        self.work, self.spark, self.runs = work, work.spark, []
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, entries: DataFrame) -> str:
        name = f"quern_run_{uuid.uuid4().hex}"
        entries.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.work.path}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(F.col("fp").alias("fp2"), F.col("times").alias("times2"))
        both = a.hint("merge").join(b, F.col("fp") == F.col("fp2"), "full")
        return both.select(F.coalesce("fp", "fp2").alias("fp"), (F.coalesce("times", F.lit(0)) + F.coalesce("times2", F.lit(0))).alias("times"))

    def history(self) -> DataFrame | None:
        out = None
        for name in self.runs:
            out = self.spark.table(name) if out is None else self._merged(out, self.spark.table(name))
        return out

    def ingest(self, entries: DataFrame) -> DataFrame:
        """Add a batch of (fp, times) as a run; the batch's fingerprints that history or the batch itself repeats."""
        old = self.history()
        name = self._write(entries.groupBy("fp").agg(F.sum("times").alias("times")))
        self.runs.append(name)
        new = self.spark.table(name)
        if old is None:
            return new.filter("times > 1").select("fp")
        met = new.hint("merge").join(old.select("fp", F.col("times").alias("before")), "fp", "left")
        return met.filter("times > 1 or before is not null").select("fp")

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            old, name = self.runs, self._write(self.history())
            self.runs = [name]
            self._drop(old)

    def repeated(self) -> DataFrame:
        return self.history().filter("times > 1").select("fp")

    def _drop(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
            self.work.drop(n)

    def close(self) -> None:
        self._drop(self.runs)
        self.runs = []


def fingerprints(w: Words, h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its first word, its fingerprint, and the gram that has it."""
    g, _ = w.grams(h, gram)
    span = window - gram + 1
    starts = len(h) - window + 1
    if starts <= 0:
        return np.empty(0, np.int64), np.empty(0, U64), np.empty(0, np.int64)
    best, at = g.copy(), np.arange(len(g))
    done = 1
    while done < span:
        step = min(done, span - done)
        n = len(best) - step
        less = best[step : step + n] < best[:n]
        best, at = np.where(less, best[step : step + n], best[:n]), np.where(less, at[step : step + n], at[:n])
        done += step
    first = np.flatnonzero(w.row[:starts] == w.row[window - 1 : window - 1 + starts])
    return first, best[first], at[first]


def _digests(w: Words) -> np.ndarray:
    """SHA-256 of each row's words, joined by one space, as 32 bytes."""
    data, begin, stop = w.joined()
    spans = [data[begin[a] : stop[b - 1]] if b > a else b"" for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
    return np.frombuffer(b"".join(hashlib.sha256(x).digest() for x in spans), np.uint8).reshape(-1, 32)


def _sequences(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 128 bits of each digest."""
    halves = np.ascontiguousarray(digests[:, :16]).view("<i8")
    return halves[:, 0], halves[:, 1]


def _profile(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, a, b: of the word sequence, n_words, whole_sha256, fps, again: those with several grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in blocks(batches):
            w = scan(batch.column("text"))
            first, fp, at = fingerprints(w, w.hashes(), window, gram)
            row = w.row[first]
            new = np.ones(len(fp), bool)
            new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
            fp, row = fp[new].view(np.int64), row[new]
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            once, again = [], []
            for x, y in zip(cuts[:-1], cuts[1:]):
                values, times = np.unique(fp[x:y], return_counts=True)
                once.append(values)
                again.append(values[times > 1])
            shas = _digests(w)
            a, b = _sequences(shas)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(a), pa.array(b), pa.array(np.diff(w.first)), pa.array([x.tobytes() for x in shas], pa.binary()), pa.array(once, kind), pa.array(again, kind)],
                ["doc_id", "a", "b", "n_words", "whole_sha256", "fps", "again"],
            )

    return docs.mapInArrow(run, "doc_id long, a long, b long, n_words long, whole_sha256 binary, fps array<long>, again array<long>")


def _windows(candidates: DataFrame, window: int, gram: int) -> DataFrame:
    """(w1, w2, a, b, word): every window of the candidates (a, b, text, fps) with one of their fps and 128 bits of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            w = scan(batch.column("text"))
            first, fp, _ = fingerprints(w, w.hashes(), window, gram)
            keep = np.zeros(len(first), bool)
            row, cuts = w.row[first], np.searchsorted(w.row[first], np.arange(batch.num_rows + 1))
            for r, wanted in enumerate(batch.column("fps")):
                x, y = cuts[r], cuts[r + 1]
                keep[x:y] = np.isin(fp[x:y].view(np.int64), wanted.values.to_numpy(zero_copy_only=False))
            first, row = first[keep], row[keep]
            data, begin, stop = w.joined()
            data, digest = memoryview(data), hashlib.blake2b
            whole = np.frombuffer(b"".join([digest(data[x:y], digest_size=16).digest() for x, y in zip(begin[first].tolist(), stop[first + window - 1].tolist())]), "<i8").reshape(-1, 2)
            a, b = (batch.column(c).to_numpy()[row] for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(a), pa.array(b), pa.array((first - w.first[row]).astype(np.int32))], ["w1", "w2", "a", "b", "word"])

    return candidates.select("a", "b", "text", "fps").mapInArrow(run, "w1 long, w2 long, a long, b long, word int")


def _cut(candidates: DataFrame, window: int) -> DataFrame:
    """(a, b, n_removed, kept_text) of candidates (a, b, text, starts of repeated windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            n, texts = [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                words = (text or "").encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.array(starts), 1)
                np.add.at(edge, np.array(starts) + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                n.append(int(gone.sum()))
                texts.append(b" ".join(x for x, g in zip(words, gone.tolist()) if not g).decode())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(n, pa.int64()), pa.array(texts, pa.string())], ["a", "b", "n_removed", "kept_text"])

    return candidates.select("a", "b", "text", "starts").mapInArrow(run, "a long, b long, n_removed long, kept_text string")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, key: str = "doc_id", text: str = "text", work: Workspace | None = None, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, changed).

    documents: (doc_id, a, b, n_words, n_removed, kept_sha256 of the words that stay), a row for each of docs; changed:
    (a, b, n_removed, kept_text) of each word sequence that loses words but isn't a copy. a and b are 128 bits of it.
    index: the runs of earlier calls, whose documents are history; it takes docs in and stays open.
    """
    work = work or Workspace(docs.sparkSession, "substrings")
    plain = lambda d: d.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = work.save(_profile(plain(docs), window, gram), "profile")
    long = every.filter(F.col("n_words") >= window)
    copies = long.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("c > 1")
    copies = work.save(copies.select("a", "b", "rep", F.lit(True).alias("copied")), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_KEYS // 2 else copies
    marked = long.join(copies, ["a", "b"], "left")
    once = marked.filter(F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("rep"))).select("doc_id", "a", "b", "fps", "again")

    # Each batch is merge-joined with the runs before it; what any of them repeats is looked at again.
    own = index is None
    index = index or FingerprintIndex(work)
    hits = None
    for k in range(batches):
        batch = once.filter(F.pmod("a", F.lit(batches)) == k)
        found = work.save(index.ingest(batch.select(F.explode("fps").alias("fp"), F.lit(1).alias("times")).unionByName(batch.select(F.explode("again").alias("fp"), F.lit(1).alias("times")))), f"hits-{k}")
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.distinct() if batches > 1 else hits
    texts = _candidates(plain(docs), once, hits, work, "texts")
    windows = _windows(texts, window, gram)
    if history is not None:
        old = plain(history)
        windows = windows.unionByName(_windows(_candidates(old, work.save(_profile(old, window, gram), "history"), hits, work, "old-texts"), window, gram))
    twice = work.save(windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).filter("c > 1").select("w1", "w2"), "twice")
    starts = windows.join(twice, ["w1", "w2"], "left_semi").groupBy("a", "b").agg(F.collect_set("word").alias("starts"))
    changed = work.save(_cut(texts.dropDuplicates(["a", "b"]).join(starts, ["a", "b"]), window), "changed")
    if own:
        index.close()
    else:
        index.compact()

    # Copies and short documents know their result; only sequences of their own are joined.
    row = lambda df, n, sha: df.select("doc_id", "a", "b", "n_words", F.coalesce(n, F.lit(0)).cast("long").alias("n_removed"), sha.alias("kept_sha256"))
    whole = F.lower(F.hex("whole_sha256"))
    some = changed.select("a", "b", F.col("n_removed").alias("some"), F.sha2("kept_text", 256).alias("kept"))
    parts = [
        row(every.filter(F.col("n_words") < window), F.lit(0), whole),
        row(marked.filter("copied"), F.col("n_words"), F.sha2(F.lit(""), 256)),
        row(marked.filter("copied is null").join(some, ["a", "b"], "left"), F.col("some"), F.coalesce("kept", whole)),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]), changed


def _candidates(plain: DataFrame, profile: DataFrame, hits: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(a, b, text, fps) of documents with repeated fingerprints; a text with another sequence under the same id is none."""
    entries = profile.select("doc_id", "a", "b", F.explode("fps").alias("fp"))
    wanted = entries.join(hits, "fp", "left_semi").groupBy("doc_id", "a", "b").agg(F.collect_list("fp").alias("fps"))
    wanted = work.save(wanted, f"{name}-wanted")
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("fps")), F.lit(0))).first()
    small = n <= BROADCAST_KEYS // 4 and size <= 4 * BROADCAST_KEYS
    met = plain.withColumnRenamed("doc_id", "d").join(F.broadcast(wanted) if small else wanted, F.col("d").eqNullSafe(F.col("doc_id"))).drop("d")
    return work.save(_same_sequence(met), name)


def _same_sequence(met: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            a, b = _sequences(_digests(scan(batch.column("text"))))
            yield batch.filter(pa.array((a == batch.column("a").to_numpy()) & (b == batch.column("b").to_numpy())))

    return met.select("a", "b", "text", "fps").mapInArrow(run, "a long, b long, text string, fps array<long>")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows, _ = dedup_substrings(docs)
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY x) AS n FROM s) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM t),
k AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.p) AS kept, count(*) AS n
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) u LEFT JOIN g ON g.doc_id = u.doc_id AND g.p = u.p WHERE g.p IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
