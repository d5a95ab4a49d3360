"""Similarity joins of queries with a corpus: pooled cosine, MaxSim, multi-head, late interaction.

The corpus stays in rows of whole chunks, tokens nested, and is read once for each block of queries. A block's tokens
are bounded and broadcast; more queries make more blocks, never a larger broadcast. The Arrow kernel multiplies a batch
of chunks with the block and emits, for each query, the files that can still be among its best k: the best k of a
partition hold every file of the global best k whose best chunk is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import orthogonal

#: Query tokens of one broadcast, and similarities that are held at once.
BLOCK_TOKENS, BLOCK_CELLS = 50_000, 4_000_000
#: Files of all queries that a task holds before it sorts the worse ones out (4 k a query if that is more), and rows of one Arrow batch that it emits.
HELD_CELLS, EMITTED = 200_000, 100_000
#: Methods: heads, is the pooling over query tokens a mean, are tokens pooled before.
METHODS: dict[str, dict] = {
    "pooled": {"pooled": True},
    "maxsim": {},
    "cross_attention": {"mean": True},
    **{f"mh_{h}": {"heads": h, "project": True} for h in (4, 8, 16, 32)},
    "late_int_8": {"heads": 8, "project": True, "normalize_first": True},
}


def nested(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token matrix of a column of arrays of vectors, and where each row's tokens begin."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    tokens = column.flatten()
    begin = np.concatenate([[0], np.cumsum(np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64))])
    values = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(tokens), -1) if len(tokens) else np.empty((0, 0)), begin


def unit_rows(x: np.ndarray, eps: float) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), eps)


class Block:
    """Queries of one broadcast: ids, repositories, prepared head vectors of all tokens, and where each query begins."""

    def __init__(self, rows: list, heads: int = 1, project: bool = False, mean: bool = False, pooled: bool = False, normalize_first: bool = False):
        self.heads, self.project, self.mean, self.pooled, self.first = heads, project, mean, pooled, normalize_first
        self.ids, self.repos = [r["query_id"] for r in rows], [r["repo"] for r in rows]
        tokens = [np.array(r["tokens"], float) for r in rows]
        if pooled:
            tokens = [t.mean(0, keepdims=True) for t in tokens]
        self.begin = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.q = self.prepare(np.concatenate(tokens))

    def prepare(self, x: np.ndarray) -> np.ndarray:
        """(heads, tokens, dimensions of a head), each of unit length."""
        x = unit_rows(x, 1e-12) if self.first else x
        x = x @ orthogonal(x.shape[1]) if self.project else x
        if x.shape[1] % self.heads:
            raise ValueError(f"{x.shape[1]} dimensions don't divide into {self.heads} heads")
        return unit_rows(x.reshape(len(x), self.heads, -1), 1e-12).transpose(1, 0, 2)

    def scores(self, tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(queries, chunks): for each query token the best of the chunk's tokens, summed over tokens and heads."""
        if self.pooled:
            tokens = np.add.reduceat(tokens, begin[:-1]) / np.diff(begin)[:, None]
            begin = np.arange(len(begin))
        f = self.prepare(tokens)
        best = sum(np.maximum.reduceat(q @ x.T, begin[:-1], axis=1) for q, x in zip(self.q, f))
        total = np.add.reduceat(best, self.begin[:-1], axis=0)
        return total / np.diff(self.begin)[:, None] if self.mean else total


def query_blocks(queries: DataFrame, size: int = BLOCK_TOKENS) -> Iterator[list]:
    """Rows (query_id, repo, tokens) in lists of a bounded number of tokens; queries without tokens have no score."""
    rows, n = [], 0
    if "repo" not in queries.columns:
        queries = queries.withColumn("repo", F.lit(None).cast("string"))
    for r in queries.filter(F.size("tokens") > 0).toLocalIterator():
        if rows and n + len(r["tokens"]) > size:
            yield rows
            rows, n = [], 0
        rows.append(r)
        n += len(r["tokens"])
    yield rows


def chunk_scores(chunks: DataFrame, queries: DataFrame, method: str = "maxsim", k: int | None = None, block_tokens: int = BLOCK_TOKENS, by_file: bool = False) -> DataFrame:
    """(query_id, file_id, chunk_id, score): with k, only the best chunk of files that may be among a query's best k.

    by_file: of chunks of a file that a task meets together only the best, for results that take the best of a file.

    chunks: (file_id, chunk_id, tokens[, repo]); queries: (query_id, tokens[, repo]). Queries with a repository meet only
    its chunks.
    """
    spark, own_repo = chunks.sparkSession, "repo" in chunks.columns
    q_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {q_type}, file_id string, chunk_id long, score double"
    kept = chunks.filter(F.size("tokens") > 0).select(F.col("file_id").cast("string"), F.col("chunk_id").cast("long"), "tokens", *(["repo"] if own_repo else []))
    parts = []
    for rows in query_blocks(queries, block_tokens):
        if rows:
            shared = spark.sparkContext.broadcast(Block(rows, **METHODS[method]))
            parts.append(kept.mapInArrow(_kernel(shared, k, by_file), schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _best_chunks(scores: np.ndarray, files: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of files, best scores, their chunks) of (queries, chunks) scores: of equal scores the least chunk."""
    order = np.lexsort((chunks, files))
    files, chunks, scores = files[order], chunks[order], scores[:, order]
    begin = np.flatnonzero(np.r_[True, files[1:] != files[:-1]])
    if len(begin) == len(files):
        return files, scores, np.broadcast_to(chunks, scores.shape)
    best = np.maximum.reduceat(scores, begin, axis=1)
    at = np.where(scores == np.repeat(best, np.diff(np.r_[begin, len(files)]), axis=1), np.arange(len(files)), len(files) - 1)
    return files[begin], best, chunks[np.minimum.reduceat(at, begin, axis=1)]


class _Best:
    """The best k files of each query and all that tie with the last when rounded as ranks are, in flat arrays."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.least, self.size = n, k, np.full(n, -np.inf), 0
        self.most = max(HELD_CELLS, 4 * n * k)
        self.parts: list[tuple] = []

    def add(self, files: np.ndarray, scores: np.ndarray, chunks: np.ndarray, meets: np.ndarray | None) -> None:
        kept = ~(scores < self.least[:, None])
        row, col = np.nonzero(kept if meets is None else kept & meets)
        if len(row):
            self.parts.append((row, files[col], scores[row, col], chunks[row, col]))
            self.size += len(row)
            if self.size > self.most:
                self.compact()

    def compact(self) -> tuple:
        row, file, score, chunk = (np.concatenate(x) for x in zip(*self.parts))
        key = np.where(np.isnan(score), np.inf, score)
        order = np.lexsort((chunk, -key, file, row))
        first = np.r_[True, (row[order][1:] != row[order][:-1]) | (file[order][1:] != file[order][:-1])]
        order = order[first]
        order = order[np.lexsort((-key[order], row[order]))]
        begin = np.searchsorted(row[order], np.arange(self.n + 1))
        full = np.flatnonzero(np.diff(begin) >= self.k)
        self.least[full] = np.round(key[order][begin[full] + self.k - 1], 6) - 1e-6
        order = order[~(key[order] < self.least[row[order]])]
        self.parts = [(row[order], file[order], score[order], chunk[order])]
        self.size = len(order) if len(order) < self.most // 2 else 0  # many ties: as much again before the next time
        return self.parts[0]


def _kernel(shared, k: int | None, by_file: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        ids, n = pa.array(block.ids), len(block.ids)
        own = np.array([r is not None for r in block.repos])
        best, names, codes, of_file = _Best(n, k) if k is not None else None, [], {}, {}

        def emit(row, files, chunks, scores) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(row), EMITTED):
                cut = slice(at, at + EMITTED)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[cut])), pa.array(files(cut), pa.string()), pa.array(chunks[cut], pa.int64()), pa.array(scores[cut], pa.float64())], ["query_id", "file_id", "chunk_id", "score"])

        for batch in batches:
            step = max(1, min(batch.num_rows, BLOCK_CELLS // max(1, len(block.q[0]) * 64)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                tokens, begin = nested(part.column(2))
                scores = block.scores(tokens, begin)
                files, chunks = part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False)
                repos = part.column(3).to_pylist() if part.num_columns > 3 else [None] * len(files)
                if best is None:
                    codes, names = {}, []
                for key in zip(files, repos):
                    if key not in codes:
                        codes[key] = len(names)
                        names.append(key)
                code = np.array([codes[key] for key in zip(files, repos)])
                if best is not None or by_file:
                    code, scores, chunks = _best_chunks(scores, code, chunks)
                else:
                    chunks = np.broadcast_to(chunks, scores.shape)
                meets = None
                if part.num_columns > 3 and own.any():
                    meets = np.array([[r is None or r == names[c][1] for c in code] for r in block.repos])
                if best is not None:
                    best.add(np.array([of_file.setdefault(names[c][0], len(of_file)) for c in code]), scores, chunks, meets)
                    continue
                row, col = np.nonzero(np.ones(scores.shape, bool) if meets is None else meets)
                texts = pa.array([names[c][0] for c in code], pa.string())
                yield from emit(row, lambda cut: texts.take(pa.array(col[cut])), chunks[row, col], scores[row, col])  # noqa: B023
        if best is not None and best.parts:
            row, file, score, chunk = best.compact()
            texts = list(of_file)
            yield from emit(row, lambda cut: [texts[c] for c in file[cut]], chunk, score)

    return run


def pooled_vectors(chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by, vec, n): the token-weighted mean of all tokens with the same by; each task adds up its own first."""
    schema = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in by) + ", total array<double>, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, begin = nested(batch.column(len(by)))
            total = np.add.reduceat(tokens, begin[:-1])
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * total.shape[1], pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(by))), sums, pa.array(np.diff(begin))], [*by, "total", "n"])

    sums = chunks.filter(F.size("tokens") > 0).select(*by, "tokens").mapInArrow(run, schema)
    n = F.sum("n")
    return sums.groupBy(*by).agg(F.collect_list("total").alias("totals"), n.alias("n")).select(
        *by, F.aggregate("totals", F.transform(F.get("totals", F.lit(0)), lambda x: F.lit(0.0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b), lambda s: F.transform(s, lambda a: a / F.greatest("n", F.lit(1)))).alias("vec"), "n"
    )


def window_starts(n, window: int, stride: int):
    """Starts of sliding windows over n positions as a Column: every stride, and a last one that ends at n."""
    last = n - window
    grid = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))
    tail = F.when(last % stride != 0, F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= window, F.array(F.lit(0))).otherwise(F.concat(grid, tail))


def segments(chunks: DataFrame, window: int = 256, stride: int = 128) -> DataFrame:
    """(file_id, chunk_id, start, end, tokens): sliding windows over the tokens of each chunk."""
    n = F.size("tokens")
    rows = chunks.select("file_id", "chunk_id", "tokens", F.explode(window_starts(n, window, stride)).alias("start"))
    end = F.least(F.col("start") + window, n)
    return rows.select("file_id", "chunk_id", "start", end.alias("end"), F.slice("tokens", F.col("start") + 1, F.lit(window)).alias("tokens"))


def segment_scores(chunks: DataFrame, queries: DataFrame, window: int = 256, stride: int = 128, best: bool = True) -> DataFrame:
    """Pooled cosine with the best segment of each file; a file without segments scores -1e30. Not best: a file may have several rows."""
    parts = segments(chunks, window, stride).select("file_id", F.col("start").cast("long").alias("chunk_id"), "tokens")
    found = chunk_scores(parts, queries, "pooled", by_file=True).select("query_id", "file_id", "score")
    found = found.groupBy("query_id", "file_id").agg(F.max("score").alias("score")) if best else found
    every = queries.select("query_id").distinct().join(F.broadcast(chunks.select("file_id").distinct().filter("file_id is not null")), how="inner", on=F.lit(True)) if chunks.filter(F.size("tokens") <= 0).limit(1).count() else None
    return found if every is None else every.join(found, ["query_id", "file_id"], "left").fillna(-1e30, ["score"])
