"""The scoring kernel in many batches, its memory, and how many pairs a fusion shuffles."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quern.operators import ranking, similarity
from tests.test_whole import shuffled


class Shared:
    def __init__(self, value):
        self.value = value


def run(block, rows, k, size, **more):
    """Rows (query, file, chunk, score) of the kernel over chunks (file, chunk, tokens[, repo]) in batches."""
    names = ["file_id", "chunk_id", "tokens", "repo"][: len(rows[0])]
    batches = (pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size])], names) for i in range(0, len(rows), size))
    return [tuple(r.values()) for b in similarity._kernel(Shared(block), k, **more)(batches) for r in b.to_pylist()]


@pytest.mark.parametrize("repos", [False, True])
def test_kernel_keeps_all_that_can_rank(monkeypatch, repos):
    """Files in several chunks and batches, ties in score, queries of a repository and of none, and hardly room to hold."""
    monkeypatch.setattr(similarity, "HELD_CELLS", 30, raising=False)
    rng = np.random.default_rng(1)
    queries = [{"query_id": q, "repo": f"r{q % 2}" if repos and q < 4 else None, "tokens": rng.integers(-2, 3, (2, 4)).tolist()} for q in range(6)]
    rows = [(f"f{rng.integers(40)}", i, rng.integers(-1, 2, (3, 4)).astype(float).tolist(), *([f"r{i % 2}"] if repos else [])) for i in range(150)]
    block = similarity.Block(queries)
    every = run(block, rows, None, 7)
    assert len(every) == sum(q["repo"] is None or q["repo"] == r[3] for q in queries for r in rows)

    def best(found):
        out = {}
        for q, f, c, s in found:
            out[q, f] = max(out.get((q, f), (-9, 0)), (s, -c))
        return out

    whole = best(every)
    assert best(run(block, rows, None, 7, by_file=True)) == whole
    for k in (1, 3, 50):
        got = run(block, rows, k, 7)
        assert len(got) == len(best(got)) and all(whole[x] == v for x, v in best(got).items())
        for q in range(6):
            mine = sorted((round(s, 6) for (x, _), (s, _) in whole.items() if x == q), reverse=True)[:k]
            need = {f for (x, f), (s, _) in whole.items() if x == q and round(s, 6) >= mine[-1]}
            assert need <= {f for x, f, _, _ in got if x == q}


def test_kernel_holds_few_files_a_query(monkeypatch):
    monkeypatch.setattr(similarity, "HELD_CELLS", 20_000, raising=False)
    rng = np.random.default_rng(2)
    block = similarity.Block([{"query_id": q, "repo": None, "tokens": rng.normal(size=(1, 4)).tolist()} for q in range(200)])
    rows = [(f"f{i}", i, rng.normal(size=(1, 4)).tolist()) for i in range(1000)]
    tracemalloc.start()
    assert len(run(block, rows, 5, 50)) == 1000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15_000_000


def test_fusion_shuffles_a_pair_once_a_level(spark):
    grid = spark.range(50).selectExpr("id AS query_id").crossJoin(spark.range(40).selectExpr("concat('f', id) AS file_id"))
    parts = {f"g{i}": grid.selectExpr("query_id", "file_id", f"sin(query_id + {i}) * hash(file_id) AS score") for i in range(4)}
    for fuse in (ranking.fused, ranking.composite):
        rows, n = shuffled(spark, ranking.ranked(fuse(parts), 5).select("query_id", "rk"))
        assert rows == [(q, rk) for q in range(50) for rk in range(1, 6)] and n <= 4 * 2000
