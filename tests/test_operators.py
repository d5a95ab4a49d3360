"""Scorers against plain loops and properties; chunkers, pools, metrics, symbols at their edges."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.vectors import cosine, min_max, orthogonal
from quern.operators import chunking, diagnostics, evaluate, plugins, ranking, similarity
from quern.operators import symbols as S

CHUNKS = "file_id string, chunk_id long, tokens array<array<double>>"
QUERIES = "query_id long, tokens array<array<double>>"


def corpus(rng, files=6, chunks=3, dim=8):
    return [(f"f{f}", c, rng.standard_normal((rng.integers(1, 5), dim)).tolist()) for f in range(files) for c in range(chunks)]


def loop(rows, queries, method):
    out = {}
    spec = similarity.METHODS[method]
    for q, qt in queries:
        for f, c, ft in rows:
            a, b = np.array(qt), np.array(ft)
            if spec.get("pooled"):
                a, b = a.mean(0, keepdims=True), b.mean(0, keepdims=True)
            if spec.get("project"):
                a, b = a @ orthogonal(a.shape[1]), b @ orthogonal(b.shape[1])
            total, h = 0.0, spec.get("heads", 1)
            for x, y in zip(np.split(a, h, 1), np.split(b, h, 1)):
                x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
                total += (x @ y.T).max(1).sum()
            out[q, f, c] = total / len(a) if spec.get("mean") else total
    return out


@pytest.mark.parametrize("method", ["pooled", "maxsim", "cross_attention", "mh_4", "mh_8", "late_int_8"])
def test_scores_equal_loops(spark, method):
    rng = np.random.default_rng(4)
    rows, queries = corpus(rng), [(i, rng.standard_normal((3, 8)).tolist()) for i in range(4)]
    df, qf = spark.createDataFrame(rows, CHUNKS).repartition(3), spark.createDataFrame(queries, QUERIES)
    want = loop(rows, queries, method)
    for block in (50_000, 4):  # one broadcast, and one for each query
        got = {(r["query_id"], r["file_id"], r["chunk_id"]): r["score"] for r in similarity.chunk_scores(df, qf, method, block_tokens=block).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    full = [tuple(r) for r in ranking.top_files(similarity.chunk_scores(df, qf, method), 2).orderBy("query_id", "rk").collect()]
    assert full == [tuple(r) for r in ranking.top_files(similarity.chunk_scores(df, qf, method, k=2), 2).orderBy("query_id", "rk").collect()]


def test_repository_and_empty_tokens(spark):
    rows = [("a", 0, [[1.0, 0.0]], "r0"), ("b", 0, [[0.0, 1.0]], "r1"), ("c", 0, [], "r0")]
    df = spark.createDataFrame(rows, CHUNKS + ", repo string")
    qf = spark.createDataFrame([(1, [[1.0, 0.0]], "r0"), (2, [], "r0")], QUERIES + ", repo string")
    assert [(r["query_id"], r["file_id"], r["score"]) for r in similarity.chunk_scores(df, qf).collect()] == [(1, "a", 1.0)]
    none = similarity.chunk_scores(df, qf.filter("query_id = 2"))
    assert none.collect() == []


def test_maxsim_of_itself_is_its_size_and_twin_plan(spark):
    rng = np.random.default_rng(1)
    tokens = rng.standard_normal((5, 8)).tolist()
    df, qf = spark.createDataFrame([("f", 0, tokens)], CHUNKS), spark.createDataFrame([(0, tokens)], QUERIES)
    assert math.isclose(similarity.chunk_scores(df, qf).first()["score"], 5)
    pairs = qf.select("query_id", F.posexplode("tokens").alias("q", "a")).join(df.select("file_id", F.explode("tokens").alias("b")))
    twin = pairs.groupBy("query_id", "file_id", "q").agg(F.max(cosine(F.col("a"), F.col("b"))).alias("s")).agg(F.sum("s")).first()[0]
    assert math.isclose(twin, 5)


@given(st.integers(0, 40), st.integers(1, 9), st.integers(1, 9))
@settings(max_examples=25, deadline=None)
def test_windows_cover_all(spark, n, window, stride):
    if stride > window:
        stride = window
    starts = spark.range(1).select(similarity.window_starts(F.lit(n), window, stride).alias("s")).first()["s"]
    covered = {i for s in starts for i in range(s, min(s + window, n))}
    assert covered == set(range(n)) and all(s == 0 or s + window <= n for s in starts) and len(set(starts)) == len(starts)


def test_pooling_is_token_weighted(spark):
    df = spark.createDataFrame([("f", 0, [[1.0], [1.0], [1.0]]), ("f", 1, [[5.0]])], CHUNKS)
    assert similarity.pooled_vectors(df, ["file_id"]).first()["vec"] == [2.0]


def test_segments_missing(spark):
    df = spark.createDataFrame([("a", 0, [[1.0, 0.0]]), ("b", 0, [])], CHUNKS)
    got = {r["file_id"]: r["score"] for r in similarity.segment_scores(df, spark.createDataFrame([(0, [[1.0, 0.0]])], QUERIES), 4, 2).collect()}
    assert got == {"a": 1.0, "b": -1e30}


def test_min_max(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0), (2, "a", 3.0), (2, "b", 3.0), (3, "a", 7.0)], "query_id long, file_id string, score double")
    got = {(r[0], r[1]): r[2] for r in ranking.scaled(rows, "x").collect()}
    assert got == {(1, "a"): 0.0, (1, "b"): 1.0, (2, "a"): 0.5, (2, "b"): 0.5, (3, "a"): 0.5}
    grid = rows.select("query_id", "file_id").union(spark.createDataFrame([(1, "c"), (3, "z")], "query_id long, file_id string"))
    got = {(r[0], r[1]): r[2] for r in ranking.scaled_with_missing(rows, grid, "x").collect()}
    assert got[1, "c"] == 0.0 and got[3, "a"] == got[3, "z"] == 0.5
    assert rows.select(min_max(F.lit(1.0), F.lit(0.0), F.lit(2.0))).first()[0] == 0.5


def test_rerank_keeps_order_of_ties(spark):
    short = spark.createDataFrame([(1, "z", 1), (1, "a", 2), (1, "m", 3)], "query_id long, file_id string, rk int")
    scores = spark.createDataFrame([(1, "z", 0.5), (1, "a", 0.5), (1, "m", 0.9)], "query_id long, file_id string, score double")
    assert [r["file_id"] for r in ranking.reranked(short, scores).orderBy("rk").collect()] == ["m", "z", "a"]


def test_metrics(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z"), (3, None)], "query_id long, file_id string")
    rank = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "b", 7), (2, "y", 1)], "query_id long, file_id string, rk int")
    got = {r["query_id"]: r for r in evaluate.instance_metrics(rank, gold).collect()}
    assert (got[1]["recall_1"], got[1]["recall_5"], got[1]["recall_10"], got[1]["mrr"]) == (0.5, 0.5, 1.0, 1.0)
    assert got[2]["recall_20"] == got[2]["mrr"] == 0.0 and got[3]["n_gold"] == 0 and got[3]["recall_20"] == 0.0


def test_medians(spark):
    log = spark.createDataFrame([("a", x) for x in (0.0, 1.0, 3.0, 5.0)] + [("b", 0.0)], "m string, l double")
    got = {r["m"]: r for r in evaluate.latency_medians(log, "m", "l").collect()}
    assert (got["a"]["positive_median"], got["a"]["median"], got["a"]["upper_median"]) == (3.0, 2.0, 3.0) and got["b"]["positive_median"] == 0.0


@pytest.mark.parametrize(("experiment", "r", "d", "want"), [("routing", 0.4, 0.2, "NO_LIFT"), ("routing", 0.46, 0.0, "MODEST_LIFT"), ("maxsim", 0.5, 0.0, "STRONG_SIGNAL"), ("hybrid", 0.1, 0.02, "FILTER_LIMITED"), ("hybrid", 0.1, 0.03, "MARGINAL_GAIN"), ("frozen", 0.9, 0.019, "CEILING"), ("nested", 0.1, -0.03, "HURTS"), ("multigranular", 0.0, -0.02, "NO_LIFT")])
def test_verdicts(spark, experiment, r, d, want):
    assert spark.range(1).select(evaluate.verdict(experiment, F.lit(r), F.lit(d))).first()[0] == want


def test_histogram_edges(spark):
    df = spark.createDataFrame([(-1.0,), (1.0,), (0.999,), (1.0000001,), (-0.2,)], "x double")
    assert {r["bin"]: r["n"] for r in diagnostics.histogram(df, "x").collect()} == {1: 1, 10: 3, 5: 1} or {r["bin"]: r["n"] for r in diagnostics.histogram(df, "x").collect()} == {1: 1, 10: 3, 4: 1}


def test_line_chunks(spark):
    docs = spark.createDataFrame([(1, "a b\nc\nd e f g h\ni\n"), (2, " \n "), (3, None), (4, "x")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["chunk_idx"], r["chunk"]) for r in chunking.line_chunks(docs, budget=3).collect())
    assert got == [(1, 0, "a b\nc\n"), (1, 1, "d e f g h\n"), (1, 2, "i\n"), (4, 0, "x")]


def test_fixed_chunks_and_batches(spark):
    docs = spark.createDataFrame([(1, list("abcdef")), (2, [])], "doc_id long, t array<string>")
    assert [r["chunk"] for r in chunking.fixed_chunks(docs, F.col("t"), 3).orderBy("chunk_idx").collect()] == [list("abc"), list("def")]
    items = spark.createDataFrame([("g", i, t) for i, t in enumerate([50, 60, 200, 1, 1, 1])], "g string, i int, t long")
    assert [r["batch"] for r in chunking.request_batches(items, "g", "i", "t", 2, 100).orderBy("i").collect()] == [0, 1, 2, 3, 3, 4]


SOURCE = "import a.b as c\nfrom . import x\nfrom p.q import r\nX: int = 1\nY = 2\nA, B = 1, 2\no.Z = 3\nlower = 4\n@dec\ndef f():\n    def inner(): pass\nclass C:\n    class D: pass\n    def m(self): pass\n    @staticmethod\n    def s(): pass\n"


def test_symbols(spark):
    found = [(k, n) for k, n, *_ in S.python_symbols(SOURCE)]
    assert found == [("import", "a.b"), ("import", "."), ("import", "p.q"), ("constant", "X"), ("constant", "Y"), ("function", "f"), ("class", "C"), ("method", "C.m"), ("method", "C.s")]
    start, end = next(x[2:] for x in S.python_symbols(SOURCE) if x[0] == "function")
    assert SOURCE.encode()[start:end].startswith(b"@dec\ndef f")
    assert [x[:2] for x in S.python_symbols("def g(:\nclass H\n")] == [("error", ""), ("function", "g"), ("class", "H")]
    files = spark.createDataFrame([("m.py", SOURCE), ("n.py", None)], "path string, content string")
    table = S.symbols(files)
    assert {r["name"] for r in S.definitions(table).collect()} == {"f", "C", "m", "s", "X", "Y"}
    assert [r["name"] for r in S.function_spans(table, 1).collect()] == ["f"]


def pool(spark, n, links, idents, low=5, high=200):
    files = [(f"f{i}",) for i in range(n)]
    defs = spark.createDataFrame([(f"n{i}", f"f{i}") for i in range(n)], "name string, file string")
    edges = spark.createDataFrame(links, "src string, dst string")
    ids = spark.createDataFrame(idents, "query_id long, name string")
    modes, members = S.candidate_pool(ids, ids, defs, edges, spark.createDataFrame(files, "file string"), low, high)
    size = {r["query_id"]: r["n"] for r in members.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    return {r["query_id"]: (r["mode"], r["primary_count"], r["extended_count"], size[r["query_id"]]) for r in modes.collect()}


def test_pools(spark):
    links = [("f0", f"f{i}") for i in range(1, 5)] + [("f7", f"f{i}") for i in range(20, 30)]
    got = pool(spark, 40, links, [(1, "none"), (2, "n9"), (3, "n0"), (4, "n7"), (5, "n7"), (5, "none")], 5, 10)
    assert got[1] == ("fallback_full", 0, 0, 40)
    assert got[2] == ("fallback_full", 1, 0, 40)
    assert got[3] == ("extended", 1, 4, 5)
    assert got[4] == got[5] == ("primary", 1, 0, 1)
    assert pool(spark, 40, [("x", "y")], [(1, f"n{i}") for i in range(11)], 5, 10)[1] == ("primary", 11, 0, 11)


def test_plugins(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    got = plugins.encode(docs, lambda: lambda texts: [np.full((len(t.split()), 2), 1.0) for t in texts], ["id"]).collect()
    assert {r["id"]: len(r["tokens"]) for r in got} == {1: 2, 2: 0}
    pairs = spark.createDataFrame([("a b", "b c")], "query_text string, doc_text string")
    assert plugins.score_pairs(pairs, lambda: lambda q, d: [len(x) + len(y) for x, y in zip(q, d)]).first()["score"] == 6.0
    assert math.isclose(pairs.select(plugins.jaccard(F.col("query_text"), F.col("doc_text"))).first()[0], 1 / 3)
    vec = docs.filter("id = 1").select(plugins.bag_of_words(F.col("text")).alias("v")).first()["v"]
    assert math.isclose(sum(x * x for x in vec), 1)
