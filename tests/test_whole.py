"""Queries over all rows of their tables, held against SQL or brute force without id filters."""

import hashlib
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.operators import ranking, symbols
from quern.plans import text
from quern.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def found(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())


def test_contains_gold_looks_for_all_items(spark):
    want = duckdb.sql(f"SELECT DISTINCT b.item_id, d.doc_id FROM '{SF}/benchmark.parquet' b JOIN '{SF}/documents.parquet' d ON contains(d.text, b.text)").fetchall()
    assert max(i for i, _ in want) >= 20
    assert found(QUERIES["contains_gold"](spark, SF).select("item_id", "doc_id")) == sorted(want)


def test_item_blocks_hold_all_items_once(spark):
    items = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(50)] + [(50, None)], "item_id long, t string")
    blocks = text.item_blocks(items, "t", 40)
    assert len(blocks) == 4 and sorted(r[0] for b in blocks for r in b.collect()) == list(range(51))


def six(x: float) -> float:
    return float(Decimal(repr(x)).quantize(Decimal("1e-6"), ROUND_HALF_UP))


def words(t: str) -> set[str]:
    return {w for w in t.split(" ") if w}


def test_rerank_shortlist_ranks_all_documents_for_all_items(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    docs = [(str(i), n, words(t[:6000])) for i, n, t in duckdb.sql(f"SELECT doc_id, n_chars, text FROM '{SF}/documents.parquet'").fetchall()]
    want = []
    for q, t in items:
        short = sorted(docs, key=lambda d: (-six(1.0 / (1 + abs(d[1] - 1000 - 10 * q))), d[0]))[:100]  # noqa: B023
        new = [(-six(len(words(t) & w) / max(len(words(t) | w), 1)), rk, f) for rk, (f, _, w) in enumerate(short)]
        want += [(q, f, -s, rk) for rk, (s, _, f) in enumerate(sorted(new)[:20], 1)]
    got = found(QUERIES["rerank_shortlist"](spark, SF).select("query_id", "file_id", "score", "rk"))
    assert len(items) > 8 and any(int(f) % 5 for _, f, _, _ in want)
    assert [(q, f, round(s, 6), rk) for q, f, s, rk in got] == sorted((q, f, s + 0.0, rk) for q, f, s, rk in want)


def test_nearest_lengths_keeps_what_a_ranking_needs(spark):
    """Ties after rounding at great distance, a null length, exact halves, and more queries than one block."""
    rows = [(str(i), n) for i, n in enumerate([None, 1127, 1639, 900_000, 900_100, 900_200, 500_000, 1000, 1001, 1000])]
    files = spark.createDataFrame(rows, "file_id string, n_chars long").repartition(3)
    queries = spark.createDataFrame([(q,) for q in (0, 1, 7)], "query_id long")
    score = (1.0 / (1 + F.abs(F.col("n_chars") - 1000 - 10 * F.col("query_id")))).alias("score")
    for k in (1, 2, 5, 9, 10):
        near, n = text.nearest_lengths(files, queries, k, block=2)
        got = ranking.ranked(near.select("query_id", "file_id", score), k)
        want = ranking.ranked(files.crossJoin(queries).select("query_id", "file_id", score), k)
        assert n == 3 and found(got.select("query_id", "rk", "file_id")) == found(want.select("query_id", "rk", "file_id"))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", "identifier_lookup matched_unmatched candidate_pool pool_modes_large_minimum pool_members zero_candidate_rate fallback_conversion sample_categories pool_size_stats expand_1hop expand_khop".split())
def test_symbolic_queries_take_all_orders(spark, db, name):
    whole = ORACLES[name]
    assert "l_orderkey %" not in whole
    got = QUERIES[name](spark, SF)
    cols = ", ".join(sorted(got.columns))
    assert found(got.select(*sorted(got.columns))) == sorted(db.sql(f"SELECT {cols} FROM ({whole})").fetchall())


def test_pool_unites_narrow_names_and_skips_wide_ones(spark):
    """Bounds 2 and 4: a wide name, two narrow ones whose union is beyond, one that stays, one too small, none."""
    idents = spark.createDataFrame([(1, "w"), (1, "a"), (2, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "none")], "query_id long, name string")
    defs = spark.createDataFrame([("w", f"w{i}") for i in range(5)] + [("a", "a1"), ("a", "a2"), ("b", "b1"), ("b", "a1"), ("c", "c1")], "name string, file string")
    edges = spark.createDataFrame([("a1", "x"), ("a2", "x"), ("b1", "y")], "src string, dst string")
    modes, members = symbols.candidate_pool(idents, idents, defs, edges, defs.select("file"), 2, 4)
    assert found(modes) == [(1, "primary", 7, 0), (2, "primary", 3, 0), (3, "extended", 2, 1), (4, "fallback_full", 1, 0), (5, "fallback_full", 0, 0)]
    sizes = found(members.groupBy("query_id").count())
    assert sizes == [(1, 7), (2, 3), (3, 3), (4, 9), (5, 9)] == found(symbols.pool_sizes(modes, defs.select("file")).select("query_id", "pool_size"))


def test_chunk_headers_keep_whole_texts(spark):
    docs = duckdb.sql(f"SELECT doc_id, source, text FROM '{SF}/documents.parquet' WHERE regexp_matches(text, '\\S')").fetchall()
    assert any(len(t) > 6000 for _, _, t in docs)
    want = [(i, hashlib.md5(f"# File: {s}\n\n{t}".encode()).hexdigest()) for i, s, t in docs]
    assert found(QUERIES["chunk_headers"](spark, SF).select("doc_id", "h")) == sorted(want)


def shuffled(spark, df) -> tuple[list[tuple], int]:
    """Rows of df, and how many rows were shuffled for them."""
    sc = spark.sparkContext

    def written() -> int:
        empty = sc._jvm.java.util.ArrayList
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(empty(), False, False, sc._gateway.new_array(sc._jvm.double, 0), empty())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    rows = found(df)
    return rows, written() - before


@pytest.fixture(scope="module")
def wide(spark):
    """400 queries of one name of 500 files, and one of an unknown name."""
    idents = spark.range(400).select(F.col("id").alias("query_id"), F.lit("w").alias("name")).union(spark.createDataFrame([(-1, "none")], "query_id long, name string"))
    defs = spark.range(500).select(F.lit("w").alias("name"), F.concat(F.lit("f"), "id").alias("file"))
    return idents, defs, defs.select(F.col("file").alias("src"), F.lit("x").alias("dst"))


def test_lookup_deals_out_a_frequent_name(spark, wide):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = symbols.lookup(*wide[:2])
        assert pairs.select(F.spark_partition_id()).distinct().count() == 4
        assert found(pairs) == sorted((q, "w", f"f{i}") for q in range(400) for i in range(500))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pool_modes_do_not_list_members(spark, wide):
    idents, defs, edges = wide
    rows, n = shuffled(spark, symbols.candidate_pool(idents, idents, defs, edges, defs.select("file"))[0])
    assert rows == [(-1, "fallback_full", 0, 0), *((q, "primary", 500, 0) for q in range(400))] and n < 20_000


def test_pool_members_are_not_shuffled(spark, wide):
    idents, defs, edges = wide
    rows, n = shuffled(spark, symbols.candidate_pool(idents, idents, defs, edges, defs.select("file"))[1])
    assert rows == sorted((q, f"f{i}") for q in range(-1, 400) for i in range(500)) and n < 20_000


def test_pool_counts_a_file_of_two_names_once(spark, monkeypatch):
    monkeypatch.setattr(symbols, "FILE_ROWS", 2)  # three blocks
    idents = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, None), (4, "a"), (None, "a")], "query_id long, name string")
    defs = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("b", "3"), ("b", "3"), ("c", "4"), (None, "5")], "name string, file string")
    edges = spark.createDataFrame([("1", "9"), ("9", "8")], "src string, dst string")
    for least, most in ((2, 2), (1, 9), (9, 9)):
        modes, members = symbols.candidate_pool(idents, idents, defs, edges, defs.select("file"), least, most)
        pools = {1: {"1", "2", "3"}, 2: {"2", "3"}, 3: set(), 4: {"1", "2"}, None: set()}
        near = {q: p | ({"9"} if "1" in p else set()) for q, p in pools.items()}
        want = {}
        for q, p in pools.items():
            mode = "fallback_full" if not p else "primary" if len(near[q]) > most else "fallback_full" if len(near[q]) < least else "extended"
            want[q] = (mode, p if mode == "primary" else near[q] if mode == "extended" else {"1", "2", "3", "4", "5"})
        assert {r["query_id"]: (r["mode"], r["primary_count"]) for r in modes.collect()} == {q: (m, len(pools[q])) for q, (m, _) in want.items()}
        assert sorted(map(str, (tuple(r) for r in members.collect()))) == sorted(str((q, f)) for q, (_, fs) in want.items() for f in fs)


def test_expand_does_not_shuffle_what_queries_reach(spark):
    seed = spark.range(300).select(F.col("id").alias("query_id"), F.lit("s").alias("file"))
    edges = spark.createDataFrame([("s", "m")], "src string, dst string").union(spark.range(400).select(F.lit("m"), F.col("id").cast("string")))
    rows, n = shuffled(spark, symbols.expand(seed, edges, 2).groupBy().agg(F.count("*"), F.sum("depth")))
    assert rows == [(300 * 402, 300 * 801)] and n < 5_000


def test_expand_unites_the_files_of_a_query(spark, monkeypatch):
    """Queries of one, a few and many files against a plain search, with cycles, repeated rows and a file of no edges."""
    monkeypatch.setattr(symbols, "UNITED", 3)
    links = {(a, (a * a + k) % 23) for a in range(20) for k in (1, 2)}
    seeds = {(q, (q * 7 + i * 3) % 23) for q in range(12) for i in range(q % 6 + 1)}
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in links] * 2, "src string, dst string")
    seed = spark.createDataFrame([(q, str(f)) for q, f in seeds] * 2, "query_id long, file string")
    for hops in (0, 1, 2, 3):
        want = {}
        for q, f in seeds:
            reach = {f: 0}
            for k in range(1, hops + 1):
                for a, b in links:
                    if reach.get(a) == k - 1:
                        reach.setdefault(b, k)
            for x, d in reach.items():
                want[q, str(x)] = min(d, want.get((q, str(x)), d))
        assert found(symbols.expand(seed, edges, hops)) == sorted((*k, d) for k, d in want.items())


def test_import_edges_do_not_gather_pairs(spark):
    """Repeated rows on both sides, and a stem of many modules and files, whose pairs are not shuffled."""
    imports = spark.range(400).select(F.concat(F.lit("m/"), F.col("id") % 200, F.lit(".py")).alias("path"), F.concat(F.lit("a"), F.col("id") % 3, F.lit(".x")).alias("name"))
    files = spark.range(200).select(F.concat(F.lit("lib/"), F.col("id") % 100, F.lit("/x.py")).alias("path"))
    rows, n = shuffled(spark, symbols.import_edges(imports, files))
    assert rows == sorted((f"m/{a}.py", f"lib/{b}/x.py") for a in range(200) for b in range(100)) and n < 2_000
