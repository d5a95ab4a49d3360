"""Queries over the vector views: scorers, fusion, rankings, evaluation, diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import ROUTER_SHAPE, routed_level
from quern.functions.vectors import doubles
from quern.operators import diagnostics, evaluate, plugins, ranking
from quern.operators.similarity import chunk_scores, pooled_vectors, segment_scores, segments
from quern.plans import views as V

QUERIES, ORACLES = {}, {}
K = 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sql(*ctes: str, out: str) -> str:
    return "WITH " + ", ".join(c.strip().strip(",") for c in ctes) + " " + out


OUT = "SELECT query_id, file_id, score, rk FROM top"


def scores(spark, sf, method="maxsim", k=None) -> DataFrame:
    return chunk_scores(V.file_chunks(spark, sf), V.query_tokens(spark, sf), method, k)


def top(spark, sf, method="maxsim") -> DataFrame:
    return ranking.top_files(scores(spark, sf, method, K), K)


def _method(name: str, method: str, text: str) -> None:
    def run(spark, sf):
        return top(spark, sf, method)

    run.__name__ = name
    query(text)(run)


_method("maxsim_topk", "maxsim", sql(V.SQL_TOK, V.maxsim_sql(), V.TOP, out=OUT))
_method("cross_attention_topk", "cross_attention", sql(V.SQL_TOK, V.maxsim_sql(agg="avg"), V.TOP, out=OUT))
_method("pooled_chunk_topk", "pooled", sql(V.SQL_TOK, V.pooled_sql("f"), V.TOP, out=OUT))
for _h in (4, 8, 16, 32):
    _method(f"multi_head_h{_h}", f"mh_{_h}", sql(V.SQL_TOK, V.maxsim_sql(_h), V.TOP, out=OUT))
_method("late_interaction_h8", "late_int_8", sql(V.SQL_TOK, V.maxsim_sql(8), V.TOP, out=OUT))


def file_scores(spark, sf) -> DataFrame:
    """Pooled cosine with the token-weighted mean of a whole file."""
    vectors = pooled_vectors(V.file_chunks(spark, sf), ["file_id"])
    rows = vectors.select("file_id", F.lit(0).alias("chunk_id"), F.array("vec").alias("tokens"))
    return chunk_scores(rows, V.query_tokens(spark, sf), "pooled").select("query_id", "file_id", "score")


def level_rows(spark, sf) -> dict[str, DataFrame]:
    """Scores of all levels, of which a file may have several rows: what takes the best of a file gathers them itself."""
    chunks, q = V.file_chunks(spark, sf), V.query_tokens(spark, sf)
    every = lambda m: chunk_scores(chunks, q, m, by_file=True)
    return {"g0": file_scores(spark, sf), "g1": every("pooled"), "g2": segment_scores(chunks, q, 4, 2, best=False), "g3": every("maxsim")}


def level_scores(spark, sf) -> dict[str, DataFrame]:
    chunks, q = V.file_chunks(spark, sf), V.query_tokens(spark, sf)
    best = lambda m: ranking.best_per_file(chunk_scores(chunks, q, m, by_file=True))
    return {"g0": file_scores(spark, sf), "g1": best("pooled"), "g2": segment_scores(chunks, q, 4, 2), "g3": best("maxsim")}


G0 = f"fm0 AS ({V.mean_sql('f', 'file_id')}), g0 AS (SELECT query_id, file_id, list_cosine_similarity(qm.v, fm0.v) AS score FROM qm CROSS JOIN fm0)"
G1 = f"fm1 AS ({V.mean_sql('f', 'file_id, chunk_id')}), g1 AS (SELECT query_id, file_id, max(list_cosine_similarity(qm.v, fm1.v)) AS score FROM qm CROSS JOIN fm1 GROUP BY ALL)"
G2 = f"{V.SEGMENTS.strip()}, fm2 AS ({V.mean_sql('sg', 'file_id, chunk_id, s')}), g2 AS (SELECT query_id, file_id, max(list_cosine_similarity(qm.v, fm2.v)) AS score FROM qm CROSS JOIN fm2 GROUP BY ALL)"
G3 = f"{V.maxsim_sql().strip()}, g3 AS (SELECT query_id, file_id, max(score) AS score FROM sc GROUP BY ALL)"
TOP_OF = lambda s: f"top AS (SELECT query_id, file_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, file_id) AS rk FROM {s} QUALIFY rk <= 20)"
SCALED = ", ".join(f"n{i} AS (SELECT query_id, file_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-8) ELSE 0.5 END AS x FROM g{i} WINDOW w AS (PARTITION BY query_id))" for i in range(4))
ALL_LEVELS = [V.SQL_TOK, V.QMEAN, G0, G1, G2, G3]


@query(sql(V.SQL_TOK, V.QMEAN, G0, TOP_OF("g0"), out=OUT))
def pooled_file_topk(spark, sf):
    return ranking.ranked(file_scores(spark, sf), K)


@query(sql(V.SQL_TOK, V.QMEAN, G2, TOP_OF("g2"), out=OUT))
def func_pool_topk(spark, sf):
    return ranking.ranked(segment_scores(V.file_chunks(spark, sf), V.query_tokens(spark, sf), 4, 2), K)


def _overfetch(n: int) -> str:
    return sql(V.SQL_TOK, V.pooled_sql("f"), f"fst AS (SELECT query_id, file_id, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, file_id, chunk_id) <= {n})", "bst AS (SELECT query_id, file_id, max(score) AS score FROM fst GROUP BY ALL)", TOP_OF("bst"), out=OUT)


@query(_overfetch(200))
def overfetch_dedup_topk(spark, sf):
    return ranking.over_fetched(scores(spark, sf, "pooled"), K)


@query(_overfetch(12))
def overfetch_few_topk(spark, sf):
    """So few chunks are fetched that fewer than k files are left."""
    return ranking.over_fetched(scores(spark, sf, "pooled"), K, 12)


for _how, _expr in (("sum", "0.25 * n0.x + 0.25 * n1.x + 0.25 * n2.x + 0.25 * n3.x"), ("max", "greatest(n0.x, n1.x, n2.x, n3.x)")):

    def _mg(spark, sf, how=_how):
        return ranking.ranked(ranking.fused(level_rows(spark, sf), how), K)

    _mg.__name__ = f"mg_{_how}"
    query(sql(*ALL_LEVELS, SCALED, f"fu AS (SELECT query_id, file_id, {_expr} AS score FROM n0 JOIN n1 USING (query_id, file_id) JOIN n2 USING (query_id, file_id) JOIN n3 USING (query_id, file_id))", TOP_OF("fu"), out=OUT))(_mg)


ROUTER = ROUTER_SHAPE
ROUTE_TEXT = "CASE WHEN item_id % 3 = 0 THEN text || ' see core.utils' WHEN item_id % 3 = 1 THEN repeat(text || ' ', 4) ELSE text END"


def routes(spark, sf) -> DataFrame:
    text = F.expr(ROUTE_TEXT)
    rows = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("t"))
    return rows.select("query_id", routed_level(F.col("t"), F.size(F.filter(F.split("t", " "), lambda w: w != ""))).alias("level"))


ROUTES = f"rt AS (SELECT item_id AS query_id, CASE WHEN n < 30 AND regexp_matches(t, '{ROUTER}') THEN 'g3' WHEN n > 100 AND NOT regexp_matches(t, '{ROUTER}') THEN 'g0' ELSE 'g2' END AS level FROM (SELECT item_id, t, len(list_filter(string_split(t, ' '), lambda w: w <> '')) AS n FROM (SELECT item_id, {ROUTE_TEXT} AS t FROM benchmark)))"


@query(sql(ROUTES, out="SELECT query_id, level FROM rt"))
def query_routes(spark, sf):
    return routes(spark, sf)


@query(sql(*ALL_LEVELS, ROUTES, "un AS (" + " UNION ALL ".join(f"SELECT *, 'g{i}' AS level FROM g{i}" for i in range(4)) + ")", "ro AS (SELECT un.* FROM un JOIN rt USING (query_id, level))", "top AS (SELECT query_id, file_id, round(score, 6) AS score, level, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, file_id) AS rk FROM ro QUALIFY rk <= 20)", out="SELECT query_id, file_id, score, level, rk FROM top"))
def mg_routed(spark, sf):
    return ranking.ranked(ranking.routed(level_scores(spark, sf), routes(spark, sf)), K)


def function_vectors(spark, sf) -> DataFrame:
    """Segments as functions: (file_id, span, vec); files of even label have none."""
    rows = segments(V.file_chunks(spark, sf), 4, 2).filter(F.substring("file_id", 2, 1).cast("int") % 2 == 1)
    span = (F.col("chunk_id") * 1000 + F.col("start")).cast("long")
    return pooled_vectors(rows.select("file_id", span.alias("span"), "tokens"), ["file_id", "span"]).select("file_id", "span", "vec")


def nested_levels(spark, sf) -> dict[str, DataFrame]:
    q, fv = V.query_tokens(spark, sf), function_vectors(spark, sf)
    as_chunks = lambda df, c: df.select("file_id", c.cast("long").alias("chunk_id"), F.array("vec").alias("tokens"))
    whole = plugins.decayed_mean(fv, ["file_id"], "span")
    return {
        "l0": chunk_scores(V.file_chunks(spark, sf), q, "maxsim", by_file=True),
        "l1": chunk_scores(as_chunks(fv, F.col("span")), q, "pooled", by_file=True),
        "l2": chunk_scores(as_chunks(whole, F.lit(0)), q, "pooled"),
    }


NESTED = f"""{V.SEGMENTS.strip()}, fn AS (SELECT file_id, chunk_id * 1000 + s AS span, v FROM ({V.mean_sql('sg', 'file_id, chunk_id, s')}) WHERE CAST(file_id[2] AS INT) % 2 = 1),
l0 AS (SELECT query_id, file_id, max(score) AS score FROM sc GROUP BY ALL),
l1 AS (SELECT query_id, file_id, max(list_cosine_similarity(qm.v, fn.v)) AS score FROM qm CROSS JOIN fn GROUP BY ALL),
od AS (SELECT file_id, v, row_number() OVER (PARTITION BY file_id ORDER BY span DESC) AS r FROM fn),
fw AS (SELECT file_id, list(x ORDER BY d) AS v FROM (SELECT file_id, d, sum(x * pow(0.5, r)) AS x FROM (SELECT file_id, r, unnest(v) AS x, unnest(range(64)) AS d FROM od) GROUP BY ALL) GROUP BY ALL),
l2 AS (SELECT query_id, file_id, list_cosine_similarity(qm.v, fw.v) AS score FROM qm CROSS JOIN fw),
grid AS (SELECT query_id, file_id FROM l0 UNION SELECT query_id, file_id FROM l1 UNION SELECT query_id, file_id FROM l2),
""" + ", ".join(f"m{i} AS (SELECT grid.query_id, grid.file_id, CASE WHEN count(score) OVER w < 2 THEN 0.5 WHEN score IS NULL THEN 0.0 WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-8) ELSE 0.5 END AS x FROM grid LEFT JOIN l{i} USING (query_id, file_id) WINDOW w AS (PARTITION BY grid.query_id))" for i in range(3))


@query(sql(V.SQL_TOK, V.QMEAN, V.maxsim_sql(), NESTED, "co AS (SELECT query_id, file_id, (m0.x + m1.x + m2.x) / 3 AS score FROM m0 JOIN m1 USING (query_id, file_id) JOIN m2 USING (query_id, file_id))", TOP_OF("co"), out=OUT))
def nested_composite(spark, sf):
    return ranking.ranked(ranking.composite(nested_levels(spark, sf)), K)


ORDERED = ["mh_4", "mh_8", "mh_16"]


def rankings(spark, sf, methods=("pooled", "maxsim", "mh_8")) -> DataFrame:
    return reduce(DataFrame.unionByName, (top(spark, sf, m).withColumn("method", F.lit(m)) for m in methods))


def method_tops(methods) -> list[str]:
    """CTEs t_method(query_id, file_id, score, rk) of methods, each in a subquery of its own names."""
    out = []
    for m in methods:
        body = V.pooled_sql("f") if m == "pooled" else V.maxsim_sql(int(m[3:]) if m.startswith("mh_") else 1)
        out.append(f"t_{m} AS (WITH {body.strip()}, {V.TOP.strip()} SELECT query_id, file_id, score, rk FROM top)")
    return out


def union_tops(methods) -> str:
    return "rk_all AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, {i} AS method_order, * FROM t_{m}" for i, m in enumerate(methods)) + ")"


@query(sql(V.SQL_TOK, *method_tops(ORDERED), union_tops(ORDERED), "be AS (SELECT query_id, file_id, min(rk) AS best, min((method_order, rk)) AS seen FROM rk_all GROUP BY ALL)", out="SELECT query_id, file_id, CAST(1 - best AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY best, seen) AS rk FROM be QUALIFY rk <= 20"))
def mh_rank_ensemble(spark, sf):
    rows = reduce(DataFrame.unionByName, (top(spark, sf, m).withColumn("method_order", F.lit(i)) for i, m in enumerate(ORDERED)))
    return ranking.rank_ensemble(rows, K)


BASE = ["pooled", "maxsim", "mh_8"]
METRICS = "hit AS (SELECT m.method, g.query_id, g.repo, rk FROM gold g CROSS JOIN (SELECT DISTINCT method FROM rk_all) m LEFT JOIN rk_all r ON r.method = m.method AND r.query_id = g.query_id AND r.file_id = g.file_id), me AS (SELECT method, query_id, repo, " + ", ".join(f"CAST(coalesce(rk <= {k}, false) AS INT)::DOUBLE AS recall_{k}" for k in evaluate.CUTOFFS) + ", coalesce(1.0 / rk, 0) AS mrr FROM hit)"
MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in [*(f"recall_{k}" for k in evaluate.CUTOFFS), "mrr"])
EVAL = [V.SQL_TOK, *method_tops(BASE), union_tops(BASE), METRICS]


def metrics(spark, sf) -> DataFrame:
    return evaluate.instance_metrics(rankings(spark, sf), V.gold(spark, sf), ["method"])


@query(sql(*EVAL, out=f"SELECT method, count(*) AS n, {MEANS} FROM me GROUP BY method"))
def recall_mrr_by_method(spark, sf):
    return evaluate.means(metrics(spark, sf), ["method"])


SUMMARY = f"su AS (SELECT method, {MEANS} FROM me GROUP BY method)"


@query(sql(*EVAL, SUMMARY, out="SELECT s.method, round(s.recall_10 - b.recall_10, 6) AS delta_recall_10, round(s.mrr - b.mrr, 6) AS delta_mrr FROM su s CROSS JOIN (SELECT * FROM su WHERE method = 'maxsim') b"))
def method_deltas(spark, sf):
    return evaluate.method_deltas(evaluate.means(metrics(spark, sf), ["method"]), "maxsim")


REPO = ["maxsim"]
REPO_EVAL = [V.SQL_TOK, *method_tops(REPO), union_tops(REPO), METRICS, "ix AS (SELECT me.*, query_id % 5 <> 3 AS gold_in_index FROM me)", "pr2 AS (SELECT repo, count(*) AS n, count(*) FILTER (WHERE gold_in_index) AS n_indexable, round(avg(recall_10), 6) AS recall_10, round(avg(recall_10) FILTER (WHERE gold_in_index), 6) AS indexable_recall_10, round(avg(mrr), 6) AS mrr FROM ix GROUP BY ROLLUP (repo))"]


def per_repo(spark, sf) -> DataFrame:
    found = evaluate.instance_metrics(top(spark, sf), V.gold(spark, sf)).join(V.gold(spark, sf).select("query_id", "repo"), "query_id")
    return evaluate.repo_rollup(found.withColumn("gold_in_index", F.col("query_id") % 5 != 3))


@query(sql(*REPO_EVAL, out="SELECT * FROM pr2"))
def per_repo_breakdown(spark, sf):
    return per_repo(spark, sf)


@query(sql(*REPO_EVAL, out="SELECT arg_min(repo, (recall_10, repo)) AS hardest, arg_min(repo, (-recall_10, repo)) AS easiest FROM pr2 WHERE repo IS NOT NULL"))
def hardest_easiest_repo(spark, sf):
    return evaluate.hardest_easiest(per_repo(spark, sf))


@query("SELECT event_type, coalesce(median(value) FILTER (WHERE value > 0), 0) AS positive_median, median(value) AS median, avg(value) AS mean, list_sort(list(value))[count(value) // 2 + 1] AS upper_median FROM events GROUP BY event_type")
def latency_medians(spark, sf):
    return evaluate.latency_medians(V.table(spark, sf, "events"), "event_type", "value")


RESCUE = "h10 AS (SELECT method, query_id, coalesce(rk <= 10, false) AS hit FROM hit), rs AS (SELECT h.method, count(*) FILTER (WHERE h.hit AND NOT b.hit) AS rescues, count(*) FILTER (WHERE NOT h.hit AND b.hit) AS regressions, count(*) FILTER (WHERE h.hit AND b.hit) AS \"both\" FROM h10 h JOIN h10 b ON b.query_id = h.query_id AND b.method = 'pooled' GROUP BY h.method)"


@query(sql(*EVAL, RESCUE, out="SELECT * FROM rs"))
def rescue_regression(spark, sf):
    return evaluate.rescues(rankings(spark, sf), V.gold(spark, sf).select("query_id", "file_id"), "pooled")


def _ladder_sql(name: str) -> str:
    steps, other = evaluate.LADDERS[name]
    return "CASE " + " ".join(f"WHEN {'r' if m == 'r' else 'delta'} {'>' if m == 'over' else '>='} {x} THEN '{v}'" for m, x, v in steps) + f" ELSE '{other}' END AS {name}"


@query(sql(*EVAL, SUMMARY, "de AS (SELECT s.method, s.recall_10 AS r, round(s.recall_10 - b.recall_10, 6) AS delta FROM su s CROSS JOIN (SELECT * FROM su WHERE method = 'maxsim') b)", out="SELECT method, " + ", ".join(map(_ladder_sql, evaluate.LADDERS)) + " FROM de"))
def verdicts(spark, sf):
    summary = evaluate.means(metrics(spark, sf), ["method"])
    both = summary.select("method", F.col("recall_10").alias("r")).join(evaluate.method_deltas(summary, "maxsim"), "method")
    return both.select("method", *(evaluate.verdict(n, F.col("r"), F.col("delta_recall_10")).alias(n) for n in evaluate.LADDERS))


TWO = ["maxsim", "mh_8"]


@query(sql(V.SQL_TOK, *method_tops(TWO), "qs AS (SELECT DISTINCT query_id FROM t_maxsim)", out="SELECT qs.query_id, count(b.file_id) AS overlap, count(b.file_id) >= 5 AS sanity_ok FROM qs LEFT JOIN t_maxsim a ON a.query_id = qs.query_id AND a.rk <= 10 LEFT JOIN t_mh_8 b ON b.query_id = a.query_id AND b.file_id = a.file_id AND b.rk <= 10 GROUP BY qs.query_id"))
def overlap_sanity(spark, sf):
    return evaluate.overlap(top(spark, sf), top(spark, sf, "mh_8"))


@query(sql(V.SQL_TOK, *method_tops(TWO), "nq AS (SELECT count(DISTINCT query_id) AS n FROM t_maxsim)", out="SELECT file_id, count(DISTINCT query_id) AS n, round(count(DISTINCT query_id) / any_value(nq.n), 6) AS share FROM t_maxsim CROSS JOIN nq WHERE rk <= 10 GROUP BY file_id"))
def popular_file_bias(spark, sf):
    return evaluate.popularity(top(spark, sf))


@query(sql(V.SQL_TOK, *method_tops(["pooled", "maxsim"]), "r2 AS (SELECT g.query_id, p.rk AS p, m.rk AS m FROM gold g LEFT JOIN t_pooled p USING (query_id, file_id) LEFT JOIN t_maxsim m USING (query_id, file_id))", "ti AS (SELECT query_id, CASE WHEN coalesce(p, 99) > 3 AND coalesce(m, 99) <= 3 THEN 'strict' WHEN coalesce(p, 99) > 3 OR coalesce(m, 99) <= 3 THEN 'expanded' END AS tier FROM r2)", out="SELECT query_id, tier FROM ti WHERE tier = 'strict' OR (tier = 'expanded' AND (SELECT count(*) FROM ti WHERE tier = 'strict') < 30) ORDER BY md5(CAST(query_id AS VARCHAR) || '|42'), query_id LIMIT 80"))
def testset_strict_expand(spark, sf):
    g = V.gold(spark, sf).select("query_id", "file_id")
    rank = lambda m, c: g.join(top(spark, sf, m), ["query_id", "file_id"], "left").select("query_id", F.coalesce("rk", F.lit(99)).alias(c))
    rows = rank("pooled", "p").join(rank("maxsim", "m"), "query_id")
    return evaluate.strict_then_expanded(rows, (F.col("p") > 3) & (F.col("m") <= 3), (F.col("p") > 3) | (F.col("m") <= 3))


@query(sql(V.SQL_TOK, *method_tops(["maxsim"]), out="SELECT g.query_id, coalesce(CAST(rk AS VARCHAR), '>20') AS gold_rank FROM gold g LEFT JOIN t_maxsim USING (query_id, file_id)"))
def gold_rank_lookup(spark, sf):
    found = V.gold(spark, sf).select("query_id", "file_id").join(top(spark, sf), ["query_id", "file_id"], "left")
    return found.select("query_id", F.coalesce(F.col("rk").cast("string"), F.lit(">20")).alias("gold_rank"))


def vectors(spark, sf) -> DataFrame:
    return V.tok(spark, sf).select(F.col("vec_id").alias("id"), "v", "label")


NORM = "sqrt(list_sum(list_transform(v, lambda x: x * x)))"
SAMPLE = "sa AS (SELECT vec_id AS id, v FROM tok ORDER BY md5(CAST(vec_id AS VARCHAR) || '|0'), vec_id LIMIT 300), pw AS (SELECT list_cosine_similarity(a.v, b.v) AS c FROM sa a JOIN sa b ON a.id < b.id)"


@query(sql(V.SQL_TOK, f"cen AS ({V.mean_sql('tok', 'label')})", f"nn AS (SELECT label, count(*) AS n, round(avg({NORM}), 6) AS norm_mean, round(stddev_pop({NORM}), 6) AS norm_std, round(min({NORM}), 6) AS norm_min, round(max({NORM}), 6) AS norm_max FROM tok GROUP BY label)", "al AS (SELECT tok.label, round(avg(list_cosine_similarity(tok.v, cen.v)), 6) AS centroid_cos_mean FROM tok JOIN cen ON cen.label = tok.label GROUP BY tok.label)", out="SELECT * FROM nn JOIN al USING (label)"))
def index_quality(spark, sf):
    v = vectors(spark, sf)
    return diagnostics.norm_stats(v, ["label"]).join(diagnostics.centroid_alignment(v, ["label"]), "label")


@query(sql(V.SQL_TOK, SAMPLE, out="SELECT count(*) AS n_pairs, round(avg(c), 6) AS cos_mean, round(stddev_pop(c), 6) AS cos_std, round(min(c), 6) AS cos_min, round(max(c), 6) AS cos_max, round(quantile_cont(c, 0.5), 6) AS cos_p50, round(quantile_cont(c, 0.95), 6) AS cos_p95, avg(c) > 0.9 AND stddev_pop(c) < 0.05 AS collapsed FROM pw"))
def pairwise_quality(spark, sf):
    return diagnostics.pairwise_stats(vectors(spark, sf), 300)


@query(sql(V.SQL_TOK, SAMPLE, out="SELECT CAST(greatest(1, least(10, floor((c + 1) / 2 * 10) + 1)) AS INT) AS bin, count(*) AS n FROM pw GROUP BY 1"))
def pairwise_histogram(spark, sf):
    return diagnostics.histogram(diagnostics.pairwise(vectors(spark, sf), 300), "cos")


@query(sql(V.SQL_TOK, "dr AS (SELECT v AS a, list_transform(v, lambda x: round(x, 3)) AS b FROM tok)", "co AS (SELECT list_cosine_similarity(a, b) AS c, list_transform(range(1, 65), lambda i: abs(a[i] - b[i])) AS d FROM dr)", "fl AS (SELECT unnest(d) AS d FROM co)", out="SELECT round(avg(c), 6) AS cos_mean, round(min(c), 6) AS cos_min, round(quantile_cont(c, 0.05), 6) AS cos_p5, (SELECT round(avg(d), 9) FROM fl) AS diff_mean, (SELECT round(max(d), 9) FROM fl) AS diff_max, (SELECT round(quantile_cont(d, 0.95), 9) FROM fl) AS diff_p95 FROM co"))
def dtype_drift(spark, sf):
    v = vectors(spark, sf)
    return diagnostics.drift(v.select(F.col("v").alias("a"), F.transform("v", lambda x: F.round(x, 3)).alias("b")))


@query(sql(V.SQL_TOK, out="SELECT count(*) * 64 * 4 AS bytes FROM f"))
def pool_memory(spark, sf):
    return diagnostics.memory_bytes(V.file_chunks(spark, sf), 64)


@query(sql(V.SQL_TOK, V.SEGMENTS, "sn AS (SELECT file_id, count(*) AS n FROM st GROUP BY file_id)", out="SELECT count(*) AS n, round(avg(n), 6) AS mean, min(n) AS low, max(n) AS high, CAST(floor(median(n)) AS BIGINT) AS median, count(*) FILTER (WHERE n = 0) AS zeros FROM sn"))
def segment_stats(spark, sf):
    chunks = V.file_chunks(spark, sf)
    n = segments(chunks, 4, 2).groupBy("file_id").agg(F.count("*").alias("n"))
    every = chunks.select("file_id").distinct().join(n, "file_id", "left").fillna(0, ["n"])
    return diagnostics.count_stats(every, "n")


@query(sql(V.SQL_TOK, V.SEGMENTS, out="SELECT file_id, chunk_id, s AS start, least(s + 4, len(ts)) AS \"end\" FROM st"))
def sliding_windows(spark, sf):
    return segments(V.file_chunks(spark, sf), 4, 2).drop("tokens")


@query(sql(V.SQL_TOK, f"fm AS ({V.mean_sql('f', 'file_id')})", out="SELECT file_id, round(v[1], 6) AS v1, round(v[64], 6) AS v64, len(v) AS dim FROM fm"))
def mean_pooling(spark, sf):
    vec = pooled_vectors(V.file_chunks(spark, sf), ["file_id"])
    return vec.select("file_id", F.round(F.get("vec", F.lit(0)), 6).alias("v1"), F.round(F.get("vec", F.lit(63)), 6).alias("v64"), F.size("vec").cast("long").alias("dim"))


@query(sql(V.SQL_TOK, out="SELECT file_id, round(arg_max(v, f_tok)[1], 6) AS v1 FROM f GROUP BY file_id"))
def last_position_pooling(spark, sf):
    rows = V.tok(spark, sf).filter("vec_id % 10 <> 0").select(F.concat(F.lit("f"), "label", F.lit("_"), "blk").alias("file_id"), "vec_id", F.col("v").alias("vec"))
    return plugins.last_position(rows, ["file_id"], "vec_id").select("file_id", F.round(F.get("vec", F.lit(0)), 6).alias("v1"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark, sf):
    from quern.functions.vectors import norm

    return V.table(spark, sf, "embeddings").select("vec_id", F.round(norm(doubles(F.col("embedding"))), 6).alias("norm"))
