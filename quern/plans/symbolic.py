"""Queries of the symbolic path: lookup, import expansion, candidate pools, routed ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import diagnostics, plugins, ranking
from quern.operators import symbols as S
from quern.operators.similarity import chunk_scores
from quern.plans import views as V
from quern.plans.retrieval import OUT, sql

QUERIES, ORACLES = {}, {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLES[f.__name__] = text
        return f

    return add


DEFS = "defs AS (SELECT p_brand || '/' || p_type AS name, CAST(p_partkey AS VARCHAR) AS file FROM part), allf AS (SELECT DISTINCT file FROM defs)"
EDGES = "edges AS (SELECT DISTINCT CAST(a.l_partkey AS VARCHAR) AS src, CAST(b.l_partkey AS VARCHAR) AS dst FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"
KNOWN = lambda lines: f"SELECT DISTINCT l_orderkey AS query_id, p_brand || '/' || p_type AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {lines}"
IDENTS = f"kn AS ({KNOWN('l_linenumber <= 2')}), ids AS (SELECT * FROM kn UNION ALL SELECT -o_orderkey, 'no/such name' FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT DISTINCT query_id, 'other/unknown' FROM kn WHERE query_id % 40 = 0)"
BASE = [DEFS, EDGES, IDENTS]
POOL = lambda low, high, ids="ids", p="": (
    f"{p}pri AS (SELECT DISTINCT query_id, file FROM {ids} JOIN defs USING (name)), {p}ext AS (SELECT query_id, file FROM {p}pri UNION SELECT query_id, dst FROM {p}pri JOIN edges ON src = file), "
    f"{p}cnt AS (SELECT q.query_id, coalesce(any_value(a.n), 0) AS p, coalesce(any_value(b.n), 0) AS e FROM (SELECT DISTINCT query_id FROM {ids}) q LEFT JOIN (SELECT query_id, count(*) AS n FROM {p}pri GROUP BY 1) a ON a.query_id = q.query_id LEFT JOIN (SELECT query_id, count(*) AS n FROM {p}ext GROUP BY 1) b ON b.query_id = q.query_id GROUP BY q.query_id), "
    f"{p}mode AS (SELECT query_id, p AS primary_count, CASE WHEN p = 0 THEN 'fallback_full' WHEN e > {high} THEN 'primary' WHEN e < {low} THEN 'fallback_full' ELSE 'extended' END AS mode, CASE WHEN p > 0 AND e > {high} THEN 0 ELSE e - p END AS extended_count FROM {p}cnt), "
    f"{p}mem AS (SELECT query_id, file FROM {p}pri JOIN {p}mode USING (query_id) WHERE mode = 'primary' UNION ALL SELECT query_id, file FROM {p}ext JOIN {p}mode USING (query_id) WHERE mode = 'extended' UNION ALL SELECT query_id, file FROM {p}mode CROSS JOIN allf WHERE mode = 'fallback_full')"
)


def _modes(spark, sf, low=S.MIN_POOL, idents: DataFrame | None = None) -> DataFrame:
    idents = V.idents(spark, sf) if idents is None else idents
    return S.pool_modes(idents, idents, V.defs(spark, sf), V.edges(spark, sf), low)


@query(sql(*BASE, out="SELECT query_id, name, file FROM ids JOIN defs USING (name)"))
def identifier_lookup(spark, sf):
    return S.lookup(V.idents(spark, sf), V.defs(spark, sf))


@query(sql(*BASE, out="SELECT query_id, name, name IN (SELECT name FROM defs) AS matched FROM ids"))
def matched_unmatched(spark, sf):
    hit, miss = S.matched_split(V.idents(spark, sf), V.defs(spark, sf))
    return hit.withColumn("matched", F.lit(True)).unionByName(miss.withColumn("matched", F.lit(False))).select("query_id", "name", "matched")


@query("SELECT p_brand || '/' || p_type AS name, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1")
def inverted_index(spark, sf):
    return V.defs(spark, sf).distinct().groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT a.src, b.dst FROM (SELECT DISTINCT 'm/' || p_partkey || '.py' AS src, 'x' || p_partkey % 50 AS stem FROM part) a JOIN (SELECT 'lib/' || p_brand || '/x' || p_partkey % 50 || '.py' AS dst, 'x' || p_partkey % 50 AS stem FROM part) b ON a.stem = b.stem WHERE a.src <> b.dst")
def import_edges(spark, sf):
    """Modules resolve to every file with their stem."""
    p = V.table(spark, sf, "part")
    n = (F.col("p_partkey") % 50).cast("string")
    imports = p.select(F.concat(F.lit("m/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("lib.x"), n).alias("name"))
    return S.import_edges(imports, p.select(F.concat(F.lit("lib/"), "p_brand", F.lit("/x"), n, F.lit(".py")).alias("path")).distinct())


@query(sql(EDGES, out="SELECT src, count(*) AS n FROM edges GROUP BY src"))
def import_graph_degrees(spark, sf):
    return V.edges(spark, sf).groupBy("src").agg(F.count("*").alias("n"))


SEED = "sd AS (SELECT DISTINCT l_orderkey AS query_id, CAST(l_partkey AS VARCHAR) AS file FROM lineitem WHERE l_linenumber = 1)"


def _seed(spark, sf) -> DataFrame:
    return V.table(spark, sf, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").cast("string").alias("file")).distinct()


@query(sql(EDGES, SEED, "h1 AS (SELECT query_id, file FROM sd UNION SELECT query_id, dst FROM sd JOIN edges ON src = file)", out="SELECT h1.query_id, h1.file, CAST(CASE WHEN sd.file IS NULL THEN 1 ELSE 0 END AS INT) AS depth FROM h1 LEFT JOIN sd ON sd.query_id = h1.query_id AND sd.file = h1.file"))
def expand_1hop(spark, sf):
    return S.expand(_seed(spark, sf), V.edges(spark, sf), 1)


@query(sql(EDGES, SEED, "w1 AS (SELECT query_id, file, 0 AS d FROM sd UNION ALL SELECT DISTINCT query_id, dst, 1 FROM sd JOIN edges ON src = file)", "w2 AS (SELECT * FROM w1 UNION ALL SELECT DISTINCT query_id, dst, 2 FROM w1 JOIN edges ON src = file WHERE d = 1)", out="SELECT query_id, file, CAST(min(d) AS INT) AS depth FROM w2 GROUP BY ALL"))
def expand_khop(spark, sf):
    return S.expand(_seed(spark, sf), V.edges(spark, sf), 2)


@query(sql(*BASE, POOL(5, 200), out="SELECT m.query_id, mode, primary_count, extended_count, (SELECT count(*) FROM mem WHERE mem.query_id = m.query_id) AS pool_size FROM mode m"))
def candidate_pool(spark, sf):
    return S.pool_sizes(_modes(spark, sf), V.defs(spark, sf).select("file"))


@query(sql(*BASE, POOL(150, 200), out="SELECT mode, count(*) AS n FROM mode GROUP BY mode"))
def pool_modes_large_minimum(spark, sf):
    return _modes(spark, sf, 150).groupBy("mode").agg(F.count("*").alias("n"))


@query(sql(*BASE, POOL(5, 200), out="SELECT query_id, file FROM mem"))
def pool_members(spark, sf):
    idents, defs = V.idents(spark, sf), V.defs(spark, sf)
    return S.candidate_pool(idents, idents, defs, V.edges(spark, sf), defs.select("file"))[1]


@query(sql(*BASE, POOL(5, 200), out="SELECT round(avg(CAST(primary_count = 0 AS INT)), 6) AS zero_rate, round(avg(CAST(mode = 'extended' AS INT)), 6) AS extended_rate FROM mode"))
def zero_candidate_rate(spark, sf):
    modes = _modes(spark, sf)
    return modes.agg(F.round(F.avg((F.col("primary_count") == 0).cast("int")), 6).alias("zero_rate"), F.round(F.avg((F.col("mode") == "extended").cast("int")), 6).alias("extended_rate"))


GENERATED = f"gen AS ({KNOWN('l_linenumber = 3')}), ids2 AS (SELECT query_id, name FROM ids UNION SELECT query_id, name FROM gen WHERE query_id IN (SELECT query_id FROM ids))"


@query(sql(*BASE, GENERATED, POOL(150, 200), POOL(150, 200, "ids2", "g"), out="SELECT mode.mode AS mode_before, gmode.mode AS mode_after, count(*) AS n FROM mode JOIN gmode USING (query_id) GROUP BY ALL"))
def fallback_conversion(spark, sf):
    """Pool modes before and after generated identifiers are added."""
    idents, gen = V.idents(spark, sf), V.order_names(spark, sf, "l_linenumber = 3")
    lists = lambda df, c: df.groupBy("query_id").agg(F.sort_array(F.collect_set("name")).alias(c))
    both = plugins.expand_identifiers(lists(idents, "idents"), lists(gen, "generated")).select("query_id", F.explode("idents").alias("name"))
    before, after = _modes(spark, sf, 150), _modes(spark, sf, 150, both)
    joined = before.select("query_id", F.col("mode").alias("mode_before")).join(after.select("query_id", F.col("mode").alias("mode_after")), "query_id")
    return joined.groupBy("mode_before", "mode_after").agg(F.count("*").alias("n"))


RANKED = lambda rows: f"best AS (SELECT query_id, file_id, round(max(score), 6) AS score FROM {rows} GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS rk FROM best QUALIFY rk <= 20)"


@query(sql(V.SQL_TOK, V.maxsim_sql(), "pm AS (SELECT DISTINCT q.query_id, f.file_id FROM q JOIN f ON CAST(f.file_id[2] AS INT) % 3 = q.query_id % 3)", "rs AS (SELECT sc.* FROM sc SEMI JOIN pm ON pm.query_id = sc.query_id AND pm.file_id = sc.file_id)", RANKED("rs"), out=OUT))
def routed_pool_ranking(spark, sf):
    """MaxSim of each query over its own pool only."""
    chunks, q = V.file_chunks(spark, sf), V.query_tokens(spark, sf)
    files = chunks.select("file_id").distinct()
    pool = files.join(F.broadcast(q.select("query_id")), F.substring("file_id", 2, 1).cast("int") % 3 == F.col("query_id") % 3)
    return ranking.top_files(chunk_scores(chunks, q).join(pool, ["query_id", "file_id"], "left_semi"))


@query(sql(*BASE, POOL(5, 200), "sz AS (SELECT query_id, count(*) AS n FROM mem GROUP BY 1)", "cl AS (SELECT query_id, mode, row_number() OVER (PARTITION BY mode ORDER BY query_id) AS rn FROM mode)", out="SELECT query_id, mode, rn FROM cl WHERE rn <= CASE mode WHEN 'fallback_full' THEN 1 ELSE 2 END"))
def sample_categories(spark, sf):
    """Two of each mode but one of the fallbacks, the first by id."""
    modes = _modes(spark, sf).select("query_id", "mode").withColumn("rn", F.row_number().over(Window.partitionBy("mode").orderBy("query_id")))
    return modes.filter("rn <= 2").filter(F.col("rn") <= F.when(F.col("mode") == "fallback_full", 1).otherwise(2))


@query(sql(*BASE, POOL(5, 200), "sz AS (SELECT query_id, count(*) AS n FROM mem GROUP BY 1)", out="SELECT count(*) AS n, round(avg(n), 6) AS mean, min(n) AS low, max(n) AS high, CAST(floor(median(n)) AS BIGINT) AS median, count(*) FILTER (WHERE n = 0) AS zeros FROM sz"))
def pool_size_stats(spark, sf):
    sizes = S.pool_sizes(_modes(spark, sf), V.defs(spark, sf).select("file"))
    return diagnostics.count_stats(sizes.filter("pool_size > 0").select(F.col("pool_size").alias("n")), "n")


@query("SELECT CAST(l_partkey AS VARCHAR) AS file FROM lineitem WHERE l_linenumber = 1 UNION SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 2")
def union_of_hits(spark, sf):
    li = V.table(spark, sf, "lineitem")
    pick = lambda k: li.filter(F.col("l_linenumber") == k).select(F.col("l_partkey").cast("string").alias("file"))
    return pick(1).union(pick(2)).distinct()


@query("SELECT l_partkey AS part FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_linenumber = 2")
def intersect_ids(spark, sf):
    li = V.table(spark, sf, "lineitem")
    pick = lambda k: li.filter(F.col("l_linenumber") == k).select(F.col("l_partkey").alias("part"))
    return pick(1).intersect(pick(2))


@query("SELECT l_partkey AS part FROM lineitem WHERE l_linenumber = 1 EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 5")
def except_frontier(spark, sf):
    li = V.table(spark, sf, "lineitem")
    pick = lambda k: li.filter(F.col("l_linenumber") == k).select(F.col("l_partkey").alias("part"))
    return pick(1).subtract(pick(5))
