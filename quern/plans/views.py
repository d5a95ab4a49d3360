"""Stand-in views over the test tables, once as DataFrames and once as SQL for the oracle.

tok: vectors in blocks of 100; every tenth is a token of the block's query, the rest are tokens of files, named by label
and block, in chunks of 50 ids. docs_as_files: documents with a path and their length as size. defs, edges: parts as
files that define a brand/type name and import the part of the next line of an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.vectors import doubles

FOLDERS = ["tests", "test", "docs", "doc", "build", "dist", "migrations", "core", "utils", "lib"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tok(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("v"), F.expr("vec_id div 100").alias("blk"))


def query_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, tokens): at most ten tokens a query, so they are gathered."""
    rows = tok(spark, sf).filter("vec_id % 10 = 0").groupBy(F.col("blk").alias("query_id"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda x: x["v"]).alias("tokens"))


def file_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, chunk_id, tokens): at most 45 tokens a chunk."""
    rows = tok(spark, sf).filter("vec_id % 10 <> 0").select(F.concat(F.lit("f"), "label", F.lit("_"), "blk").alias("file_id"), F.expr("vec_id div 50").alias("chunk_id"), "vec_id", "v")
    return rows.groupBy("file_id", "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda x: x["v"]).alias("tokens"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, file_id, repo): the file of the label of a block's first vector."""
    rows = tok(spark, sf).filter("vec_id % 100 = 0")
    return rows.select(F.col("blk").alias("query_id"), F.concat(F.lit("f"), "label", F.lit("_"), "blk").alias("file_id"), F.concat(F.lit("r"), F.col("blk") % 2).alias("repo"))


def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = F.get(F.array(*(F.lit(x) for x in FOLDERS)), (F.col("doc_id") % 10).cast("int"))
    path = F.concat("source", F.lit("/"), folder, F.lit("/mod_"), F.col("doc_id").cast("string"), F.lit(".py"))
    return table(spark, sf, "documents").select("doc_id", path.alias("path"), F.col("n_chars").alias("size"), "source")


def defs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.concat("p_brand", F.lit("/"), "p_type").alias("name"), F.col("p_partkey").cast("string").alias("file"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").cast("string").alias("src"))
    b = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).filter("src <> dst").select("src", "dst").distinct()


def order_names(spark: SparkSession, sf: str, lines: str) -> DataFrame:
    """(query_id, name) of some lines of all orders, the stand-in queries."""
    li = table(spark, sf, "lineitem").filter(lines)
    part = table(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("name"))
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("query_id"), "name").distinct()


def idents(spark: SparkSession, sf: str) -> DataFrame:
    """Names of all orders; some have an unknown name besides, and queries of an unknown name alone are added."""
    known = order_names(spark, sf, "l_linenumber <= 2")
    some = table(spark, sf, "orders").filter("o_orderkey % 100 = 0").select((-F.col("o_orderkey")).alias("query_id"), F.lit("no/such name").alias("name"))
    mixed = known.filter("query_id % 40 = 0").select("query_id", F.lit("other/unknown").alias("name")).distinct()
    return known.unionByName(some).unionByName(mixed)


SQL_TOK = """
tok AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, vec_id // 100 AS blk FROM embeddings),
q AS (SELECT blk AS query_id, vec_id AS q_tok, v FROM tok WHERE vec_id % 10 = 0),
f AS (SELECT 'f' || label || '_' || blk AS file_id, vec_id // 50 AS chunk_id, vec_id AS f_tok, v FROM tok WHERE vec_id % 10 <> 0),
gold AS (SELECT blk AS query_id, 'f' || label || '_' || blk AS file_id, 'r' || (blk % 2) AS repo FROM tok WHERE vec_id % 100 = 0)
"""


def mean_sql(rows: str, by: str) -> str:
    """SELECT of (by, v): the mean vector of rows by by."""
    return f"SELECT {by}, list(m ORDER BY d) AS v FROM (SELECT {by}, d, avg(x) AS m FROM (SELECT {by}, unnest(v) AS x, unnest(range(64)) AS d FROM {rows}) GROUP BY {by}, d) GROUP BY {by}"


def maxsim_sql(heads: int = 1, agg: str = "sum") -> str:
    """CTEs that end in sc(query_id, file_id, chunk_id, score), from q and f."""
    if heads == 1:
        return f"""
pr AS (SELECT query_id, q_tok, file_id, chunk_id, max(list_cosine_similarity(q.v, f.v)) AS s FROM q CROSS JOIN f GROUP BY ALL),
sc AS (SELECT query_id, file_id, chunk_id, {agg}(s) AS score FROM pr GROUP BY ALL)
"""
    d = 64 // heads
    project = "list_transform(range(64), lambda j: list_sum(list_transform(range(64), lambda i: v[i + 1] * (CASE WHEN bit_count(i & j) % 2 = 1 THEN -0.125 ELSE 0.125 END))))"
    return f"""
qp AS (SELECT query_id, q_tok, {project} AS v FROM q), fp AS (SELECT file_id, chunk_id, f_tok, {project} AS v FROM f),
h AS (SELECT unnest(range({heads})) AS h),
qh AS (SELECT query_id, q_tok, h, v[h * {d} + 1 : (h + 1) * {d}] AS v FROM qp CROSS JOIN h), fh AS (SELECT file_id, chunk_id, h, v[h * {d} + 1 : (h + 1) * {d}] AS v FROM fp CROSS JOIN h),
pr AS (SELECT query_id, q_tok, qh.h AS h, file_id, chunk_id, max(list_cosine_similarity(qh.v, fh.v)) AS s FROM qh JOIN fh ON qh.h = fh.h GROUP BY ALL),
sc AS (SELECT query_id, file_id, chunk_id, sum(s) AS score FROM pr GROUP BY ALL)
"""


TOP = """
best AS (SELECT query_id, file_id, round(max(score), 6) AS score FROM sc GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS rk FROM best QUALIFY rk <= 20)
"""
QMEAN = f"qm AS ({mean_sql('q', 'query_id')})"


def pooled_sql(rows: str, by: str = "file_id, chunk_id") -> str:
    """CTEs that end in sc, the cosine of mean vectors."""
    return f"{QMEAN}, fm AS ({mean_sql(rows, by)}), sc AS (SELECT query_id, {by}, list_cosine_similarity(qm.v, fm.v) AS score FROM qm CROSS JOIN fm)"


#: Sliding windows of 4 tokens, stride 2, over the tokens of a chunk.
SEGMENTS = """
n AS (SELECT file_id, chunk_id, list(f_tok ORDER BY f_tok) AS ts FROM f GROUP BY ALL),
st AS (SELECT file_id, chunk_id, ts, unnest(CASE WHEN len(ts) <= 4 THEN [0] ELSE list_distinct(list_concat(range(0, len(ts) - 3, 2), [len(ts) - 4])) END) AS s FROM n),
sg AS (SELECT st.file_id, st.chunk_id, s, f.v FROM (SELECT file_id, chunk_id, s, unnest(ts[s + 1 : s + 4]) AS t FROM st) st JOIN f ON f.f_tok = st.t)
"""
