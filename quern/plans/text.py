"""Queries over documents, paths, patches and identifiers."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunking, diagnostics, evaluate, plugins, ranking
from quern.operators.symbols import SymbolTable
from quern.plans import views as V
from quern.plans.retrieval import ORACLES as _O
from quern.plans.retrieval import QUERIES as _Q
from quern.sources import corpus

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FOLDER_SQL = "[" + ", ".join(f"'{x}'" for x in V.FOLDERS) + "]"
FILES = f"fi AS (SELECT doc_id, source, source || '/' || ({FOLDER_SQL})[doc_id % 10 + 1] || '/mod_' || doc_id || '.py' AS path, CASE WHEN doc_id % 17 = 0 THEN 0 WHEN doc_id % 19 = 0 THEN 1000001 ELSE n_chars END AS size FROM documents)"
_LIKE = " OR ".join(f"'/' || path LIKE '{('' if p.startswith('*') else '%') + p.replace('_', chr(92) + '_').replace('*', '%')}' ESCAPE '{chr(92)}'" for p in T.EXCLUDE_PATTERNS)
CLASS_SQL = f"CASE WHEN size <= 0 THEN 'empty' WHEN size > 1000000 THEN 'too_big' WHEN {_LIKE} THEN 'pattern' ELSE 'kept' END"


def files(spark, sf) -> DataFrame:
    size = F.when(F.col("doc_id") % 17 == 0, 0).when(F.col("doc_id") % 19 == 0, 1_000_001).otherwise(F.col("size"))
    return V.doc_files(spark, sf).withColumn("size", size.cast("long"))


@query(f"WITH {FILES} SELECT path, size FROM fi WHERE {CLASS_SQL} = 'kept'")
def corpus_filter(spark, sf):
    return corpus.eligible_files(files(spark, sf)).select("path", "size")


@query(f"WITH {FILES} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {CLASS_SQL} = '{k}') AS {k}" for k in ("kept", "pattern", "too_big", "empty")) + " FROM fi")
def filter_stats(spark, sf):
    return corpus.filter_stats(files(spark, sf))


@query(f"WITH {FILES} SELECT path, size FROM fi WHERE size > 64 ORDER BY string_split(path, '/') LIMIT 10")
def smoke_files(spark, sf):
    return corpus.smoke_files(files(spark, sf)).select("path", "size")


@query(f"WITH {FILES} SELECT source, substr(sha256('files_v1' || string_agg(path || size, '' ORDER BY path)), 1, 16) AS signature FROM fi GROUP BY source")
def cache_signature(spark, sf):
    return corpus.signature(files(spark, sf), "files_v1", ["source"], F.col("size").cast("string"))


WORDS = "list_filter(string_split(text, ' '), lambda w: w <> '')"


@query(f"WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, ws, unnest(range(0, len(ws), 150)) AS s FROM w) SELECT doc_id, CAST(s // 150 AS INT) AS chunk_idx, len(ws[s + 1 : s + 150]) AS n, md5(array_to_string(ws[s + 1 : s + 150], ' ')) AS h FROM c")
def fixed_chunks(spark, sf):
    tokens = F.filter(F.split("text", " "), lambda w: w != "")
    rows = chunking.fixed_chunks(V.table(spark, sf, "documents"), tokens, 150)
    return rows.select("doc_id", "chunk_idx", F.size("chunk").cast("long").alias("n"), F.md5(F.array_join("chunk", " ")).alias("h"))


LINE_CHUNKS = """
WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS s, len(string_split(text, chr(10))) AS m FROM documents WHERE regexp_matches(text, '\\S')),
n AS (SELECT doc_id, i, s || CASE WHEN i < m THEN chr(10) ELSE '' END AS s, len(regexp_extract_all(s, '\\S+')) AS t FROM l),
r AS (SELECT doc_id, i, s, 0 AS g, t AS held FROM n WHERE i = 1
      UNION ALL SELECT n.doc_id, n.i, n.s, CASE WHEN r.held + n.t > 100 THEN r.g + 1 ELSE r.g END, CASE WHEN r.held + n.t > 100 THEN n.t ELSE r.held + n.t END FROM r JOIN n ON n.doc_id = r.doc_id AND n.i = r.i + 1 AND n.s <> '')
SELECT doc_id, CAST(g AS INT) AS chunk_idx, md5(string_agg(s, '' ORDER BY i)) AS h FROM r WHERE s <> '' GROUP BY doc_id, g
"""


@query(LINE_CHUNKS)
def line_chunks(spark, sf):
    return chunking.line_chunks(V.table(spark, sf, "documents"), budget=100).select("doc_id", "chunk_idx", F.md5("chunk").alias("h"))


@query("""
WITH RECURSIVE n AS (SELECT conv_id, turn, length(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE turn IS NOT NULL),
r AS (SELECT conv_id, turn, i, 0 AS b, 1 AS c, t AS held FROM n WHERE i = 1
      UNION ALL SELECT n.conv_id, n.turn, n.i, CASE WHEN r.c + 1 > 3 OR r.held + n.t > 900 THEN r.b + 1 ELSE r.b END, CASE WHEN r.c + 1 > 3 OR r.held + n.t > 900 THEN 1 ELSE r.c + 1 END, CASE WHEN r.c + 1 > 3 OR r.held + n.t > 900 THEN n.t ELSE r.held + n.t END FROM r JOIN n ON n.conv_id = r.conv_id AND n.i = r.i + 1)
SELECT conv_id, turn, CAST(b AS INT) AS batch FROM r
""")
def request_batches(spark, sf):
    rows = V.table(spark, sf, "conversations").filter("turn is not null").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("t"))
    return chunking.request_batches(rows, "conv_id", "turn", "t", 3, 900)


@query("SELECT doc_id, md5('# File: ' || source || chr(10) || chr(10) || text) AS h FROM documents WHERE regexp_matches(text, '\\S')")
def chunk_headers(spark, sf):
    docs = V.table(spark, sf, "documents").filter(T.not_blank(F.col("text")))
    return docs.select("doc_id", F.md5(T.with_header(F.col("source"), F.col("text"))).alias("h"))


#: Non-ASCII letters are folded, as engines differ in what a word boundary is beside them.
FOLDED = "regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') || ' see `os.path.join(a, b)` and max_length, class Foo' || doc_id || ', self'"
_SHAPE = lambda s: f"regexp_extract_all(t, '{s}')"
IDENT_SQL = f"""
WITH d AS (SELECT doc_id, {FOLDED} AS t FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, list_concat({", ".join(_SHAPE(s) for s in T.SHAPES)}, flatten(list_transform(regexp_extract_all(t, '`([^`\\n]{{1,80}})`', 1), lambda q: regexp_split_to_array(q, '[\\s()\\[\\],:=]+'))), regexp_extract_all(t, '\\b(?:def|class)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) AS l FROM d),
e AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM x),
k AS (SELECT doc_id, w, min(i) AS i FROM e WHERE regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_.]*$') AND w NOT IN ({", ".join(f"'{w}'" for w in T.NOT_IDENTIFIERS)}) GROUP BY ALL)
"""


def identifiers(spark, sf) -> DataFrame:
    folded = F.concat(F.regexp_replace("text", "[^\\x00-\\x7F]", "x"), F.lit(" see `os.path.join(a, b)` and max_length, class Foo"), F.col("doc_id").cast("string"), F.lit(", self"))
    return V.table(spark, sf, "documents").filter("text is not null").select("doc_id", T.extract_identifiers(folded).alias("idents"))


@query(IDENT_SQL + "SELECT doc_id, string_agg(w, ',' ORDER BY i) AS idents FROM k GROUP BY doc_id")
def extract_identifiers(spark, sf):
    return identifiers(spark, sf).select("doc_id", F.array_join("idents", ",").alias("idents"))


@query(IDENT_SQL + ", n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id) SELECT count(*) AS n, round(avg(n), 6) AS mean, min(n) AS low, max(n) AS high, CAST(floor(median(n)) AS BIGINT) AS median, count(*) FILTER (WHERE n = 0) AS zeros FROM n")
def identifier_stats(spark, sf):
    return diagnostics.count_stats(identifiers(spark, sf).select(F.size("idents").cast("long").alias("n")), "n")


PATCH_SPARK = "concat('diff --git a/x b/', source, '/del.py\\n', IF(doc_id % 4 = 0, '+++ /dev/null\\n', concat('--- a/x\\n+++ b/', source, '/a ', doc_id % 7, '.py\\n+++ b/z.py\\n+++ b/z.py\\n')))"
PATCH_SQL = "'diff --git a/x b/' || source || '/del.py' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '+++ /dev/null' || chr(10) ELSE '--- a/x' || chr(10) || '+++ b/' || source || '/a ' || (doc_id % 7) || '.py' || chr(10) || '+++ b/z.py' || chr(10) || '+++ b/z.py' || chr(10) END"


@query(f"WITH p AS (SELECT doc_id, {PATCH_SQL} AS p FROM documents), g AS (SELECT doc_id, regexp_extract_all(p, '(?m)^\\+\\+\\+ b/(.+)$', 1) AS w, regexp_extract_all(p, '(?m)^diff --git a/.+ b/(.+)$', 1) AS o FROM p), l AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN w ELSE o END AS l FROM g), e AS (SELECT doc_id, trim(unnest(l)) AS f, generate_subscripts(l, 1) AS i FROM l), m AS (SELECT doc_id, f, min(i) AS i FROM e GROUP BY ALL) SELECT doc_id, string_agg(f, ',' ORDER BY i) AS gold FROM m GROUP BY doc_id")
def gold_from_patch(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(T.gold_files(F.expr(PATCH_SPARK)), ",").alias("gold"))


@query("WITH d AS (SELECT doc_id, 'pkg.' || source || '.mod_' || doc_id AS m, source || '/a.b/mod_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.tar.gz' WHEN doc_id % 3 = 1 THEN '' ELSE '.py' END AS p FROM documents) SELECT doc_id, string_split(m, '.')[-1] AS tail, CASE doc_id % 3 WHEN 0 THEN 'mod_' || doc_id || '.tar' ELSE 'mod_' || doc_id END AS stem, replace(p, '/', '__') AS folder, upper(source) ~ '^[A-Z][A-Z0-9_]*$' AS is_constant FROM d JOIN documents USING (doc_id)")
def path_functions(spark, sf):
    d = V.table(spark, sf, "documents")
    ext = F.when(F.col("doc_id") % 3 == 0, ".tar.gz").when(F.col("doc_id") % 3 == 1, "").otherwise(".py")
    path = F.concat("source", F.lit("/a.b/mod_"), F.col("doc_id").cast("string"), ext)
    module = F.concat(F.lit("pkg."), "source", F.lit(".mod_"), F.col("doc_id").cast("string"))
    return d.select("doc_id", T.module_tail(module).alias("tail"), T.path_stem(path).alias("stem"), T.repo_folder(path).alias("folder"), T.is_constant_name(F.upper("source")).alias("is_constant"))


@query("WITH g AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '-*•0123456789. \t`''\"')), lambda x: x <> '') AS ls FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: trim(regexp_split_to_array(x, '\\s+')[1], '`''\".,()[]:')), lambda t: regexp_matches(t, '^[A-Za-z_][A-Za-z0-9_.]*$')) AS ws FROM g), e AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w), k AS (SELECT doc_id, w, min(i) AS i FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM k) SELECT d.doc_id, coalesce(string_agg(w, ',' ORDER BY i), '') AS idents FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND n <= 15 WHERE d.text IS NOT NULL GROUP BY d.doc_id")
def parse_generated(spark, sf):
    return V.table(spark, sf, "documents").filter("text is not null").select("doc_id", F.array_join(T.generated_identifiers(F.col("text")), ",").alias("idents"))


@query("SELECT source, count(*) AS files, sum(greatest(1, CAST(ceil(n_chars / 1500) AS BIGINT))) AS chunks, sum(n_chars + 30 * greatest(1, CAST(ceil(n_chars / 1500) AS BIGINT))) AS billed, round(sum((n_chars + 30 * greatest(1, CAST(ceil(n_chars / 1500) AS BIGINT))) * 0.18 / 1e6), 6) AS dollars FROM documents GROUP BY source")
def token_cost(spark, sf):
    chunks, billed, dollars = T.embedding_cost(F.col("n_chars"))
    return V.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(chunks).alias("chunks"), F.sum(billed).alias("billed"), F.round(F.sum(dollars), 6).alias("dollars"))


#: Bytes of item texts that are broadcast at once.
BLOCK_BYTES = 8 << 20


def item_blocks(items: DataFrame, text: str, most: int = BLOCK_BYTES) -> list[DataFrame]:
    """All items, dealt by hash into as many blocks as their counted bytes need; more items mean more blocks."""
    n = -(-(items.agg(F.sum(F.octet_length(text))).first()[0] or 1) // most)
    return [items.filter(F.pmod(F.xxhash64(*items.columns), F.lit(n)) == i) for i in range(n)]


@query("SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def contains_gold(spark, sf):
    """Documents that contain the text of an item, for all items."""
    items = V.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("t"))
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    found = (docs.join(F.broadcast(block), F.contains("text", "t")).select("item_id", "doc_id") for block in item_blocks(items, "t"))
    return reduce(DataFrame.union, found).distinct()


#: Queries that a task holds a shortlist of at once, and shortlisted pairs that are broadcast at most.
BLOCK_QUERIES, BROADCAST_PAIRS = 1000, 500_000


def nearest_lengths(files: DataFrame, queries: DataFrame, k: int, block: int = BLOCK_QUERIES) -> tuple[DataFrame, int]:
    """(query_id, file_id, n_chars): for all queries the best k files of each task by rounded closeness in length, ties by file_id; and the count of queries.

    Files are read once for each block of queries. A score is 1 / m for an integer m, so its 6 places are exact in integers.
    """
    ids, parts = [r[0] for r in queries.filter("query_id is not null").toLocalIterator()], []
    for at in range(0, len(ids), block):
        parts.append(files.mapInArrow(_nearest(ids[at : at + block], k), "query_id long, file_id string, n_chars long"))
    return (reduce(DataFrame.union, parts) if parts else files.select(F.lit(0).cast("long").alias("query_id"), "file_id", "n_chars").limit(0)), len(ids)


def _nearest(ids: list[int], k: int):
    def run(batches):
        held = {q: [] for q in ids}
        for batch in batches:
            rows = sorted(zip(batch.column("file_id").to_pylist(), batch.column("n_chars").to_pylist()), key=lambda r: (r[0] is not None, (r[0] or "").encode()))
            n = np.array([0 if r[1] is None else r[1] for r in rows], np.int64)
            known = np.array([r[1] is not None for r in rows], bool)
            for q in ids:
                m = 1 + np.abs(n - 1000 - 10 * q)
                score = np.where(known, (2_000_000 + m) // (2 * m), -1)
                best = [(-int(score[i]), rows[i][0] is not None, (rows[i][0] or "").encode(), rows[i]) for i in np.argsort(-score, kind="stable")[:k]]
                held[q] = sorted(held[q] + best, key=lambda x: x[:3])[:k]
        out = [(q, *x[3]) for q in ids for x in held[q]]
        columns = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()))], ["query_id", "file_id", "n_chars"])

    return run


JAC = "len(list_intersect(a.w, b.w)) / greatest(len(list_distinct(list_concat(a.w, b.w))), 1)"
RERANK = f"""
WITH b AS (SELECT item_id AS query_id, text, list_distinct({WORDS}) AS w FROM benchmark), d AS (SELECT doc_id, substr(text, 1, 6000) AS text, n_chars FROM documents),
dw AS (SELECT doc_id, n_chars, list_distinct({WORDS}) AS w FROM d),
s AS (SELECT a.query_id, CAST(b.doc_id AS VARCHAR) AS file_id, round(1.0 / (1 + abs(b.n_chars - 1000 - 10 * a.query_id)), 6) AS s1, round({JAC}, 6) AS s2 FROM b a CROSS JOIN dw b),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, file_id) AS old_rk FROM s QUALIFY old_rk <= 100)
SELECT query_id, file_id, s2 AS score, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, old_rk, file_id) AS rk FROM o QUALIFY rk <= 20
"""


@query(RERANK)
def rerank_shortlist(spark, sf):
    """For all items a shortlist of 100 of all documents by closeness in length, reranked by shared words of the first 6000 characters."""
    q = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q_text"))
    d = V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_id"), "n_chars", T.truncated(F.col("text"), 6000).alias("d_text"))
    near, n = nearest_lengths(d.select("file_id", "n_chars"), q.select("query_id").distinct(), 100)
    short = ranking.ranked(near.select("query_id", "file_id", (1.0 / (1 + F.abs(F.col("n_chars") - 1000 - 10 * F.col("query_id")))).alias("score")), 100)
    ids = short.select("query_id", "file_id")
    pairs = d.select("file_id", "d_text").join(F.broadcast(ids) if n * 100 <= BROADCAST_PAIRS else ids, "file_id").join(q, "query_id")
    return ranking.reranked(short, pairs.select("query_id", "file_id", plugins.jaccard(F.col("q_text"), F.col("d_text")).alias("score")))


@query("SELECT source, arg_min(lang, doc_id) AS base_commit FROM documents GROUP BY source")
def first_commit(spark, sf):
    rows = V.table(spark, sf, "documents").select(F.col("source").alias("repo"), F.col("lang").alias("base_commit"), "doc_id")
    return corpus.first_commit(rows, "doc_id").select(F.col("repo").alias("source"), "base_commit")


@query("SELECT source, count(DISTINCT lang) AS n_scopes, count(*) AS n FROM documents GROUP BY source")
def scope_counts(spark, sf):
    return V.table(spark, sf, "documents").groupBy("source").agg(F.count_distinct("lang").alias("n_scopes"), F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def category_counts(spark, sf):
    return V.table(spark, sf, "documents").groupBy("lang").count().withColumnRenamed("count", "n")


@query("SELECT arg_min(source, (n, source)) AS smallest FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def smallest_group(spark, sf):
    n = V.table(spark, sf, "documents").groupBy("source").count()
    return n.agg(F.min_by("source", F.struct("count", "source")).alias("smallest"))


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id LIMIT 80")
def seeded_sample(spark, sf):
    return evaluate.seeded_sample(V.table(spark, sf, "documents").select("doc_id"), "doc_id", 80)


@query("SELECT 'train' AS _split, count(*) AS n FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'test', count(*) FROM documents WHERE doc_id % 2 = 1")
def tag_splits(spark, sf):
    d = V.table(spark, sf, "documents")
    both = corpus.tag_splits({"train": d.filter("doc_id % 2 = 0"), "test": d.filter("doc_id % 2 = 1").drop("n_chars")})
    return both.groupBy("_split").agg(F.count("*").alias("n"))


@query("SELECT kind, count(*) AS n, count(DISTINCT name) AS names, CAST(sum(end_byte - start_byte) AS BIGINT) AS bytes FROM (SELECT 'function' AS kind, 'f_' || doc_id AS name, 0 AS start_byte, length('@dec' || chr(10) || 'def f_' || doc_id || '(): pass') AS end_byte FROM documents UNION ALL SELECT 'class', 'C', 0, 0 FROM documents WHERE false UNION ALL SELECT 'import', 'a.' || source, 0, length('import a.' || source) FROM documents) GROUP BY kind")
def python_symbols(spark, sf):
    """Symbols of a small source built from each document."""
    d = V.table(spark, sf, "documents")
    source = F.concat(F.lit("@dec\ndef f_"), F.col("doc_id").cast("string"), F.lit("(): pass\nimport a."), "source", F.lit("\n"))
    files_ = d.select(source.alias("content"))
    found = files_.lateralJoin(SymbolTable(F.col("content").outer()))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.sum(F.col("end_byte") - F.col("start_byte")).cast("long").alias("bytes"))


QUERIES = {**QUERIES}
assert not set(QUERIES) & set(_Q) and not set(ORACLES) & set(_O)
