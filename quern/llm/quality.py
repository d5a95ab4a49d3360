"""Quality rules: a threshold table compiled into one projection of built-in functions.

``score_quality`` adds the statistics and ``compile_rules`` turns the table into one boolean Column, so that a scan,
two projections and no shuffle judge a document.

Defined results: null or empty text has no words, all counts are 0 and length fails. Equal rows are judged alike.
Columns of the input stay; statistics go into one struct column whose name the caller may choose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import let, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for with this are was "
    "de la le les des et en un une est que pour dans "
    "der die das und ist den von zu mit nicht ein eine "
    "el los las y del se por con una su para no"
).split()
#: (statistic, factor, relation, threshold, of what): factor * statistic relation threshold * what.
RULES: list[tuple[str, int, str, int, str]] = [
    ("n_words", 1, ">=", 50, "one"),
    ("n_repeat_words", 100, "<=", 50, "n_words"),
    ("n_symbols", 100, "<=", 30, "n_words"),
    ("word_chars", 1, ">=", 2, "n_words"),
    ("word_chars", 1, "<=", 15, "n_words"),
    ("n_stop_words", 100, ">=", 1, "n_words"),
    ("n_dup_lines", 100, "<=", 50, "n_lines"),
]
#: The first rules are those of base_failed.
BASE_RULES = RULES[:2]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text."""

    def covered(marked: Column) -> Column:  # marked: (hash, position), sorted
        twice = F.filter(marked, lambda x, j: (F.get(marked, j - 1)["h"] == x["h"]) | (F.get(marked, j + 1)["h"] == x["h"]))
        at = lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        steps = let(F.sort_array(F.transform(twice, lambda x: x["i"])), at)
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def windows(h: Column) -> Column:
        marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(marked, covered))

    hashes = F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, windows)).cast("long")


def statistics(text: Column) -> Column:
    """A struct of all statistics of a text."""
    text = F.coalesce(text, F.lit(""))
    plain = F.translate(text, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")

    def of(words: Column) -> Column:
        stop = F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))
        return F.struct(
            F.lit(1).cast("long").alias("one"),
            F.size(words).cast("long").alias("n_words"),
            F.char_length(plain).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(stop).cast("long").alias("n_stop_words"),
        )

    return let(words_of(text), of)


def compile_rules(stats: str, rules=None) -> Column:
    """One Column: does every rule hold for the struct column stats?"""
    verdict = F.lit(True)
    for name, factor, relation, threshold, what in RULES if rules is None else rules:
        left, right = F.col(f"{stats}.{name}") * factor, F.col(f"{stats}.{what}") * threshold
        verdict = verdict & (left >= right if relation == ">=" else left <= right)
    return verdict


def score_quality(docs: DataFrame, text: str = "text", stats: str = "quality_stats") -> DataFrame:
    """docs with the struct of statistics; any column of that name is replaced."""
    return docs.withColumn(stats, statistics(F.col(text)))


def keep_good(docs: DataFrame, text: str = "text", rules=None) -> DataFrame:
    """The documents that pass all rules, with their own columns."""
    stats = "_quality_stats"
    return score_quality(docs, text, stats).filter(compile_rules(stats, rules)).drop(stats)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_quality(docs)
    s = lambda n: F.col(f"quality_stats.{n}").alias(n)
    return scored.select(
        "doc_id", s("n_words"), s("word_chars"), s("n_symbols"), s("n_dup_lines"), s("n_repeat_words"),
        (~compile_rules("quality_stats", BASE_RULES)).alias("base_failed"),
        compile_rules("quality_stats").alias("kept"),
    )


_RULE_SQL = " AND ".join(f"{n} * {f} {r} {'1' if w == 'one' else w} * {t}" for n, f, r, t, w in RULES)
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop_words
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, ({_RULE_SQL}) AS kept
FROM s
"""
