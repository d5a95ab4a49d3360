"""Near-duplicate lines of the whole corpus by a deletion-neighbourhood join; the earliest line stays.

The unit of editing is a word. Lines of ``near_words`` words or more are near-duplicates if one can be turned into the
other by at most one word edit (substitution, insertion or deletion); shorter lines only if equal. Lines compare by
their words, unchanged; white space doesn't matter. A line is removed if an earlier one (by document id,
then line number) is equal or near it. Lines without a word always stay.

Plan, all built-in functions:
1. Lines become (text hash, first position) by a partial aggregate: a line in a third of all documents is one row.
2. A line can only have a partner at one edit if it shares its first or last half (or that of the shorter partner).
   Half keys are counted; lines whose half keys are all their own leave the join here, exactly and before variants.
3. The rest emit their deletion neighbourhood as hashed keys, in the half that the shared key leaves open: the words
   without word i, with i, meet lines with another word at i; without i, they meet the line that is one word shorter.
4. Equal variants are joined by their earliest position, not pair by pair: all lines with one key and i are one
   substitution apart, and a line's variants are one insertion from it. So a template line with thousands of fillings
   costs one row each.
5. The partner's words are fetched and the edit distance verified.

Defined results: null texts stay null and have no lines; an empty text keeps its one empty line. Rows that repeat id and
text are one document at one position, so neither loses lines to the other; a null id sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_KEYS, SPACES, Workspace, let

#: Words from which a line may match at one edit.
NEAR_WORDS = 8


def within_one_edit(x: Column, y: Column) -> Column:
    """Is the word edit distance of two word arrays at most 1?"""
    nx, ny = F.size(x), F.size(y)

    def longer(a: Column, b: Column) -> Column:  # a has one word more than b
        differs = F.array_position(F.zip_with(F.slice(a, F.lit(1), F.size(b)), b, lambda p, q: p != q), True).cast("int")
        head = F.when(differs == 0, F.size(b)).otherwise(differs - 1)
        return let(head, lambda h: F.slice(a, h + 2, F.size(a)) == F.slice(b, h + 1, F.size(b)))

    differ = F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda e: e))
    return F.when(nx == ny, differ <= 1).when(nx == ny + 1, longer(x, y)).when(ny == nx + 1, longer(y, x)).otherwise(False)


#: (document, hash of its text, line): where a line stands.
PLACE = ["doc", "dh", "line"]


def _plain(line: Column) -> Column:
    """A line's words, joined by one blank."""
    odd = line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\x0b") | line.contains("\x0c")
    return F.trim(F.when(odd, F.regexp_replace(line, "[ \\t-\\r]+", " ")).otherwise(line))


def _lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc, dh, line, s): lines that have a word, s the words joined by one blank."""
    x = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(x).alias("dh"), F.posexplode(F.split(x, "\n")).alias("line", "raw"))
    return rows.select(*PLACE, _plain(F.col("raw")).alias("s")).filter("s <> ''")


def _part(s: Column, k: Column) -> Column:
    """The first k words, or the last -k."""
    return F.call_function("substring_index", s, F.lit(" "), k)


def _n_words(s: Column) -> Column:
    return F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit(""))) + 1


def _halves(s: Column, n: Column) -> list[Column]:
    """Hashes of which near lines share one: first and last half for its own length, then for one word fewer."""
    out = []
    for length in (n, n - 1):
        m = F.floor(length / 2).cast("int")
        out += [F.xxhash64(length, F.lit("first"), _part(s, m)), F.xxhash64(length, F.lit("last"), _part(s, m - length))]
    return out


def _variants(s: Column, n: Column, shared: Column, near_words: int) -> Column:
    """(i, v, whole): the line itself and its variants at the positions that its shared half keys leave open."""

    def without(i: Column) -> Column:
        head, tail = _part(s, i), _part(s, i + 1 - n)
        return F.when(i == 0, tail).when(i == n - 1, head).otherwise(F.concat(head, F.lit(" "), tail))

    one = lambda i, v, whole: F.struct(i.cast("int").alias("i"), v.alias("v"), F.lit(whole).alias("whole"))
    open_at = lambda m, k: lambda i: ((i >= m) & F.array_contains(shared, k)) | ((i < m) & F.array_contains(shared, k + 1))
    at = F.sequence(F.lit(0), n - 1)
    same = F.transform(F.filter(at, open_at(F.floor(n / 2), 0)), lambda i: one(i, F.xxhash64(without(i), i), False))
    fewer = F.transform(F.filter(at, open_at(F.floor((n - 1) / 2), 2)), lambda i: one(F.lit(-1), F.xxhash64(without(i)), False))
    whole = F.array(one(F.lit(-1), F.xxhash64(s), True))
    return F.when(n < near_words, whole).otherwise(F.concat(whole, same, fewer))


def _listed(rows: DataFrame, work: Workspace, name: str, *values: Column) -> DataFrame:
    """A list per document of (line, values); broadcast where a count of documents and entries allows it."""
    lists = work.save(rows.groupBy("doc", "dh").agg(F.collect_list(F.struct("line", *values)).alias("entries")), name)
    n, entries = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("entries")), F.lit(0))).first()
    return F.broadcast(lists) if n <= BROADCAST_KEYS and entries <= 4 * BROADCAST_KEYS else lists


def duplicate_lines(docs: DataFrame, work: Workspace, text: str = "text", key: str = "doc_id", near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc, dh, line) of each line to remove: doc is the document's id, dh the xxhash64 of its text, line from 0."""
    s, n = F.col("s"), F.col("n")
    lines = _lines(docs, text, key).withColumn("n", _n_words(s))
    h = [F.xxhash64("s").alias("h"), F.xxhash64(F.lit("second"), "s").alias("h2")]
    places = work.save(lines.select(*PLACE, *h, "n", *(F.when(n >= near_words - 1, k).alias(f"k{j}") for j, k in enumerate(_halves(s, n)))), "places")
    first = places.groupBy("h", "h2").agg(F.min(F.struct(*PLACE)).alias("at"), F.count("*").alias("copies"), *(F.first(f"k{j}").alias(f"k{j}") for j in range(4)))
    first = work.save(first, "first")

    # Lines that share a half key with another line; a text is one row here.
    halves = first.filter("k0 is not null").select("h", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("j", "half"))
    twice = halves.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1").select("half")
    shared = halves.join(twice, "half", "left_semi").groupBy("h").agg(F.collect_set("j").alias("shared"))
    some = _listed(first.join(shared, "h").select("at.*", "shared"), work, "candidates", F.col("shared"))

    # Their words, and the deletion neighbourhoods.
    x = F.col("d.text")
    met = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).alias("d").join(some, F.col("d.key").eqNullSafe(F.col("doc")) & (F.xxhash64(x) == F.col("dh")))
    met = met.select("doc", "dh", F.inline(let(F.split(x, "\n"), lambda r: F.transform("entries", lambda e: F.struct(e["line"].alias("line"), e["shared"].alias("shared"), F.get(r, e["line"]).alias("raw"))))))
    candidates = work.save(met.select(*PLACE, "shared", _plain(F.col("raw")).alias("s")), "words")
    variants = candidates.withColumn("n", _n_words(s)).select(F.struct(*PLACE).alias("at"), F.inline(_variants(s, n, F.col("shared"), near_words)))
    variants = work.save(variants, "variants")
    ends = variants.groupBy("i", "v").agg(F.min(F.when(F.col("whole"), F.col("at"))).alias("whole_at"), F.min(F.when(~F.col("whole"), F.col("at"))).alias("part_at"), F.count("*").alias("c")).filter("c > 1")
    partner = F.when((F.col("i") < 0) & ~F.col("whole"), F.col("whole_at")).otherwise(F.col("part_at"))
    pairs = variants.join(ends, ["i", "v"]).select("at", partner.alias("by")).filter("by < at").distinct()

    # Verify with the words of both.
    side = lambda name: candidates.select(F.struct(*PLACE).alias(name), F.col("s").alias(f"{name}_s"))
    within = let(F.split("at_s", " "), lambda p: let(F.split("by_s", " "), lambda q: within_one_edit(p, q)))
    near = pairs.join(side("at"), "at").join(side("by"), "by").filter(within).select("at").distinct()
    near = work.save(near.withColumn("near", F.lit(True)), "near")

    gone = first.join(near, "at", "left").filter("copies > 1 or near").select("h", "h2", "at", F.coalesce("near", F.lit(False)).alias("near"))
    all_copies = places.select(*PLACE, "h", "h2").join(gone, ["h", "h2"]).filter(F.col("near") | (F.struct(*PLACE) != F.col("at")))
    return all_copies.select(*PLACE).distinct()


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", near_words: int = NEAR_WORDS, work: Workspace | None = None) -> DataFrame:
    """docs with text without the removed lines, and n_lines (with a word) and n_removed as last columns.

    Columns of these two names are replaced; n_chars, if there is such a column, is left to the caller.
    """
    work = work or Workspace(docs.sparkSession, "linededup")
    lists = _listed(duplicate_lines(docs, work, text, key, near_words), work, "removed")
    x = F.col(f"d.`{text}`")
    joined = docs.alias("d").join(lists.alias("r"), F.col(f"d.`{key}`").eqNullSafe(F.col("r.doc")) & (F.xxhash64(x) == F.col("r.dh")), "left")
    raw = F.split(x, "\n")
    stay = let(raw, lambda r: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(r) - 1), F.col("r.entries.line")), lambda i: F.get(r, i)), "\n"))
    n_lines = F.size(F.filter(raw, lambda r: F.trim(r, F.lit(SPACES)) != ""))
    return joined.select(
        *(F.when(F.col("r.entries").isNull(), x).otherwise(stay).alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")),
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("r.entries"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same by self-joins on half lines and a literal edit test; documents ids are distinct in the tables that it runs on.
SQL = f"""
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, line, raw, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS w FROM d),
f AS (SELECT w, len(w) AS n, min((doc_id, line)) AS pos FROM l WHERE len(w) > 0 GROUP BY w),
h AS (SELECT w, n, pos, unnest([(n, 'first', w[1 : n // 2]), (n, 'last', w[n // 2 + 1 : n]),
                               (n - 1, 'first', w[1 : (n - 1) // 2]), (n - 1, 'last', w[(n - 1) // 2 + 2 : n])]) AS half FROM f WHERE n >= {NEAR_WORDS - 1}),
p AS (SELECT DISTINCT a.w AS w, a.pos AS pos, b.w AS y FROM h a JOIN h b ON a.half = b.half AND b.pos < a.pos AND abs(a.n - b.n) <= 1),
near AS (SELECT DISTINCT w FROM p WHERE least(len(w), len(y)) >= {NEAR_WORDS - 1} AND greatest(len(w), len(y)) >= {NEAR_WORDS} AND (
  (len(w) = len(y) AND len(list_filter(range(1, len(w) + 1), lambda i: w[i] <> y[i])) <= 1) OR
  (len(w) = len(y) + 1 AND len(list_filter(range(1, len(w) + 1), lambda i: list_concat(w[1 : i - 1], w[i + 1 : len(w)]) = y)) > 0) OR
  (len(y) = len(w) + 1 AND len(list_filter(range(1, len(y) + 1), lambda i: list_concat(y[1 : i - 1], y[i + 1 : len(y)]) = w)) > 0))),
m AS (SELECT l.doc_id, l.line, l.raw, len(l.w) > 0 AS word, coalesce(len(l.w) > 0 AND ((l.doc_id, l.line) <> f.pos OR near.w IS NOT NULL), false) AS gone
      FROM l LEFT JOIN f ON f.w = l.w LEFT JOIN near ON near.w = l.w),
s AS (SELECT doc_id, count(*) FILTER (WHERE word) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id
"""
