"""Benchmark decontamination: a broadcast hash set of benchmark word n-grams, scanned over all training text.

Words are runs of digits, letters and characters beyond ASCII after A-Z are lower-cased. A window is n consecutive
words of an item; an item of fewer words is one window. The set holds window hashes and, to verify each hit, the words.
A document word inside any occurrence of a window is hit.

The set is built on the driver, row by row, and bounded: benchmark items are taken in blocks of at most ``max_windows`` windows; each block is one broadcast
and one more pass over the documents, which carry their hits along. So any size of benchmark gives whole results.

Defined results: null, empty and wordless texts have no words and no hits; wordless items have no window. Repeated
items each count; the windows of an item without an id are hit, but it isn't among the items. Repeated documents get
equal results. Other columns of docs stay; ``scan_hits`` replaces those of the names that it adds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Workspace
from quern.llm.words import ALNUM, blocks, scan

#: Words of a window, and windows of one broadcast (about 100 MB at most).
WINDOW, MAX_WINDOWS = 8, 500_000


class NgramSet:
    """Windows of some items: sorted hashes by length, and the items of each window's words."""

    def __init__(self, n: int):
        self.n, self.size = n, 0
        self.items: dict[bytes, list[str]] = defaultdict(list)
        self.found: dict[int, set[int]] = defaultdict(set)
        self.hashes: dict[int, np.ndarray] = {}

    def add(self, item_id: str | None, text: str | None) -> None:
        w = scan(pa.array([text], pa.string()), ALNUM, lower=True)
        if not len(w.start):
            return
        k = min(self.n, len(w.start))
        h, _ = w.grams(w.hashes(), k)
        for i, x in enumerate(h.tolist()):
            words = w.text(i, i + k)
            items = self.items[words]
            if item_id is not None and (not items or items[-1] != item_id):
                items.append(item_id)
            self.found[k].add(x)
            self.size += 1

    def close(self) -> NgramSet:
        self.hashes = {k: np.array(sorted(v), np.uint64) for k, v in self.found.items()}
        self.items, self.found = dict(self.items), defaultdict(set)
        return self


def ngram_sets(benchmark: DataFrame, n: int, max_windows: int, key: str, text: str) -> Iterator[NgramSet]:
    one = NgramSet(n)
    for r in benchmark.select(F.col(key).cast("string"), F.col(text)).toLocalIterator():
        one.add(r[0], r[1])
        if one.size >= max_windows:
            yield one.close()
            one = NgramSet(n)
    yield one.close()


#: Columns that a scan adds.
ADDED = ("n_words", "hit_words", "hit_items", "cut_text")


def scan_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, key: str = "item_id", text: str = "text", max_windows: int = MAX_WINDOWS, cut: bool = False) -> DataFrame:
    """docs with n_words, hit_words (positions of hit words, ascending) and hit_items (ids of items with a window there, sorted strings).

    cut: also cut_text, the text without its hit spans, each from its first word to its last.
    """
    spark = docs.sparkSession
    kept = [f for f in docs.schema.fields if f.name not in ADDED]
    names = [f.name for f in kept]
    out, sets = docs.select(*(F.col(f"`{c}`") for c in names)), ngram_sets(benchmark, n, max_windows, key, "text")
    block = next(sets)
    while block:
        after = next(sets, None)
        last = cut and after is None
        schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())), T.StructField("hit_items", T.ArrayType(T.StringType())), *([T.StructField("cut_text", T.StringType())] if last else [])])
        out = out.mapInArrow(_scanner(spark.sparkContext.broadcast(block), text, names, last), schema)
        block = after
    return out


def _scanner(shared, text: str, names: list[str], cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: NgramSet = shared.value
        for batch in blocks(batches, text):
            rows = batch.num_rows
            w = scan(batch.column(text), ALNUM, lower=True)
            h, hit, items = w.hashes(), np.zeros(len(w.start) + 1, np.int64), [set() for _ in range(rows)]
            for k, known in grams.hashes.items():
                g, same = w.grams(h, k)
                at = np.searchsorted(known, g)
                at[at == len(known)] = 0
                for i in np.flatnonzero((known[at] == g) & same).tolist():
                    found = grams.items.get(w.text(i, i + k))
                    if found is not None:
                        hit[i] += 1
                        hit[i + k] -= 1
                        items[w.row[i]].update(found)
            where = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
            row = w.row[where]
            place = where - w.first[row]
            if "hit_words" in batch.schema.names:  # of earlier blocks
                old = batch.column("hit_words").to_pylist()
                place = [sorted({*a, *place[row == r].tolist()}) for r, a in enumerate(old)]
                words = pa.array(place, pa.list_(pa.int32()))
                items = [x | set(a) for x, a in zip(items, batch.column("hit_items").to_pylist())]
            else:
                words = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(place, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(np.diff(w.first), pa.int64()), words, pa.array([sorted(x) for x in items], pa.list_(pa.string())), *([_cut(batch.column(text), words)] if cut else [])],
                [*names, "n_words", "hit_words", "hit_items", *(["cut_text"] if cut else [])],
            )

    return run


def _cut(column: pa.Array, words: pa.Array) -> pa.Array:
    """Texts without the spans of consecutive hit words."""
    texts = column.to_pylist()
    for r, hits in enumerate(words.to_pylist()):
        if not hits:
            continue
        w, raw, kept, last = scan(pa.array([texts[r]]), ALNUM, lower=True), texts[r].encode(), [], 0
        for span in np.split(np.array(hits), np.flatnonzero(np.diff(hits) > 1) + 1):
            kept.append(raw[last : w.start[span[0]]])
            last = w.end[span[-1]]
        texts[r] = b"".join([*kept, raw[last:]]).decode()
    return pa.array(texts, pa.string())


def remove_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", drop_items: int = 2, **options) -> DataFrame:
    """docs without those that hold windows of drop_items items or more; other hit spans are cut out of the text.

    n_chars, if it is there, follows the text.
    """
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c in ADDED}  # stay as they are
    found = scan_hits(docs.withColumnsRenamed(own), benchmark, text=text, cut=True, **options).filter(F.size("hit_items") < drop_items)
    new = {c: F.col(o).alias(c) for c, o in own.items()} | {text: F.col("cut_text").alias(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("hit_words") > 0, F.char_length("cut_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.select(*(new.get(c, F.col(f"`{c}`")) for c in docs.columns))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = scan_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_items = F.size("hit_items").cast("long")
    return hits.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 8) AS k, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS x
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
q AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS x FROM p CROSS JOIN (SELECT DISTINCT k FROM g) WHERE i + k - 1 <= len(w)),
h AS (SELECT doc_id, i, g.k, item FROM q JOIN g ON g.x = q.x AND g.k = q.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
