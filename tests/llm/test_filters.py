"""Quality rules, license scan, line dedup and decontamination: SQL on the small tables, literals at the edges."""

import random
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, licenses, linededup, quality, queries

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark".split()


def same(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = c.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    text = lambda rows: sorted(tuple(str(r[k]) for k in cols) for r in rows)
    assert text([r.asDict() for r in got.collect()]) == text([dict(zip(want.columns, r)) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, name)


def brute_stats(text):
    words = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(hit)


def test_quality_edges(spark, corpus, nothing):
    rows = quality.score_quality(corpus.filter("doc_id is null or doc_id <> 7")).collect()
    for r in rows:
        s = r["quality_stats"]
        assert (s["n_words"], s["word_chars"], s["n_repeat_words"]) == brute_stats(r["text"])
        assert r["w"] == "own" and r["line"] == 1
    kept = quality.keep_good(corpus)
    assert kept.columns == corpus.columns and kept.count() == 0 and quality.keep_good(nothing).count() == 0
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    for r in quality.score_quality(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        assert r["quality_stats"]["n_repeat_words"] == brute_stats(r["text"])[2]


def test_licenses(spark, corpus, nothing):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 500)
    docs = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(", ", " ,\n")), (2, "x\nreleased under the mit licence!\ny"), (3, None), (4, ""), (5, "Released under the MIT License. And more"), (2, "All rights reserved")]
    rows = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["n_hits"], *r["licenses"]) for r in rows if r["doc_id"] == 2) == [(1, "MIT"), (2, "LicenseRef-all-rights-reserved")]
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["whole_license"] == "MIT" and got[1]["licenses"] == ["MIT"]
    assert all(got[k]["n_hits"] == 0 and got[k]["whole_license"] is None for k in (3, 4, 5))
    assert licenses.scan_licenses(corpus).count() == corpus.count() and licenses.scan_licenses(nothing).count() == 0
    twice = spark.createDataFrame([(1, mit), (1, mit)], "doc_id long, text string")
    assert [r["n_hits"] for r in licenses.scan_licenses(twice).collect()] == [2, 2]


def test_licenses_wrapped_anywhere(spark):
    """Known texts in lines of any width, under a copyright line, with curly quotes."""
    docs = [(i, f"Copyright (c) 2021 Someone\n\u00a9 2020 Others\n(C) 2019 by X\nCopyright by Y\n\n{textwrap.fill(t, w, break_long_words=False)}".replace(' "', " \u201c").replace('" ', "\u201d ")) for i, (_, t) in enumerate(licenses.KNOWN) for w in (30, 60, 72, 80)]
    for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert r["whole_license"] == licenses.KNOWN[r["doc_id"]][0], r
    clause = "(c) You must retain\ncopyright notice and\nCopyright holders"
    assert spark.createDataFrame([(clause,)], "t string").select(licenses.canonical(F.col("t"))).first()[0] == "c you must retain copyright notice and copyright holders"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_lines(docs, near):
    lines = [(d, i, tuple(x.split())) for d, t in docs for i, x in enumerate((t or "").split("\n")) if x.split()]
    lines.sort(key=lambda x: x[:2])
    gone = set()
    for k, (d, i, w) in enumerate(lines):
        if any(w == v or (max(len(w), len(v)) >= near and one_edit(w, v)) for *_, v in lines[:k]):
            gone.add((d, i))
    return gone


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))] for _ in range(12)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = [rng.choice("abcxyz")] * rng.randint(0, 1)
                w = w or ["a"]
            lines.append(rng.choice([" ", "  "]).join(w))
        docs.append((d, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    from quern.llm.common import Workspace

    for near in (4, 8):
        got = {(r["doc"], r["line"]) for r in linededup.duplicate_lines(df, Workspace(spark, "t"), near_words=near).collect()}
        assert got == brute_lines(docs, near)


def test_line_edges(spark, corpus, nothing):
    out = linededup.dedup_lines(corpus)
    assert out.columns == [*corpus.columns, "n_lines", "n_removed"] and out.count() == corpus.count()
    rows = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()]
    assert (1, None, 0, 0) in rows and (2, "", 0, 0) in rows and rows.count((6, "", 1, 1)) == 2
    assert (5, "Ünïcode wörds ß and  double  blanks\nnew line\n\nend ", 3, 0) in rows
    assert linededup.dedup_lines(nothing).count() == 0
    clash = corpus.selectExpr("doc_id", "text", "1 AS doc", "2 AS dh", "3 AS entries", "4 AS n_lines", "5 AS n_removed", "6 AS raw", "7 AS at")
    same = linededup.dedup_lines(clash)
    assert same.columns == ["doc_id", "text", "doc", "dh", "entries", "raw", "at", "n_lines", "n_removed"]
    assert sorted(str(r) for r in same.select("doc_id", "text", "n_lines", "n_removed").collect()) == sorted(str(r) for r in out.select("doc_id", "text", "n_lines", "n_removed").collect())
    assert same.filter("doc = 1 and dh = 2 and entries = 3 and raw = 6 and at = 7").count() == corpus.count()


def brute_hits(text, items, n=8):
    words = lambda t: "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in "".join(x.lower() if x.isascii() else x for x in t or "")).split(" ")
    w = [x for x in words(text) if x]
    hit, found = set(), set()
    for i, t in items:
        v = [x for x in words(t) if x]
        k = min(n, len(v))
        for a in range(len(v) - k + 1 if v else 0):
            for b in range(len(w) - k + 1):
                if w[b : b + k] == v[a : a + k]:
                    hit |= {*range(b, b + k)}
                    found.add(str(i))
    return len(w), sorted(hit), sorted(found)


@pytest.mark.parametrize("most", [500_000, 3])
def test_hits_equal_brute_force(spark, most):
    rng = random.Random(3)
    word = lambda: rng.choice(["Ab", "c-d", "é", "1", "z", "Q"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 8, 12])))) for i in range(12)] + [(99, None)]
    docs = [(d, " ".join(word() for _ in range(rng.randint(0, 30))) + rng.choice(["", " " + items[rng.randrange(12)][1].upper()])) for d in range(80)] + [(100, None), (101, "")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.scan_hits(df, bench, n=4, max_windows=most).collect():
        assert (r["n_words"], r["hit_words"], r["hit_items"]) == brute_hits(r["text"], items, 4)


def test_removed_spans(spark, corpus, nothing):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, "word " * 9), (3, "word " * 8)], "item_id long, text string")
    out = decontaminate.remove_hits(corpus, bench)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == corpus.columns and 7 not in rows
    assert rows[0]["text"] == "The  and runs away" and rows[0]["n_chars"] == 18 and rows[1]["text"] is None
    assert rows[5]["text"].startswith("Ünïcode") and decontaminate.remove_hits(nothing, bench).count() == 0
    own = decontaminate.remove_hits(corpus.selectExpr("*", "7 AS n_words", "'a' AS hit_items"), bench)
    assert own.columns == [*corpus.columns, "n_words", "hit_items"] and own.filter("n_words = 7 and hit_items = 'a'").count() == own.count() == out.count()
    unnamed = spark.createDataFrame([(None, "quick brown fox jumps over the lazy dog")], "item_id long, text string")
    hit = {r["doc_id"]: r for r in decontaminate.scan_hits(corpus, unnamed).collect()}
    assert len(hit[0]["hit_words"]) == 8 and hit[0]["hit_items"] == []
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan_hits(corpus, empty).filter(F.size("hit_items") > 0).count() == 0


