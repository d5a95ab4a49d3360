"""Near-duplicates, components, substrings, archives and languages against brute force and at the edges."""

import gzip
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import langid, neardup, substrings, warc
from quern.llm.common import Workspace
from quern.llm.components import components
from quern.llm.words import ALNUM, NOT_SPACE, scan


def closure(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500 + i) for i in range(1, 30)]
    want = closure({n for e in links for n in e}, links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long"), Workspace(spark, "t")).collect()}
    assert got == {n: c for n, c in want.items() if n != c}
    assert components(spark.createDataFrame([], "u long, v long"), Workspace(spark, "t")).collect() == []


def shingles(text, n):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_near(docs, n, percent):
    sets = {d: shingles(t, n) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return closure(ids, links), sets


@pytest.mark.parametrize(("n", "seed"), [(2, 3), (5, 4)])
def test_near_duplicates_equal_brute_force(spark, n, seed):
    """Chains and groups around the threshold, where a star alone would lose links."""
    rng = random.Random(seed)
    docs, vocabulary = [], [f"w{i}" for i in range(400)]
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(5, 25)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // (9 if n == 2 else 25)))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(w)))
            if rng.random() < 0.3:
                base = w
    docs += [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "a b"), (1005, "A  b\n")]
    want, sets = brute_near(docs, n, 80)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), n=n).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) for r in got)


def test_near_edges(spark, corpus, nothing):
    got = [(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(corpus, n=2).collect()]
    assert sorted(x for x in got if x[0] in (0, 6)) == [(0, 0), (6, 0), (6, 0)] and (None, None) in got and (1, 1) in got
    kept = neardup.keep_one(corpus)
    assert kept.columns == corpus.columns and sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, 0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert neardup.near_duplicates(nothing).collect() == [] and neardup.keep_one(nothing).collect() == []
    same = spark.createDataFrame([(None, "x y z"), (4, "x y z"), (3, "x y z")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in neardup.near_duplicates(same, n=2).collect()) == [(0, 3), (3, 3), (4, 3)]


def test_near_rows_that_repeat_ids_and_have_none(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, a), (1, a), (2, a + " x"), (3, b), (3, "other words of its own"), (4, b + " y"), (None, a), (None, b), (None, "lone one"), (None, "lone one"), (5, None), (5, None), (3, None), (6, "lone two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, n=2).collect())
    assert got == [(-1, 1, None), (-1, 1, None), (-1, 19, 1), (-1, 19, 3), (1, 19, 1), (1, 19, 1), (2, 20, 1), (3, 0, 3), (3, 4, 3), (3, 19, 3), (4, 20, 3), (5, 0, 5), (5, 0, 5), (6, 1, 6)]
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in neardup.keep_one(df, n=2).collect())
    assert kept == sorted([(1, a), (3, b), (3, "other words of its own"), (-1, "lone one"), (5, ""), (3, ""), (6, "lone two")])


def template(rng, n, size=100, own=5):
    """Texts of one template, each with words of its own at places of its own."""
    base = [f"t{i}" for i in range(size)]
    out = []
    for d in range(n):
        w = list(base)
        for i in rng.sample(range(size), own):
            w[i] = f"own{d}x{i}"
        out.append((d, " ".join(w)))
    return out


@pytest.mark.parametrize("own", [4, 5])
def test_filled_templates_equal_brute_force(spark, own, monkeypatch):
    """Around the threshold: with 4 own words some are linked, with 5 few, though all share buckets."""
    docs = template(random.Random(own), 160, own=own)
    monkeypatch.setattr(neardup, "PAIRED", 4)
    monkeypatch.setattr(neardup, "DENSE", 0)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), n=2).collect()}
    assert got == brute_near(docs, 2, 80)[0]


@pytest.mark.parametrize("most,cells", [(512, 1 << 21), (40, 1 << 10)])
def test_filled_templates_in_matrices_equal_brute_force(spark, most, cells, monkeypatch):
    """A group beyond the bound is narrowed first; its parts, and groups within the bound, are compared as matrices."""
    docs = template(random.Random(9), 240, own=4) + [(1000 + d, t.replace("t", "s")) for d, t in template(random.Random(10), 30, own=4)]
    monkeypatch.setattr(neardup, "DENSE", most)
    monkeypatch.setattr(neardup, "DENSE_CELLS", cells)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), n=2).collect()}
    assert got == brute_near(docs, 2, 80)[0]


def test_matrices_emit_a_row_for_each_member_at_most(spark):
    """Members 0 to 299 are all alike, 300 to 309 differ from all in more than their one common difference."""
    rows = [(7, u, 100, [1, 2, 3]) for u in range(300)] + [(7, u, 10, [1, *range(u * 100, u * 100 + 40)]) for u in range(300, 310)]
    got = neardup._dense(spark.createDataFrame(rows, "g long, u long, size long, d array<long>"), 80).collect()
    assert len(got) == 299 and {r["u"] for r in got} | {r["v"] for r in got} == set(range(300))


def test_filled_templates_are_not_paired_off(spark, monkeypatch):
    """Compared pairs of groups beyond matrices stay under a bound for each document; all pairs would be 19900 and 319600."""
    seen, paired, parted = [], neardup._paired, neardup._paired_parts
    pairs = lambda rows, *by: rows.groupBy(*by).count().selectExpr("coalesce(sum(count * (count - 1) / 2), 0)").first()[0]

    def in_groups(rows, percent):
        seen[-1] += pairs(rows, "g")
        return paired(rows, percent)

    def in_parts(parts, *rest):
        seen[-1] += pairs(parts.filter(parts.n <= neardup.PAIRED), "g", "x")
        return parted(parts, *rest)

    monkeypatch.setattr(neardup, "DENSE", 0)
    monkeypatch.setattr(neardup, "_paired", in_groups)
    monkeypatch.setattr(neardup, "_paired_parts", in_parts)
    for n in (200, 800):
        seen.append(0)
        got = neardup.near_duplicates(spark.createDataFrame(template(random.Random(1), n), "doc_id long, text string"), n=2)
        assert got.filter("doc_id <> component_id").count() <= n // 100
    assert seen[0] <= 20 * 200 and seen[1] <= 20 * 800, seen


def brute_cut(docs, window):
    words = {i: (t or "").split() for i, (_, t) in enumerate(docs)}
    seen = {}
    for i, w in words.items():
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), []).append((i, s))
    gone = {i: set() for i in words}
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i] |= {*range(s, s + window)}
    return [(d, len(words[i]), len(gone[i]), " ".join(x for k, x in enumerate(words[i]) if k not in gone[i])) for i, (d, _) in enumerate(docs)]


def found_cut(docs_df, window, gram, batches=2, **more):
    rows, changed = substrings.dedup_substrings(docs_df, window, gram, batches, **more)
    kept = {(r["a"], r["b"]): r["kept_text"] for r in changed.collect()}
    out = []
    for r in rows.collect():
        text = "" if r["n_removed"] == r["n_words"] else kept.get((r["a"], r["b"]))
        assert not r["n_removed"] or r["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        out.append((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], text))
    return out


@pytest.mark.parametrize(("window", "gram", "batches"), [(6, 3, 1), (5, 1, 3), (8, 8, 2)])
def test_substrings_equal_brute_force(spark, window, gram, batches):
    rng = random.Random(window)
    passage = [rng.choice("abcdefghij") for _ in range(window + 3)]
    docs = []
    for d in range(70):
        w = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 25))]
        if rng.random() < 0.4:
            w[rng.randint(0, len(w)) : 0] = passage[rng.randint(0, 3) :]
        if rng.random() < 0.1:
            w = ["z"] * rng.randint(1, 30)
        docs.append((d, " ".join(w)))
    docs += [(200, docs[3][1]), (201, docs[3][1]), (300, None), (301, " \n")]
    want = brute_cut(docs, window)
    got = found_cut(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), window, gram, batches)
    assert sorted((d, n, g, None if g == 0 else k) for d, n, g, _, k in got) == sorted((d, n, g, None if g == 0 else k) for d, n, g, k in want)


def thue_morse(n):
    """Two words that every polynomial modulo 2**64 hashes alike from 1024 letters on."""
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_words_of_one_polynomial_hash_are_not_equal(spark):
    one, two = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest.replace('w39', 'v39').replace('w4 ', 'v4 ')}"), (3, one), (4, two)], "doc_id long, text string")
    assert sorted(x[:3] for x in found_cut(docs, 35, 8)) == [(1, 41, 0), (2, 41, 0), (3, 1, 0), (4, 1, 0)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs.filter("doc_id > 2"), n=2).collect()}
    assert got == {3: 3, 4: 4}


def test_substrings_against_history(spark):
    """Three calls with one index: each loses what earlier calls or itself repeat."""
    rng = random.Random(8)
    passage = [rng.choice("abcdefghij") for _ in range(12)]
    docs = []
    for d in range(60):
        w = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 25))]
        if rng.random() < 0.4:
            w[rng.randint(0, len(w)) : 0] = passage[rng.randint(0, 3) :]
        docs.append((d, " ".join(w)))
    docs[45] = (45, docs[2][1])
    table = spark.createDataFrame(docs, "doc_id long, text string")
    index = substrings.FingerprintIndex(Workspace(spark, "t"), 2)
    for low, high in ((0, 20), (20, 40), (40, 60)):
        past = table.filter(f"doc_id < {low}") if low else None
        got = found_cut(table.filter(f"doc_id >= {low} and doc_id < {high}"), 8, 3, index=index, history=past)
        want = [x[:3] for x in brute_cut(docs[:high], 8) if x[0] >= low]
        assert sorted(x[:3] for x in got) == want and len(index.runs) == 1
    index.close()


def test_substring_edges(spark, corpus, nothing):
    got = sorted(((-1 if r[0] is None else r[0]), *r[1:4]) for r in found_cut(corpus, 6, 2))
    texts = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    whole = lambda t: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()
    want = sorted(((-1 if d is None else d), n, g, whole(t) if not g else whole("")) for (d, n, g, _), (_, t) in zip(brute_ascii(texts, 6), texts))
    assert got == want
    rows, changed = substrings.dedup_substrings(nothing)
    assert rows.collect() == [] and changed.collect() == []


def brute_ascii(docs, window):
    """As brute_cut, with words divided by ASCII white space only."""
    return brute_cut([(d, " ".join(str(x) for x in (t or "").encode().split())) for d, t in docs], window)


def test_index_is_incremental(spark):
    index = substrings.FingerprintIndex(Workspace(spark, "t"), 2)
    batch = lambda *x: spark.createDataFrame([(v, 1) for v in x], "fp long, times int")
    assert index.ingest(batch(1, 2, 3)).collect() == []
    assert [r["fp"] for r in index.ingest(batch(3, 4)).collect()] == [3]
    assert sorted(r["fp"] for r in index.ingest(batch(1, 4, 5, 5)).collect()) == [1, 4, 5]
    assert len(index.runs) == 3
    index.compact()
    assert len(index.runs) == 1 and sorted(r["fp"] for r in index.repeated().collect()) == [1, 3, 4, 5]
    index.close()


def test_archives(spark):
    big, body = "<p>" + "x" * 200 + "é</p>", "y" * 100
    pages = [(5, "http://a/ b", big), (3, "http://b", big), (9, None, big), (7, "u", body), (8, "u", body), (1, "s", "short"), (2, "s", "short"), (4, "n", None), (6, "n", ""), (None, "z", big), (3, "http://b", big), (10, "q\r\nWARC: x", "\r\n\r\n" + body)]
    df = spark.createDataFrame([(*p, "own") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    work = Workspace(spark, "warc")
    manifest = warc.write_archives(df, work, file_bytes=300)
    got = sorted((-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, work, manifest).collect())
    first = {big: 3, body: 7}
    want = sorted((-1 if p is None else p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), *(("revisit", first[h]) if h in first and p != first[h] else ("response", None))) for p, _, h in pages)
    assert got == want
    none = Workspace(spark, "warc")
    assert warc.read_archives(spark, none, warc.write_archives(df.limit(0), none)).collect() == []


def test_reading_archives_is_linear():
    one = [gzip.compress(warc.record(i, "http://a", "0" * 64, f"page {i} ".encode() * (i % 9), "2020-01-01T00:00:00Z")) for i in range(300)]
    found = list(warc.parse(b"".join(one)))
    assert [(int(f["X-Page-Id"]), body) for f, body in found] == [(i, f"page {i} ".encode() * (i % 9)) for i in range(300)]
    big = random.Random(1).randbytes(100_000)  # several feeds
    assert [b for _, b in warc.parse(gzip.compress(warc.record(1, "u", "0", big, "2020-01-01T00:00:00Z")) + one[1])][0] == big
    with pytest.raises(ValueError):
        list(warc.parse(one[5][:-9]))

    def seconds(n):
        raw = one[8] * n
        began = time.perf_counter()
        assert sum(1 for _ in warc.parse(raw)) == n
        return time.perf_counter() - began

    assert seconds(32_000) < 12 * seconds(4_000) + 1


def test_languages(spark):
    rng = random.Random(1)
    alphabet = {"aa": "abcdef", "bb": "defghi", "cc": "xyzöü"}
    docs = [(i, " ".join("".join(rng.choice(alphabet[k]) for _ in range(5)) for _ in range(20)), k) for i, k in enumerate(rng.choice(sorted(alphabet)) for _ in range(240))]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id < 160"), per_language=40)
    odd = spark.createDataFrame([(900, None, "kept"), (901, "", "kept"), (902, "12 34 !?", "kept"), (903, "\u00bd \u00b2 \u2167", "kept")], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in langid.identify(df.filter("doc_id >= 160"), model).collect()}
    assert np.mean([got[d]["lang_pred"] == k for d, _, k in docs if d >= 160]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len({round(r["score"], 3) for r in got.values()}) > 5
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()] == [("und", 0.0)] * 4
    nothing = langid.fit(df.limit(0))
    assert langid.identify(df, nothing).select("lang_pred").distinct().collect()[0][0] == "und"
    w = langid.fit(df.filter("doc_id < 160"), per_language=40).table
    assert (w == 0).mean() > 0.5  # sparse
    assert langid.grams("Ab").tolist() == langid.grams("aB").tolist()


def test_op6_on_the_small_tables(spark):
    """Held out by its rule, und by its rule, nearly all others right; ties, repeats and long texts get one result."""
    from quern.llm.queries import QUERIES

    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["op6_language"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, docs[r["doc_id"]]["text"] or ""))) and 0 <= r["score"] <= 1 for r in got)
    known = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert len(known) > 20 and np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in known]) >= 0.95
    df = spark.createDataFrame([(1, "abc def", "a"), (1, "abc def", "a"), (2, "abc def", "b"), (3, "xyz " * 200_000, "c"), (4, None, "c")], "doc_id long, text string, lang string")
    found = langid.identify(df, langid.fit(df)).collect()
    assert len({(r["lang_pred"], r["score"]) for r in found[:3]}) == 1 and found[3]["lang_pred"] == "c" and found[4]["lang_pred"] == "und"
    assert langid.fit(df, sample_bytes=1).languages == ["a", "b", "c"]


def test_ftrl_step_equals_plain_python():
    """One document of two classes: z, n and weights by the published update."""
    m = langid.Ftrl(1, 2)
    for y in (0, 1, 1):
        z, n, x = m.z.copy(), m.n.copy(), [2.0, 1.0]
        w = [[0.0 if abs(z[i][k]) <= langid.L1 else -(z[i][k] - math.copysign(langid.L1, z[i][k])) / ((langid.BETA + math.sqrt(n[i][k])) / langid.ALPHA + langid.L2) for k in range(2)] for i in range(2)]
        e = [math.exp(sum(x[i] * w[i][k] for i in range(2))) for k in range(2)]
        m.update(np.array([0, 1]), np.array(x), y)
        for i in range(2):
            for k in range(2):
                g = x[i] * (e[k] / sum(e) - (k == y))
                assert m.z[i][k] == pytest.approx(z[i][k] + g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / langid.ALPHA * w[i][k])
                assert m.n[i][k] == pytest.approx(n[i][k] + g * g)


@pytest.mark.parametrize(("keep", "lower"), [(NOT_SPACE, False), (ALNUM, True)])
def test_scan(keep, lower):
    texts = ["a B", None, "", " é\tX1-y ", "z", "q"]
    w = scan(pa.array(["skip", *texts]).slice(1), keep, lower)
    got = [(int(w.row[i]), w.text(i, i + 1).decode()) for i in range(len(w.start))]
    want = [(0, "a"), (0, "b" if lower else "B"), (3, "é"), *([(3, "x1"), (3, "y")] if lower else [(3, "X1-y")]), (4, "z"), (5, "q")]
    assert got == want and w.first.tolist()[0] == 0 and w.first.tolist()[-1] == len(want)
    h = scan(pa.array(["ab cd ab", "ab"]), keep, lower).hashes()
    assert h[0] == h[2] == h[3] != h[1]
