"""The pipeline's stages on the smallest tables against plain Python."""

import corpus_pipeline
from quern.llm.quality import STOP_WORDS
from tests.llm.test_dedup import brute_near
from tests.llm.test_filters import brute_hits, brute_lines, brute_stats
from tests.llm.test_tokens import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now, texts = docs, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        if name == "quality_rules":
            texts = {d: t for d, t in texts.items() if good(t)}
        elif name == "line_dedup":
            gone, after = brute_lines(sorted(texts.items()), 8), {}
            for d, t in texts.items():
                lines = [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone]
                if any(x.split() for x in lines) or not t.split():
                    after[d] = "\n".join(lines)
            texts = after
        elif name == "near_dedup":
            least, _ = brute_near(sorted(texts.items()), 5, 80)
            texts = {d: t for d, t in texts.items() if least[d] == d}
        else:
            hits = {d: brute_hits(t, bench) for d, t in texts.items()}
            assert any(h[2] for h in hits.values())
            texts = {d: t for d, t in texts.items() if len(hits[d][2]) < 2}
            clean = {d for d in texts if not hits[d][1]}
            rows = {r["doc_id"]: r["text"] for r in now.collect()}
            assert rows.keys() == texts.keys() and all(rows[d] == texts[d] for d in clean)
            assert all(len(brute_hits(rows[d], bench)[1]) == 0 for d in texts)
            continue
        assert {r["doc_id"]: r["text"] for r in now.collect()} == texts, name
    ids = {d: len(plain("byte_bpe_50k.json")(t)) + 1 for d, t in rows.items()}
    packed = corpus_pipeline.run(spark, SF).collect()
    total = {}
    for r in packed:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == ids


def good(text):
    n, chars, repeated = brute_stats(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    stop = sum(w.lower() in STOP_WORDS for w in text.split())
    return n >= 50 and 100 * repeated <= 50 * n and 100 * symbols <= 30 * n and 2 * n <= chars <= 15 * n and 100 * stop >= n and 100 * (len(lines) - len(set(lines))) <= 50 * len(lines)
