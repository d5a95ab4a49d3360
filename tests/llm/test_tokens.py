"""Packing and token files against encoding one text at a time."""

import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from quern.llm import packing, tokenfile
from quern.llm.common import Workspace
from quern.llm.tokens import WordStore, vocabulary

SF = "/root/testdata/sf0.001"


def plain(name):
    t = Tokenizer.from_file(vocabulary(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_store_equals_whole_texts(corpus):
    rng = random.Random(5)
    texts = [r["text"] for r in corpus.select("text").collect()]
    texts += ["".join(rng.choice("ab é.'12 \n\t<|́　sS\x1c\u01c5ßſ") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["a\x1cb \x1f c", "x\x00y \x00z", "\n lead", "a\nb\n\nc", "it's don't've 12a,b", "caf\u00e9 \u00bd \u00b2x \u00ad soft\u00adhyphen", "<|endoftext|> a <|endoftext|>", "a ́b", "İstanbul ΑΣ ΣΑΣ", "don't 's 't it 'll"]
    for name, blank in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        s, one = WordStore(vocabulary(name), blank), plain(name)
        for _ in range(2):
            ids, sizes = s.encode(pa.array(texts))
            at = np.concatenate([[0], np.cumsum(sizes)])
            for t, a, b in zip(texts, at[:-1], at[1:]):
                assert ids[a:b].tolist() == one(t), repr(t)


def test_added_tokens_are_known_in_texts():
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|> y", "x<|endoftext|>", " <|endoftext|> <|endoftext|>\n", "<|endoftext", None, "plain text"]
    for name, blank in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        t, s = Tokenizer.from_file(vocabulary(name)), WordStore(vocabulary(name), blank)
        texts += [f"u {x.content}v {x.content} w" for x in t.get_added_tokens_decoder().values()]
        ids, sizes = s.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert WordStore(vocabulary("byte_bpe_50k.json"), True).encode(pa.array(["a <|endoftext|> b"]))[0].tolist() == [64, 220, 50256, 275]
    literal = WordStore(vocabulary("byte_bpe_50k.json"), True, literal_specials=True).encode(pa.array(["a <|endoftext|> b"]))[0].tolist()
    assert 50256 not in literal and len(literal) > 4


def check_packing(rows, docs, one, capacity=1024):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for doc, text in docs.items():
        ids, at = [*one(text), 0], 0
        for p in sorted(pieces.pop(doc), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == crc(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    assert not pieces
    used = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= capacity
        used += at
    return used, len(sequences) * capacity


def test_op1(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    used, room = check_packing(packing.op1_pack(spark, SF).collect(), docs, plain("byte_bpe_50k.json"))
    assert used >= 0.97 * room


def test_pack_edge_cases(spark, corpus, nothing):
    path = vocabulary("byte_bpe_50k.json")
    rows = packing.pack(corpus.coalesce(1), path).collect()
    assert {r["doc_id"] for r in rows} == {None, *range(10)}
    assert sum(r["length"] for r in rows if r["doc_id"] in (1, 2)) == 2
    assert sum(r["length"] for r in rows if r["doc_id"] == 6) == 2 * sum(r["length"] for r in rows if r["doc_id"] == 0)
    assert packing.pack(nothing, path).collect() == []


def test_differencing_is_near_equal():
    rng = random.Random(1)
    sizes = [rng.randint(1, 128) for _ in range(700)]
    loads = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 50)]
    assert sum(loads) == sum(sizes) and max(loads) - min(loads) < 30
    windows = packing.pack_items(sizes, 1024)
    assert sorted(i for w in windows for i in w) == list(range(700))
    assert max(sum(sizes[i] for i in w) for w in windows) <= 1024
    assert packing.pack_items([700, 700, 700], 1024) != [] and len(packing.pack_items([700, 700, 700], 1024)) == 3


def test_op9(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    one, at, want = plain("word_bpe_49k.json"), 0, []
    for d, t in docs:
        ids = [*one(t), 2]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.op9_token_files(spark, SF).collect()]
    assert sorted(got) == want


def test_token_file_edge_cases(spark, corpus, nothing):
    work, path = Workspace(spark, "t"), vocabulary("word_bpe_49k.json")
    manifest = tokenfile.write_tokens(corpus, work, path, 2, file_ids=500)
    rows = tokenfile.read_tokens(spark, work, manifest).collect()
    assert len(rows) == corpus.count()
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 0, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    at = 0
    for r in rows:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    work = Workspace(spark, "t")
    assert tokenfile.read_tokens(spark, work, tokenfile.write_tokens(nothing, work, path, 2)).collect() == []


def test_random_access():
    rng = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 5000):
        for top in (2, 300, 70_000, 20_000_000):
            ids = rng.integers(0, top, n).astype(np.uint32)
            f = tokenfile.TokenFile(tokenfile.pack_file([7, None], np.array([0, n // 2, n]), ids))
            assert f.doc_ids == [7, None] and (f.all() == ids).all()
            pick = rng.permutation(n)
            assert (f.tokens(pick) == ids[pick]).all()
            if n:
                assert f.token(n - 1) == ids[-1]
