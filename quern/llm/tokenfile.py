"""Token-id files with directly addressable codes: any token is read without decoding a block.

File: b"DACT1\\n", an 8-byte little-endian header length, a JSON header, then sections of 8-byte aligned arrays. Ids are
split into chunks of ``bits`` bits, least first. Level k holds the k-th chunk of every id that has one, a bitmap that
says which of them go on to level k + 1, and a rank directory: the number of ones before each 512-bit block. Token i is
chunk i of level 0; if its bit is set, its next chunk is at position rank(i) of level 1, and so on. ``doc_id`` and
``begin`` sections give the documents and where their ids begin.

``write_tokens`` orders documents by id (range partitions, sorted within), encodes, and writes files of bounded size;
``read_tokens`` gives the documents back. Global starts come from one total per file.

Defined results: a null or empty text is a document of only the end id. Rows that repeat an id follow each other, by
text. A null id sorts first. An empty table writes no file.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import files
from quern.llm.common import Workspace
from quern.llm.tokens import BLOCK, store, vocabulary
from quern.llm.words import blocks

MAGIC, CHUNK_BITS, BLOCK_BITS = b"DACT1\n", 8, 512
#: Ids after which a task begins a new file; a longer document is not divided.
FILE_IDS = 4_000_000


class Level:
    """Chunks, continuation bitmap and rank directory of one level."""

    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bitmap, self.ranks = chunks, bitmap, ranks

    def follows(self, i: np.ndarray) -> np.ndarray:
        return (self.bitmap[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i, from the directory and at most one block of the bitmap."""
        block = i // BLOCK_BITS
        at = block[:, None] * (BLOCK_BITS // 8) + np.arange(BLOCK_BITS // 8)
        some = self.bitmap[np.minimum(at, len(self.bitmap) - 1)]
        left = (i - block * BLOCK_BITS)[:, None] - 8 * np.arange(BLOCK_BITS // 8)
        some = np.where(left >= 8, some, some & ((1 << np.clip(left, 0, 8)) - 1).astype(np.uint8))
        return self.ranks[block] + np.bitwise_count(some).sum(1, dtype=np.int64)


def split_levels(ids: np.ndarray, bits: int = CHUNK_BITS) -> list[Level]:
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = (rest >> bits) > 0
        padded = np.zeros(-(-max(1, len(rest)) // BLOCK_BITS) * BLOCK_BITS, bool)
        padded[: len(rest)] = more
        ones = padded.reshape(-1, BLOCK_BITS).sum(1)
        out.append(Level((rest & ((1 << bits) - 1)).astype(np.uint8 if bits <= 8 else np.uint16), np.packbits(padded, bitorder="little"), np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)))
        rest = rest[more] >> bits
        if not len(rest):
            return out


def pack_file(doc_ids: np.ndarray, begin: np.ndarray, ids: np.ndarray, bits: int = CHUNK_BITS) -> bytes:
    """doc_ids: object array, null allowed; begin: one more than documents."""
    parts: list[tuple[str, np.ndarray]] = [("doc_id", np.array([0 if d is None else d for d in doc_ids], np.int64)), ("doc_null", np.array([d is None for d in doc_ids], np.uint8)), ("begin", begin.astype(np.int64))]
    levels = split_levels(ids, bits)
    for k, x in enumerate(levels):
        parts += [(f"chunks{k}", x.chunks), (f"bitmap{k}", x.bitmap), (f"ranks{k}", x.ranks)]
    at, sections = 0, {}
    for name, x in parts:
        sections[name] = [at, len(x), x.dtype.str]
        at += -(-x.nbytes // 8) * 8
    header = json.dumps({"bits": bits, "levels": len(levels), "n": len(ids), "sections": sections}).encode()
    body = b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for _, x in parts)
    return MAGIC + len(header).to_bytes(8, "little") + header + body


class TokenFile:
    """Reads a file's bytes; ``token`` is random access, ``document`` and ``all`` are vectors of it."""

    def __init__(self, raw: bytes):
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(raw[len(MAGIC) : len(MAGIC) + 8], "little")
        head = len(MAGIC) + 8
        meta = json.loads(raw[head : head + n])
        part = lambda k: np.frombuffer(raw, np.dtype(meta["sections"][k][2]), meta["sections"][k][1], head + n + meta["sections"][k][0])
        self.bits, self.n, self.begin = meta["bits"], meta["n"], part("begin")
        self.doc_ids = [None if z else int(d) for d, z in zip(part("doc_id"), part("doc_null"))]
        self.levels = [Level(part(f"chunks{k}"), part(f"bitmap{k}"), part(f"ranks{k}")) for k in range(meta["levels"])]

    def tokens(self, i: np.ndarray) -> np.ndarray:
        """The ids at any positions."""
        out, alive, at = np.zeros(len(i), np.uint32), np.arange(len(i)), np.asarray(i, np.int64)
        for k, level in enumerate(self.levels):
            if not len(at):
                break
            out[alive] |= level.chunks[at].astype(np.uint32) << np.uint32(k * self.bits)
            more = level.follows(at)
            alive, at = alive[more], at[more]
            at = level.rank(at) if len(at) else at
        return out

    def token(self, i: int) -> int:
        return int(self.tokens(np.array([i]))[0])

    def all(self) -> np.ndarray:
        """Every id in order: level by level, a continuation's position is its rank, which is its turn."""
        out, alive = np.zeros(self.n, np.uint32), np.arange(self.n)
        for k, level in enumerate(self.levels):
            out[alive] |= level.chunks[: len(alive)].astype(np.uint32) << np.uint32(k * self.bits)
            alive = alive[np.unpackbits(level.bitmap, bitorder="little", count=len(alive)) > 0] if len(alive) else alive
        return out


def write_tokens(docs: DataFrame, work: Workspace, tokenizer: str, end_id: int, blank_leads: bool = False, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write docs as token files below work and return the manifest: (partition, number, name, n_docs, n_ids)."""
    folder = f"{work.path}/tokens"
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, number = store(tokenizer, blank_leads), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            docs_, sizes, ids = [d for h in held for d in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            name = files.put(folder, ".dact", pack_file(docs_, np.concatenate([[0], np.cumsum(sizes)]), ids))
            row = {"partition": [TaskContext.get().partitionId()], "number": [number], "name": [name], "n_docs": [len(docs_)], "n_ids": [len(ids)]}
            number, held = number + 1, []
            return pa.RecordBatch.from_pydict(row)

        for batch in blocks(batches, size=BLOCK):
            ids, sizes = words.encode(batch.column("text"))
            full = np.full(len(ids) + len(sizes), end_id, np.uint32)
            ends = np.cumsum(sizes + 1)
            inside = np.ones(len(full), bool)
            inside[ends - 1] = False
            full[inside] = ids
            held.append((batch.column("doc_id").to_pylist(), sizes + 1, full))
            if sum(len(h[2]) for h in held) >= file_ids:
                yield flush()
        if held:
            yield flush()

    return work.save(rows.mapInArrow(encode, "partition long, number long, name string, n_docs long, n_ids long"), "manifest")


def read_tokens(spark: SparkSession, work: Workspace, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids: little-endian unsigned 32-bit, ids_crc32) of all documents, from the files.

    Starts: one total per partition of the writer comes to the driver; files of a partition add up in a window.
    """
    totals, start = [], 0
    for r in manifest.groupBy("partition").agg(F.sum("n_ids").alias("n")).orderBy("partition").collect():
        totals.append((r["partition"], start))
        start += r["n"]
    offsets = F.broadcast(spark.createDataFrame(totals, "partition long, base long"))
    before = Window.partitionBy("partition").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.join(offsets, "partition").select("name", (F.col("base") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).alias("first"))
    listed = listed.repartition(spark.sparkContext.defaultParallelism * 2)
    folder = f"{work.path}/tokens"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = TokenFile(files.get(folder, name))
                ids = f.all().astype("<u4")
                raw = [ids[a:b].tobytes() for a, b in zip(f.begin[:-1], f.begin[1:])]
                for at in range(0, len(raw), 2000):
                    some = raw[at : at + 2000]
                    cols = [pa.array(f.doc_ids[at : at + 2000], pa.int64()), pa.array(f.begin[at : at + len(some)] + first), pa.array(np.diff(f.begin)[at : at + 2000]), pa.array([zlib.crc32(x) for x in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*cols, *([pa.array(some, pa.binary())] if with_ids else [])], ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    return listed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    work = Workspace(spark, "tokens")
    manifest = write_tokens(docs, work, vocabulary("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, work, manifest, with_ids=False)
