"""Sequence packing by Karmarkar-Karp multiway differencing.

A document's ids and an end id are cut at multiples of the sequence length; whole pieces are sequences. What remains of
each document is cut into pieces of at most ``piece`` ids, which are gathered into blocks of a bounded number of ids and
packed block by block: partial partitions with opposing imbalances are merged until one near-equal partition into
windows is left; if a window exceeds the capacity, the number of windows rises and the block is packed anew.

One pass, no shuffle: each task packs its own documents, so memory is bounded by a block and a lost task is repeated
alone. Padding is under one window a block and what the near-equal windows lack.

Defined results: a null or empty text is a document of only the end id. Repeated documents are packed each by itself.
An empty table has no sequences. sequence_id is unique, not gapless; it depends on how the input is partitioned, so the
input should be a table or another source that is read the same way again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.tokens import BLOCK, store, vocabulary
from quern.llm.words import blocks

#: Ids of a sequence, most ids of a piece of a document's rest, sequences that a block fills.
CAPACITY, PIECE, BLOCK_SEQUENCES = 1024, 128, 96


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k windows with near-equal sums of sizes: item numbers of each.

    A partial partition is k loads, descending and less their least, with the items of each. The two partitions with
    the largest spreads are merged, the heaviest window of one with the lightest of the other.
    """
    heap = []
    for i, s in enumerate(sizes):
        loads, items = np.zeros(k, np.int64), np.empty(k, object)
        items.fill(())
        loads[0], items[0] = s, (i,)
        heap.append((-s, i, loads, items))
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a, a_items = heapq.heappop(heap)
        _, _, b, b_items = heap[0]
        loads = a + b[::-1]
        order = np.argsort(-loads, kind="stable")
        loads, items = loads[order], (a_items + b_items[::-1])[order]
        loads -= loads[-1]
        heapq.heapreplace(heap, (-int(loads[0]), turn, loads, items))
        turn += 1
    return [list(x) for x in heap[0][3]] if heap else []


def pack_items(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few near-equal windows of at most capacity as differencing finds from the least possible number on."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if max((sum(sizes[i] for i in w) for w in windows), default=0) <= capacity:
            return [w for w in windows if w]
        k += 1


SCHEMA = "doc_id {key}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, piece: int = PIECE, block_sequences: int = BLOCK_SEQUENCES, blank_leads: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: (doc_id, start in its document, length, ids as little-endian unsigned 32-bit, doc_tokens, sequence_id, offset)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    key_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, sequence = store(tokenizer, blank_leads), TaskContext.get().partitionId() << 36
        held: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of rests
        held_ids, kind = 0, None

        def emit(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array([len(x) for x in cols[2]], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in cols[2]], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[3:])],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        def flush() -> list[tuple]:
            nonlocal held, held_ids, sequence
            out = []
            for w in pack_items([len(h[2]) for h in held], capacity):
                at = 0
                for i in sorted(w):
                    out.append((*held[i], sequence, at))
                    at += len(held[i][2])
                sequence += 1
            held, held_ids = [], 0
            return out

        for batch in blocks(batches, size=BLOCK):
            kind = batch.column("doc_id").type
            flat, sizes = words.encode(batch.column("text"))
            ends = np.cumsum(sizes)
            out: list[tuple] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), ends - sizes, ends):
                ids = np.append(flat[a:b], np.uint32(end_id))
                n = len(ids)
                whole = n - n % capacity
                for s in range(0, whole, capacity):
                    out.append((doc, s, ids[s : s + capacity], n, sequence, 0))
                    sequence += 1
                for s in range(whole, n, piece):
                    held.append((doc, s, ids[s : s + piece], n))
                held_ids += n - whole
                if held_ids >= block_sequences * capacity:
                    out += flush()
            if out:
                yield emit(out)
        if held:
            yield emit(flush())

    return rows.mapInArrow(run, SCHEMA.format(key=key_type))


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack(docs, vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
