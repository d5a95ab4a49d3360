"""Chunkers: fixed token slices, line groups under a token budget, batches under two limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_chunks(docs: DataFrame, tokens: Column, size: int = 1500, keep: list[str] | None = None) -> DataFrame:
    """(keep, chunk_idx, chunk): consecutive slices of size tokens; no tokens, no chunk."""
    rows = docs.select(*(keep or ["doc_id"]), tokens.alias("_t")).filter(F.size("_t") > 0)
    starts = F.sequence(F.lit(0), F.size("_t") - 1, F.lit(size))
    return rows.select(*(keep or ["doc_id"]), "_t", F.posexplode(starts).alias("chunk_idx", "_s")).select(*(keep or ["doc_id"]), "chunk_idx", F.slice("_t", F.col("_s") + 1, F.lit(size)).alias("chunk"))


def _group(sizes: Column, limits: list[int]) -> Column:
    """Group number of each item: a new group begins when an item would exceed a limit of a group that isn't empty.

    sizes: array of structs s0, s1, ... One pass; the state is the group and what it holds.
    """
    names = [f"s{i}" for i in range(len(limits))]

    def step(acc: Column, x: Column) -> Column:
        over = F.lit(False)
        for n, limit in zip(names, limits):
            over = over | (acc[n] + x[n] > limit)
        new = over & acc["some"]
        g = acc["g"] + F.when(new, 1).otherwise(0)
        held = [(F.when(new, F.lit(0).cast("long")).otherwise(acc[n]) + x[n]).alias(n) for n in names]
        return F.struct(F.concat(acc["groups"], F.array(g)).alias("groups"), g.alias("g"), F.lit(True).alias("some"), *held)

    zero = F.struct(F.array().cast("array<int>").alias("groups"), F.lit(0).alias("g"), F.lit(False).alias("some"), *(F.lit(0).cast("long").alias(n) for n in names))
    return F.aggregate(sizes, zero, step, lambda acc: acc["groups"])


def line_chunks(docs: DataFrame, text: str = "text", budget: int = 1500, key: str = "doc_id") -> DataFrame:
    """(key, chunk_idx, chunk): whole lines up to a budget of blank-separated tokens; an oversized line stands alone."""
    lines = F.filter(F.split(text, r"(?<=\n)"), lambda x: x != "")
    sizes = F.transform("_l", lambda x: F.struct(F.size(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0))).cast("long").alias("s0")))
    rows = docs.filter(F.col(text).rlike(r"(?U)\S")).select(F.col(key), lines.alias("_l"))
    rows = rows.select(key, "_l", _group(sizes, [budget]).alias("_g"))
    each = rows.select(key, F.posexplode(F.arrays_zip("_l", "_g")).alias("pos", "x")).select(key, "pos", F.col("x._l").alias("line"), F.col("x._g").alias("chunk_idx"))
    parts = each.groupBy(key, "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    return parts.select(key, "chunk_idx", F.array_join(F.transform("x", lambda p: p["line"]), "").alias("chunk"))


def request_batches(items: DataFrame, group: str, order: str, tokens: str, most_items: int = 128, most_tokens: int = 80_000) -> DataFrame:
    """(group, order, batch): consecutive items under both limits; the first item of a batch is always accepted."""
    rows = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).cast("long").alias("t")))).alias("_x"))
    sizes = F.transform("_x", lambda p: F.struct(F.lit(1).cast("long").alias("s0"), p["t"].alias("s1")))
    rows = rows.select(group, F.col("_x"), _group(sizes, [most_items, most_tokens]).alias("_g"))
    return rows.select(group, F.explode(F.arrays_zip("_x", "_g")).alias("_p")).select(group, F.col("_p._x.o").alias(order), F.col("_p._g").alias("batch"))
