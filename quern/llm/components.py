"""Connected components by alternating large-star and small-star, as joins over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Workspace, few_tasks

#: Edges of a task, and tasks for few edges: small graphs don't need a task for each shuffle partition.
TASK_EDGES, EDGE_TASKS = 20_000, 6


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
    rest = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks)


def components(edges: DataFrame, work: Workspace, label: str = "components") -> DataFrame:
    """(node, component): the least node that each node of an edge (u, v) reaches, but for nodes that are their own.

    Each round is a written table; it ends when a round leaves the edges as they were, which then form stars.
    """
    now = work.save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}-0")
    state, k = _state(now), 0
    while state[0]:
        k += 1
        tasks = few_tasks(work.spark, EDGE_TASKS + state[0] // TASK_EDGES)
        after = work.save(_small_star(_large_star(now, tasks), tasks), f"{label}-{k}")
        new = _state(after)
        work.drop(f"{label}-{k - 1}")
        now, same, state = after, new == state, new
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
