"""Near-duplicate documents: MinHash with banding, signature and full-set verification, connected components.

1. Each whole text becomes the set of its distinct word n-gram hashes, ``bands * rows`` universal hash minima of it and a
   key for each band of them. Equal sets are one representative (least id) from here on.
2. Documents with an equal band key share a bucket. A bucket is never paired off. First its members meet leaders, drawn by
   hash, one for each of a few orders; each document is verified against the few leaders with which it shares most
   buckets: one-byte signatures drop only what is five standard errors below the threshold, full shingle sets decide.
   Components of the verified links follow.
3. The members of buckets with several components form groups, each around a pivot document. From here on a document s of a group is D(s), the shingles in which its full set differs from the group's
   reference set P. For any P, documents s and c differ in |D(s)| + |D(c)| - 2 |D(s) & D(c)| shingles, and 100 * common >=
   t * union is the same as (100 + t) * differing <= (100 - t) * (|s| + |c|). With R(s) = (100 + t) |D(s)| - (100 - t) |s|
   they are linked if and only if 2 (100 + t) |D(s) & D(c)| >= R(s) + R(c).
4. P becomes the set of most members: shingles in which more than half of them differ from P change sides. Let c* have the
   least R. All s with R(s) + R(c*) <= 0 are linked with c*. Two documents without a common difference are linked only
   if both are of those, so what remains are pairs with a common difference, (R(s) + R(c*)) / (2 (100 + t)) at least.
   As in prefix filtering, such a pair shares one of the rarest |D(s)| - that + 1 of s's differences (those that others
   have too), and likewise of c's. Documents with a difference in common there form a group again, which
   is kept only while it has several components. A group of at most DENSE members, within bounds of memory and work, is
   compared in one worker by products of its incidence matrix and emits a row for each member at most; of others, those of
   at most PAIRED members are compared pair by pair. Larger ones get a reference set of their own, in which the common difference is no difference any more. So a template
   filled in thousands of ways, or thousands of near copies, cost a row for each document and rare difference,
   and no link between two documents of a bucket is lost.
5. Components are closed by alternating large-star and small-star.

A pair at the threshold shares no band with probability (1 - 0.8**rows)**bands, 3e-8 with 5 rows and 44 bands. Shingles
are compared by 64 bits of hashes of their words; see words.

Defined results: null and wordless texts have empty sets and are linked with nothing. A text of fewer words than n is
one shingle. Rows that repeat an id and text are one document, both with its component. Rows that give an id several
texts are one document in ``near_duplicates``, with the links of all of them, and documents of their own in ``keep_one``.
Rows without an id take part; a component without any id is null. Ties: the least id leads. Ids are below 2**62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_KEYS, Workspace, few_tasks
from quern.llm.components import components
from quern.llm.words import U64, Words, blocks, mix, scan

#: Bands, minima of each, orders in which leaders are drawn, leaders that a document is verified against at first.
BANDS, ROWS, ORDERS, TRIES = 44, 5, 2, 2
#: Documents with a neighbour in a task, and tasks for few of them.
TASK_MEMBERS, MEMBER_TASKS = 1000, 6
#: Members of a group that is compared pair by pair.
PAIRED = 12
#: Members, differences and multiplications of a group that one worker compares, and cells of its matrix held at once.
DENSE, DENSE_ITEMS, DENSE_WORK, DENSE_CELLS = 512, 1 << 21, 1 << 35, 1 << 21
#: Numbers from here on stand for rows without an id, or with one that has other texts too.
UNNAMED = 1 << 62


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes, ascending within each row, and where each row's begin."""
    h, rows = w.hashes(), len(w.first) - 1
    g, same = w.grams(h, n)
    out = []
    for r in range(rows):
        a, b = int(w.first[r]), int(w.first[r + 1])
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            out.append(mix(np.array([np.bitwise_xor.reduce(mix(h[a:b] + np.arange(1, b - a + 1, dtype=U64)))], U64)))
        else:
            out.append(g[:0])
    return (np.concatenate(out) if out else np.empty(0, U64)), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def minima(values: np.ndarray, begin: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """n universal hash minima (a * x + b modulo 2**64, a odd) of each set; of an empty set they mean nothing."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U64)
    rows = len(begin) - 1
    out = np.zeros((rows, n), U64)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        work = np.empty_like(values)
        for k in range(n):
            np.multiply(values, a[k], out=work)
            work += b[k]
            out[full, k] = np.minimum.reduceat(work, begin[full])
    return mix(out)


def signatures(docs: DataFrame, n: int, bands: int, rows: int, key: str, text: str) -> DataFrame:
    """(doc_id, th: a hash of the text, n_shingles, s1, s2: 128 bits of the set, keys: of the bands, sig: a byte of each minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            values, begin = shingle_sets(scan(batch.column("text"), lower=True), n)
            size, many = np.diff(begin), batch.num_rows
            m = minima(values, begin, bands * rows)
            keys = m.reshape(many, bands, rows)
            fold = np.zeros((many, bands), U64)
            for k in range(rows):
                fold = mix(fold * U64(0x9E3779B97F4A7C15) + keys[:, :, k])
            fold = mix(fold + np.arange(1, bands + 1, dtype=U64))
            total = np.concatenate([[0], np.cumsum(values)]).astype(U64), np.concatenate([[0], np.cumsum(mix(values))]).astype(U64)
            s1, s2 = (mix(t[begin[1:]] - t[begin[:-1]] + size.astype(U64)) for t in total)
            sig = np.ascontiguousarray((m & U64(255)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(size), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * bands, pa.int32()), pa.array(fold.ravel().view(np.int64))), pa.array([x.tobytes() for x in sig], pa.binary())],
                ["doc_id", "th", "n_shingles", "s1", "s2", "keys", "sig"],
            )

    return _plain(docs, key, text).mapInArrow(run, "doc_id long, th long, n_shingles long, s1 long, s2 long, keys array<long>, sig binary")


def _plain(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))


def _likely(pairs: DataFrame, sigs: DataFrame, threshold: float, total: int, tasks: int) -> DataFrame:
    """Pairs (u, v) whose one-byte signatures don't rule the threshold out."""
    least = total * (threshold - 5 * (threshold * (1 - threshold) / total) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.array([np.frombuffer(s, np.uint8) for s in b.column(i).to_pylist()]).reshape(b.num_rows, total) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array((x == y).sum(1) >= least))

    side = lambda c, s: sigs.select(F.col("doc_id").alias(c), F.col("sig").alias(s))
    both = pairs.join(side("u", "su"), "u").coalesce(tasks).join(side("v", "sv"), "v").select("u", "v", "su", "sv").coalesce(tasks)
    return both.mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int, tasks: int) -> DataFrame:
    """Pairs (u, v) with 100 * intersection >= percent * union of their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)  # rows come by v, often with one v after the other
        for big in batches:
            for b in blocks(blocks([big], "tu"), "tv"):
                values, begin = shingle_sets(scan(b.column("tu"), lower=True), n)
                keep = []
                for i, (v, t) in enumerate(zip(b.column("v").to_pylist(), b.column("tv"))):
                    if last[0] != v:
                        last = (v, shingle_sets(scan(pa.array([t.as_py()]), lower=True), n)[0])
                    x, y = values[begin[i] : begin[i + 1]], last[1]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, s: texts.select(F.col("doc_id").alias(c), F.col("text").alias(s))
    both = pairs.join(side("u", "tu"), "u").coalesce(tasks).join(side("v", "tv"), "v").select("u", "v", "tu", "tv").coalesce(tasks)
    return both.mapInArrow(run, "u long, v long")


def _differences(pairs: DataFrame, texts: DataFrame, n: int, tasks: int) -> DataFrame:
    """(u, v, size: of u's set, d: shingles that one of u and v has) of pairs (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for big in batches:
            for b in blocks(blocks([big], "tu"), "tv"):
                values, begin = shingle_sets(scan(b.column("tu"), lower=True), n)
                out = []
                for i, (v, t) in enumerate(zip(b.column("v").to_pylist(), b.column("tv"))):
                    if last[0] != v:
                        last = (v, shingle_sets(scan(pa.array([t.as_py()]), lower=True), n)[0])
                    out.append(np.setxor1d(values[begin[i] : begin[i + 1]], last[1], assume_unique=True).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(begin), pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["u", "v", "size", "d"])

    side = lambda c, s: texts.select(F.col("doc_id").alias(c), F.col("text").alias(s))
    both = pairs.join(side("u", "tu"), "u").coalesce(tasks).join(side("v", "tv"), "v").select("u", "v", "tu", "tv").coalesce(tasks)
    return both.mapInArrow(run, "u long, v long, size long, d array<long>")


def _groups(members: DataFrame, found: DataFrame, ids: DataFrame, work: Workspace, tasks: int) -> DataFrame:
    """Pairs (u, v): documents of buckets that hold several components, and the pivots of their groups.

    A bucket's top is its document with the greatest weight; its group has for pivot the weightiest of all tops of the
    buckets that this is in. So the many buckets of one large set of similar documents are mostly one group.
    """
    named = members.select("bucket", "doc_id").coalesce(tasks).join(ids, "doc_id").join(found.coalesce(tasks), F.col("doc_id") == F.col("node"), "left").coalesce(tasks)
    named = work.save(named.select("bucket", "doc_id", "weight", F.coalesce("component", "doc_id").alias("component")), "named")
    top = named.groupBy("bucket").agg(F.max(F.struct("weight", "doc_id")).alias("top"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket", "top")
    rows = work.save(named.select("bucket", "doc_id").join(top.coalesce(tasks), "bucket").coalesce(tasks), "divided")
    best = rows.groupBy("doc_id").agg(F.max("top")["doc_id"].alias("v")).select(F.col("doc_id").alias("at"), "v").coalesce(tasks)
    pairs = rows.select(F.col("doc_id").alias("u"), F.col("top.doc_id").alias("at")).distinct().coalesce(tasks).join(best, "at").select("u", "v").distinct()
    return work.save(pairs.coalesce(tasks), "groups")


def _per_group(rows: DataFrame, groups: DataFrame, work: Workspace, name: str, how: str = "inner") -> DataFrame:
    """rows with the columns of their group, which are broadcast if they are few."""
    groups = work.save(groups, name)
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_KEYS // 8 else groups, "g", how)


def _divided(rows: DataFrame, found: DataFrame, work: Workspace, label: str, tasks: int) -> DataFrame:
    """rows (g, u, d, ...) of groups that hold several components, with component, n, the members of the group, and total,
    their differences."""
    rows = rows.join(found.coalesce(tasks), F.col("u") == F.col("node"), "left").withColumn("component", F.coalesce("component", "u")).drop("node").coalesce(tasks)
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.size("d").cast("long")).alias("total"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("g", "n", "total").coalesce(tasks)
    return _per_group(rows, groups, work, f"{label}-groups").coalesce(tasks)


def _dense(rows: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that connect what is linked within each group: rows (g, u, size, d) of groups of bounded size."""

    def run(group: pa.Table) -> pa.Table:
        u, size, d = group["u"].to_numpy(), group["size"].to_numpy(), group["d"].combine_chunks()
        many, n = d.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), len(u)
        x, at = np.unique(d.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        member, shared = np.repeat(np.arange(n), many), np.bincount(at, minlength=len(x)) > 1
        column, own = np.cumsum(shared) - 1, shared[at]
        member, column = member[own], column[at[own]]
        order = np.argsort(column, kind="stable")
        member, column = member[order], column[order]
        common, step = np.zeros((n, n)), DENSE_CELLS // n
        items = int(shared.sum())
        for low in range(0, items, step):
            a, b = np.searchsorted(column, [low, low + step])
            held = np.zeros((n, min(step, items - low)), np.float32)
            held[member[a:b], column[a:b] - low] = 1
            common += held @ held.T
        r = (100 + percent) * many - (100 - percent) * size
        linked = 2 * (100 + percent) * common >= r[:, None] + r[None, :]
        np.fill_diagonal(linked, True)
        label = np.arange(n)
        while True:
            least = np.where(linked, label[None, :], n).min(1)
            if (least == label).all():
                break
            label = least
        apart = label != np.arange(n)
        return pa.table({"u": u[apart], "v": u[label[apart]]})

    return rows.select("g", "u", "size", "d").groupBy("g").applyInArrow(run, "u long, v long")


def _paired(rows: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between the members of small groups: rows (g, u, size, d, component)."""
    rows = rows.withColumn("r", _r(percent, F.col("d"), F.col("size")))
    other = rows.select("g", *(F.col(c).alias(f"{c}2") for c in ("u", "d", "component", "r")))
    least = F.ceil((F.col("r") + F.col("r2")) / (2.0 * (100 + percent)))
    pairs = rows.join(other, "g").filter("u < u2 and component <> component2").filter(F.least(F.size("d"), F.size("d2")) >= least)
    return pairs.filter(2 * (100 + percent) * F.size(F.array_intersect("d", "d2")) >= F.col("r") + F.col("r2")).select("u", F.col("u2").alias("v"))


def _r(percent: int, d: Column, size: Column) -> Column:
    return (100 + percent) * F.size(d).cast("long") - (100 - percent) * size


def _least(percent: int, r: Column) -> Column:
    """Common differences that two documents with r = R + R need."""
    return F.greatest(F.lit(1), F.ceil(r / (2.0 * (100 + percent)))).cast("int")


def _pruned(rows: DataFrame, percent: int, work: Workspace, label: str, tasks: int) -> DataFrame:
    """rows (g, u, r, core, side, order, ...) that may still be linked otherwise, with need and need2, the least numbers of
    common differences with any member and with one of the rest, and order, the differences (f, x) that members of
    another side have too, rarest first.

    A member with fewer than it needs goes; the others lose its differences and need more without it, and so on. The
    rounds end when one leaves most members; more would change no link.
    """
    before, k = rows.count(), 0
    while True:
        least = rows.groupBy("g").agg(F.min(F.when(F.col("core"), F.col("r"))).alias("rc"), F.min(F.when(~F.col("core"), F.col("r"))).alias("r2")).filter("r2 is not null").coalesce(tasks)
        now = _per_group(rows.drop("need", "need2"), least, work, f"{label}-least-{k}").withColumn("need2", _least(percent, F.col("r") + F.col("r2")))
        now = now.withColumn("need", F.when(F.col("core"), F.col("need2")).otherwise(_least(percent, F.col("r") + F.least("rc", "r2")))).drop("rc", "r2")
        now = work.save(now.filter(F.size("order") >= F.col("need")).coalesce(tasks), f"{label}-open-{k}")
        items = now.select("g", "u", "side", F.explode("order.x").alias("x"))
        often = items.groupBy("g", "x").agg(F.count("*").alias("f"), F.min("side").alias("low"), F.max("side").alias("high")).filter("low < high").select("g", "x", "f")
        often = work.save(often.coalesce(tasks), f"{label}-often-{k}")
        often = F.broadcast(often) if often.count() <= BROADCAST_KEYS // 2 else often
        order = items.join(often, ["g", "x"]).groupBy("g", "u").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("order"))
        rows = work.save(now.drop("order").join(order, ["g", "u"]).filter(F.size("order") >= F.col("need")).coalesce(tasks), f"{label}-pruned-{k}")
        left = rows.count()
        if left >= 0.5 * before or not left:
            return rows
        before, k = left, k + 1


def _narrowed(rows: DataFrame, percent: int, work: Workspace, label: str, tasks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of large groups (g, u, size, d, skip, component, n): links with the member nearest to the reference set; the other
    members that may be linked (g, u, size, d, skip, first); and their parts, a row for each u and x in first.

    Two members that are linked otherwise share a part, that of the first of their common differences in the order of
    the group. skip: differences that no such pair of members has in common, from the groups that g is a part of.
    Members of the nearest one's component (core) need no links with each other, so each side's least number of common
    differences follows from the least R of the other side; short: is x also in the shorter list that links within the
    rest need? A part without core has the short ones alone.
    """
    most = rows.select("g", "n", F.explode("d").alias("x")).groupBy("g", "x").agg(F.count("*").alias("c"), F.first("n").alias("n")).filter(2 * F.col("c") > F.col("n"))
    most = most.groupBy("g").agg(F.collect_list("x").alias("m")).coalesce(tasks)
    m = F.coalesce("m", F.array().cast("array<long>"))
    rows = _per_group(rows, most, work, f"{label}-most", "left").select("g", "u", "size", "component", F.concat(F.array_except("d", m), F.array_except(m, "d")).alias("d"), F.array_except("skip", m).alias("skip"))
    rows = work.save(rows.withColumn("r", _r(percent, F.col("d"), F.col("size"))).coalesce(tasks), f"{label}-shifted")
    best = rows.groupBy("g").agg(F.min(F.struct("r", "u", "component")).alias("best")).coalesce(tasks)
    near = _per_group(rows, best, work, f"{label}-best")
    linked = F.col("r") + F.col("best.r") <= 0
    links = work.save(near.filter(linked & (F.col("u") != F.col("best.u"))).select("u", F.col("best.u").alias("v")), f"{label}-nearest")

    near = near.withColumn("core", linked | (F.col("component") == F.col("best.component"))).withColumn("side", F.when(F.col("core"), F.col("best.component")).otherwise(F.col("component")))
    near = near.withColumn("order", F.transform(F.array_except("d", "skip"), lambda x: F.struct(F.lit(0).cast("long").alias("f"), x.alias("x")))).drop("best")
    near = _pruned(near, percent, work, label, tasks)

    def lists(rows: DataFrame, name: str) -> DataFrame:
        """(g, u, first, use: (at, x, short) of those in first that a part may need) of rows with an order of (f, x, held)."""
        rows = rows.withColumn("order", F.slice("order", F.lit(1), F.size("order") - F.col("need") + 1)).withColumn("n_short", F.when(F.col("core"), 0).otherwise(F.size("order") + F.col("need") - F.col("need2")))
        marked = F.transform("order", lambda e, i: F.struct(i.alias("at"), e["x"].alias("x"), (i < F.col("n_short")).alias("short"), e["held"].alias("held")))
        return work.save(rows.select("g", "u", F.col("order.x").alias("first"), F.filter(marked, lambda e: e["short"] | e["held"]).alias("use")).coalesce(tasks), f"{label}-{name}")

    # The core first: only its lists tell which differences beyond the shorter ones the rest can meet it in.
    fields = ["g", "u", "core", "need", "need2"]
    core = lists(near.filter("core").select(*fields, F.transform("order", lambda e: F.struct(e["f"].alias("f"), e["x"].alias("x"), F.lit(True).alias("held"))).alias("order")), "core")
    held = work.save(core.select("g", F.explode("first").alias("x")).distinct().withColumn("held", F.lit(True)).coalesce(tasks), f"{label}-held")
    held = F.broadcast(held) if held.count() <= BROADCAST_KEYS // 2 else held
    items = near.filter("not core").select(*fields, F.inline("order")).join(held, ["g", "x"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    others = items.groupBy("g", "u").agg(*(F.first(c).alias(c) for c in fields[2:]), F.sort_array(F.collect_list(F.struct("f", "x", "held"))).alias("order"))
    rest = work.save(near.drop("order", "side").join(core.unionByName(lists(others, "others")), ["g", "u"]).coalesce(tasks), f"{label}-rest")

    parts = rest.select("g", "u", "r", "component", "core", "need", "need2", F.explode("use").alias("e")).select("g", "u", "r", "component", "core", "need", "need2", "e.at", "e.x", "e.short")
    parts = work.save(parts.coalesce(tasks), f"{label}-items")
    short = F.when(F.col("short"), F.col("component"))
    sizes = parts.groupBy("g", "x").agg(F.count("*").alias("n"), F.count_if("core").alias("c"), F.count_if("short").alias("s"), F.min(short).alias("low"), F.max(short).alias("high"))
    sizes = sizes.filter("(c > 0 and n > c) or low < high").select("g", "x", "c", F.when(F.col("c") > 0, F.col("n")).otherwise(F.col("s")).alias("n")).coalesce(tasks)
    parts = parts.join(sizes, ["g", "x"]).filter("c > 0 or short").drop("c")
    return links, rest, work.save(parts.coalesce(tasks), f"{label}-parts")


def _paired_parts(parts: DataFrame, rest: DataFrame, percent: int, work: Workspace, label: str, tasks: int) -> DataFrame:
    """Links between the members of small parts. Pairs are counted by common parts first; those that may still have
    enough common differences, which are in large parts or beyond the shorter list otherwise, meet their differences."""
    large = parts.filter(F.col("n") > PAIRED).groupBy("g", "u").agg(F.count("*").alias("large"))
    one = parts.filter(F.col("n") <= PAIRED).join(large, ["g", "u"], "left").select("g", "x", "u", "r", "component", "core", "need", "need2", "short", F.coalesce("large", F.lit(0)).alias("large")).coalesce(tasks)
    two = one.select("g", "x", *(F.col(c).alias(f"{c}_2") for c in one.columns[2:]))
    across = F.col("core") != F.col("core_2")
    pairs = one.join(two, ["g", "x"]).filter((F.col("u") < F.col("u_2")) & (F.col("component") != F.col("component_2")) & (across | (F.col("short") & F.col("short_2"))))
    beyond = F.when(across, F.greatest("need", "need_2")).otherwise(F.greatest("need2", "need2_2")) - 1 + F.least("large", "large_2")
    pairs = pairs.groupBy("g", "u", "u_2").agg(F.count("*").alias("q"), F.first(beyond).alias("beyond"), F.first(_least(percent, F.col("r") + F.col("r_2"))).alias("least"))
    pairs = work.save(pairs.filter(F.col("q") + F.col("beyond") >= F.col("least")).select("g", "u", "u_2", "least").coalesce(tasks), f"{label}-pairs")
    met = pairs.join(rest.select("g", "u", "d"), ["g", "u"]).coalesce(tasks).join(rest.select("g", F.col("u").alias("u_2"), F.col("d").alias("d_2")), ["g", "u_2"])
    return work.save(met.filter(F.size(F.array_intersect("d", "d_2")) >= F.col("least")).select("u", F.col("u_2").alias("v")).distinct().coalesce(tasks), f"{label}-paired")


def near_links(members: DataFrame, ids: DataFrame, links: DataFrame, texts: DataFrame, n: int, percent: int, work: Workspace, tasks: int) -> DataFrame:
    """(node, component) once all links between members (bucket, doc_id) of a bucket are found, beginning with links."""
    found = components(links, work, "first-components")
    pairs = _groups(members, found, ids, work, tasks)
    rows = work.save(_differences(pairs, texts, n, tasks).select(F.col("v").alias("g"), "u", "size", "d", F.array().cast("array<long>").alias("skip")), "differences")
    live = work.save(_divided(rows, found, work, "groups-0", tasks), "live-0")
    dense = (F.col("n") <= DENSE) & (F.col("total") <= DENSE_ITEMS) & (F.col("n") * F.col("n") * F.col("total") <= DENSE_WORK)
    links = work.save(_paired(live.filter(~dense & (F.col("n") <= PAIRED)), percent).distinct().coalesce(tasks), "paired")
    k = 0
    while True:
        links = links.unionByName(work.save(_dense(live.filter(dense), percent).distinct().coalesce(tasks), f"dense-{k}"))
        live = live.filter(~dense & (F.col("n") > PAIRED))
        large = live.limit(1).count() > 0
        if large:
            label = f"level-{k}"
            nearest, rest, parts = _narrowed(live, percent, work, label, tasks)
            links = links.unionByName(nearest).unionByName(_paired_parts(parts, rest, percent, work, label, tasks))
        if links.limit(1).count():
            found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links), work, f"components-{k}")
        if not large:
            return found
        k += 1
        rows = parts.filter(F.col("n") > PAIRED).select("g", "u", "x", "at").join(rest.select("g", "u", "size", "d", "skip", "first"), ["g", "u"])
        rows = rows.select(F.xxhash64("g", "x").alias("g"), "u", "size", "d", F.concat("skip", F.slice("first", F.lit(1), F.col("at"))).alias("skip"))
        live = work.save(_divided(rows, found, work, f"groups-{k}", tasks), f"live-{k}")
        links = links.limit(0)


def _named(df: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """df (doc_id, th, ...) with node, the number under which the text takes part: its id where that has one text."""
    own = F.col("doc_id")
    if repeated is not None:
        clash = repeated.filter("low < high").select(F.col("doc_id").alias("_id"), F.col("low").alias("_low"))
        df = df.join(clash, F.col("doc_id") == F.col("_id"), "left")
        own = F.when(F.col("_id").isNull() | (F.col("th") == F.col("_low")), F.col("doc_id"))
    other = F.lit(UNNAMED) + F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("th")).bitwiseAND(F.lit(UNNAMED - 1))
    return df.withColumn("node", F.coalesce(own, other)).drop("_id", "_low")


def classes(docs: DataFrame, n: int, percent: int, bands: int, rows: int, key: str, text: str, work: Workspace, by_id: bool) -> tuple[DataFrame, DataFrame | None]:
    """((doc_id, th, n_shingles, node, component) of each row of docs, rows that repeat: (doc_id, low, high: of th)).

    by_id: all texts of one id are one document.
    """
    every = work.save(signatures(docs, n, bands, rows, key, text), "signatures")
    repeated = work.save(every.filter("n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("c"), F.min("th").alias("low"), F.max("th").alias("high")).filter("c > 1").drop("c"), "repeated")
    many = repeated.count()
    repeated = (F.broadcast(repeated) if many <= BROADCAST_KEYS // 2 else repeated) if many else None
    every = _named(every, repeated)
    some = every.filter("n_shingles > 0")
    equal = work.save(some.groupBy("s1", "s2").agg(F.min("node").alias("rep"), F.count("*").alias("c")).filter("c > 1").select("s1", "s2", "rep"), "equal")
    equal = F.broadcast(equal) if equal.count() <= BROADCAST_KEYS // 2 else equal

    # Buckets of representatives that have more than one.
    reps = some.join(equal, ["s1", "s2"], "left").filter("rep is null or rep = node").select(F.col("node").alias("doc_id"), "keys", "sig")
    reps = reps.dropDuplicates(["doc_id"]) if many else reps
    band = reps.select("doc_id", F.explode("keys").alias("bucket"))
    draw = [F.min(F.struct(F.xxhash64(F.lit(k), "bucket", "doc_id"), "doc_id"))["doc_id"].alias(f"leader{k}") for k in range(ORDERS)]
    shared = band.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"), *draw).filter("low < high").drop("low", "high")
    members = work.save(band.join(shared, "bucket"), "members")
    ids = work.save(members.groupBy("doc_id").agg(F.sum("n").alias("weight")), "ids")
    n_ids = ids.count()
    near = F.broadcast(ids.select("doc_id")) if n_ids <= BROADCAST_KEYS else ids.select("doc_id")
    tasks = few_tasks(work.spark, MEMBER_TASKS + n_ids // TASK_MEMBERS)
    texts = _named(_plain(docs, key, text), repeated).select(F.col("node").alias("doc_id"), "text").join(near, "doc_id", "left_semi")
    texts = work.save(texts.dropDuplicates(["doc_id"]) if many else texts, "texts")
    sigs = reps.join(near, "doc_id", "left_semi").select("doc_id", "sig")

    met = members.select("doc_id", F.explode(F.array_distinct(F.array(*(f"leader{k}" for k in range(ORDERS))))).alias("leader")).filter("doc_id <> leader")
    met = met.groupBy("doc_id", "leader").agg(F.count("*").alias("times"))
    best = met.groupBy("doc_id").agg(*(F.max_by("leader", F.struct("times", F.xxhash64(F.lit(k), "leader"))).alias(f"b{k}") for k in range(TRIES)))
    first = best.select(F.col("doc_id").alias("u"), F.explode(F.array_distinct(F.array(*(f"b{k}" for k in range(TRIES))))).alias("v"))
    likely = work.save(_likely(first, sigs, percent / 100, bands * rows, tasks), "likely")
    links = work.save(_verified(likely, texts, n, percent, tasks), "links")
    found = near_links(members, ids, links, texts, n, percent, work, tasks)

    owned = every.select("doc_id", "th", "n_shingles", "s1", "s2", "node").join(equal, ["s1", "s2"], "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "node")).otherwise(F.col("node")))
    if many and by_id:
        same = owned.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v"), F.collect_set("rep").alias("all")).filter("u < v")
        known = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
        found = components(known.unionByName(same.select("u", F.explode("all").alias("v"))), work, "by-id")
    found = found.withColumnRenamed("node", "rep")
    return owned.join(found, "rep", "left").select("doc_id", "th", "n_shingles", "node", F.coalesce("component", "rep").alias("component")), repeated


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text", work: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs; texts with at least percent of common n-grams are linked."""
    work = work or Workspace(docs.sparkSession, "neardup")
    since = len(work.saved)
    found, _ = classes(docs, n, percent, bands, rows, key, text, work, True)
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("component") < UNNAMED, F.col("component")))
    out = work.save(found.select("doc_id", "n_shingles", own.alias("component_id")), "near-duplicates")
    work.clear(since, "near-duplicates")
    return out


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs of each group of near-duplicates, that with the least id; one of rows that repeat an id and text."""
    work = Workspace(docs.sparkSession, "keep")
    found, repeated = classes(docs, n, percent, BANDS, ROWS, key, text, work, False)
    gone = work.save(found.filter("n_shingles > 0 and node <> component").select(F.col("doc_id").alias("_gone"), F.col("th").alias("_gone_th")).distinct(), "gone")
    again = work.save(found.groupBy("doc_id", "th").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("doc_id").alias("_again"), F.col("th").alias("_again_th")), "again")
    work.clear(0, "gone", "again")
    th = F.xxhash64(F.col(f"`{text}`"))
    is_in = lambda t: F.col(f"`{key}`").cast("long").eqNullSafe(F.col(t.columns[0])) & (th == F.col(t.columns[1]))
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_KEYS // 2 else t
    kept = docs.join(small(gone), is_in(gone), "left_anti")
    if not again.limit(1).count():
        return kept
    marked = kept.withColumn("_again_th", th)
    twice = marked.join(small(again.select("_again", F.col("_again_th").alias("_t"))), F.col(f"`{key}`").cast("long").eqNullSafe(F.col("_again")) & (F.col("_again_th") == F.col("_t")), "left_semi")
    return kept.join(small(again), is_in(again), "left_anti").unionByName(twice.dropDuplicates([key, "_again_th"]).drop("_again_th"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, n=2)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


#: Every pair of equal-shingle documents and the closure of their links; for small tables.
SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
c AS (SELECT min(doc_id) AS doc_id, g FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS e FROM c),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.e = b.e AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
k AS (SELECT s.doc_id AS u, c.doc_id AS v FROM s JOIN c ON list_sort(s.g) = c.g AND s.doc_id <> c.doc_id),
e AS (SELECT u, v FROM p UNION SELECT v, u FROM p UNION SELECT u, v FROM k UNION SELECT v, u FROM k),
r AS (SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
m AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT m.doc_id, len(s.g) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m JOIN s ON s.doc_id = m.doc_id
"""
