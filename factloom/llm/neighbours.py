"""Near-duplicate vectors by NN-descent.

The neighbour graph starts from blocks of vectors that agree in the signs of a few random projections and is refined by
joining neighbours of neighbours until few lists change. Lists have K entries. A vector whose list is full of links is
saturated: its list is enlarged to its whole component, compared in blocks that only return counts. Recall is audited
against brute force on a bounded sample of vectors; below the bar, more blocks and rounds follow, and in the end all
vectors are compared in blocks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, fan_out, forget, free, grouped, keep, lookup

K, REVERSE = 10, 10
TABLES, BLOCK = 8, 512
#: Rounds of refinement at most, and the share of changed entries under which they end.
ROUNDS, CHANGED = 4, 0.01
#: Vectors compared with all others to audit recall, the bar, and how often the search may start again below it.
AUDIT, RECALL, AGAIN = 512, 0.98, 2
#: Vectors of a block when a dense component is compared as a whole.
DENSE = 256


def unit_rows(column: pa.Array) -> list[bytes | None]:
    """Unit vectors in double precision, as bytes; None for null, zero or non-finite vectors."""
    out: list[bytes | None] = []
    for x in column:
        values = x.values if x.is_valid else None
        if values is None or len(values) == 0 or values.null_count:
            out.append(None)
            continue
        v = values.to_numpy(zero_copy_only=False).astype(np.float64)
        largest = np.abs(v).max()
        if not np.isfinite(largest) or largest == 0:
            out.append(None)
            continue
        v = v / largest  # no overflow or underflow of squares
        out.append((v / math.sqrt(float(v @ v)) + 0.0).tobytes())
    return out


def prepared(table: DataFrame, key: str, vector: str) -> DataFrame:
    """key, ck (digest of the unit vector and its length; null if unusable), unit (binary)."""
    kind = table.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            units = unit_rows(batch.column(1))
            digests = [None if u is None else f"{len(u)}-{hashlib.md5(u).hexdigest()}" for u in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(units, pa.binary())], [key, "ck", "unit"])

    return table.select(key, vector).mapInArrow(run, f"`{key}` {kind}, ck string, unit binary")


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def forest(similar: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean symmetric matrix: enough links for its components, no more than rows."""
    left = similar.any(1)
    out: list[tuple[int, int]] = []
    for s in np.flatnonzero(left).tolist():
        if not left[s]:
            continue
        left[s] = False
        queue = [s]
        while queue:
            a = queue.pop()
            found = np.flatnonzero(similar[a] & left)
            left[found] = False
            out += [(a, b) for b in found.tolist()]
            queue += found.tolist()
    return out


EDGE = "u long, v long, s double"


def edge_batch(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["u", "v", "s"])


def tables_for(bits: int, threshold: float) -> int:
    """Sign tables of a turn: a pair at the threshold shares a block of one of them with a chance of RECALL at least."""
    meet = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return TABLES if meet >= 1 else max(TABLES, math.ceil(math.log(1 - RECALL) / math.log(1 - meet)))


def start(nodes: DataFrame, n: int, threshold: float, seed: int, k: int) -> DataFrame:
    """(u, v, s): each vector's k best within its blocks, and the links of the blocks' components."""
    bits = max(0, math.ceil(math.log2(max(1, n / (BLOCK / 2)))))
    random = np.random.Generator(np.random.PCG64(seed))
    tables = tables_for(bits, threshold)
    seeds = [int(x) for x in random.integers(0, 1 << 31, tables)]

    def place(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.array([len(x) for x in batch.column(1).to_pylist()])
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                x = matrix(batch.column(1).take(pa.array(rows)))
                ids = batch.column(0).take(pa.array(rows))
                for t, s in enumerate(seeds):
                    if (size, t) not in planes:
                        planes[size, t] = np.random.Generator(np.random.PCG64(s)).standard_normal((size // 8, max(bits, 1)))
                    sign = (x @ planes[size, t]) > 0
                    cell = (sign[:, :bits] @ (1 << np.arange(bits, dtype=np.int64))) if bits else np.zeros(len(rows), np.int64)
                    cell = (cell * tables + t) * 4096 + size // 8 % 4096
                    yield pa.RecordBatch.from_arrays([ids, pa.array(cell.astype(np.int64))], ["id", "cell"])

    def best(batches):
        for group in grouped(batches, ["cell", "part"]):
            ids = group.column(0).to_numpy(zero_copy_only=False)
            if len(ids) < 2:
                continue
            for at in range(0, len(ids), 2 * BLOCK):
                own = ids[at : at + 2 * BLOCK]
                if len(own) < 2:
                    continue
                x = matrix(group.column(1).slice(at, len(own)))
                s = x @ x.T
                np.fill_diagonal(s, -2.0)
                few = min(k, len(own) - 1)
                top = np.argpartition(-s, few - 1, axis=1)[:, :few]
                value = np.take_along_axis(s, top, 1)
                yield edge_batch(np.repeat(own, few), own[top.reshape(-1)], value.reshape(-1))
                tree = np.array(forest(s >= threshold), np.int64).reshape(-1, 2)
                if len(tree):
                    a, b = tree.T
                    yield edge_batch(np.concatenate([own[a], own[b]]), np.concatenate([own[b], own[a]]), np.concatenate([s[a, b], s[a, b]]))

    cells = keep(nodes.select("id", "unit").mapInArrow(place, "id long, cell long"), "cells")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    parts = lookup(cells, sizes, "cell", "n", tables * n).withColumn("part", F.pmod(F.xxhash64("id", "cell"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    full = parts.select("id", "cell", "part").join(nodes.select("id", "unit"), "id").select("id", "unit", "cell", "part")
    return full.repartition("cell", "part").sortWithinPartitions("cell", "part", "id").mapInArrow(best, EDGE)


def best_of(edges: DataFrame, k: int) -> DataFrame:
    """Per u the k best distinct v."""
    one = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    return one.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))).where(F.col("r") <= k).select("u", "v", "s")


def refine(lists: DataFrame, nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    """Joins neighbours of neighbours: (u, v, s) better than u's worst entry, and links."""
    order = Window.partitionBy("v").orderBy(F.xxhash64("u", "v"), "u")
    reverse = lists.withColumn("r", F.row_number().over(order)).where(F.col("r") <= REVERSE).select(F.col("v").alias("c"), F.col("u").alias("x"))
    member = lists.select(F.col("u").alias("c"), F.col("v").alias("x")).union(reverse).distinct()
    worst = lists.groupBy("u").agg(F.min("s").alias("worst"), F.count("*").alias("n")).select(F.col("u").alias("x"), F.when(F.col("n") >= k, F.col("worst")).otherwise(-2.0).alias("worst"))
    full = member.join(worst, "x", "left").join(nodes.select(F.col("id").alias("x"), "unit"), "x").select("c", "x", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "unit")

    def run(batches):
        us, vs, ss, held = [], [], [], 0
        for group in grouped(batches, ["c"]):
            sizes = {len(u) for u in group.column(3).to_pylist()}
            if group.num_rows < 2 or len(sizes) > 1:
                continue
            ids, worst_ = group.column(1).to_numpy(zero_copy_only=False), group.column(2).to_numpy(zero_copy_only=False)
            x = matrix(group.column(3))
            s = x @ x.T
            np.fill_diagonal(s, -3.0)
            a, b = np.nonzero(s > worst_[:, None])
            us.append(ids[a])
            vs.append(ids[b])
            ss.append(s[a, b])
            held += len(a)
            if held > 200_000:
                yield edge_batch(np.concatenate(us), np.concatenate(vs), np.concatenate(ss))
                us, vs, ss, held = [], [], [], 0
        if held:
            yield edge_batch(np.concatenate(us), np.concatenate(vs), np.concatenate(ss))

    return full.repartition("c").sortWithinPartitions("c", "x").mapInArrow(run, EDGE)


def dealt_blocks(members: DataFrame) -> DataFrame:
    """Members (root, id, weight, unit) of each root, dealt out sorted as pairs (i, j) of blocks of about DENSE vectors."""
    sizes = members.groupBy("root").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / DENSE).cast("int")
    placed = lookup(members, sizes, "root", "n", members.count()).withColumn("blocks", blocks)
    placed = placed.withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "id", "weight", "unit")
    return dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "id")


def dense_links(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links enough for the components of all members, every pair of a root compared."""

    def run(batches):
        for g in grouped(batches, ["root", "i", "j"]):
            b, i = g.column(3).to_numpy(zero_copy_only=False), g.column(1)[0].as_py()
            ids, x = g.column(4).to_numpy(zero_copy_only=False), matrix(g.column(6))
            left, right = np.flatnonzero(b == i), np.flatnonzero(b == g.column(2)[0].as_py())
            for at in range(0, len(left), DENSE):
                for to in range(0, len(right), DENSE):
                    own = np.unique(np.concatenate([left[at : at + DENSE], right[to : to + DENSE]]))
                    s = x[own] @ x[own].T >= threshold
                    np.fill_diagonal(s, False)
                    tree = np.array(forest(s | s.T), np.int64).reshape(-1, 2)
                    if len(tree):
                        one, two = ids[own[tree[:, 0]]], ids[own[tree[:, 1]]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])

    return dealt_blocks(members).mapInArrow(run, "a long, b long").distinct()


def dense_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links): weighted links of every member of the given components (root, id, weight, unit), compared in blocks."""

    def run(batches):
        for g in grouped(batches, ["root", "i", "j"]):
            b = g.column(3).to_numpy(zero_copy_only=False)
            i, j = g.column(1)[0].as_py(), g.column(2)[0].as_py()
            ids, w = g.column(4).to_numpy(zero_copy_only=False), g.column(5).to_numpy(zero_copy_only=False)
            x = matrix(g.column(6))
            left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
            for at in range(0, len(left), DENSE):
                some = left[at : at + DENSE]
                s = x[some] @ x[right].T >= threshold
                if i == j:
                    s[np.arange(len(some)), at + np.arange(len(some))] = False
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[right]), pa.array((s * w[some][:, None]).sum(0))], ["id", "links"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array((s * w[right][None, :]).sum(1))], ["id", "links"])

    parts = dealt_blocks(members).mapInArrow(run, "id long, links long")
    return parts.groupBy("id").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, links: DataFrame, roots: DataFrame, dense: DataFrame, n: int, threshold: float, seed: int) -> tuple[float, int]:
    """(sum of the shares of links found, vectors) over at most about AUDIT vectors chosen by hash, against all vectors
    by brute force. A vector counts once, however many links it has. Links inside the components of ``dense``, which are
    compared as a whole, don't count; all others are found only if ``links`` (a < b) has them."""
    rate = min(1.0, AUDIT / max(1, n))
    chosen = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < rate * (1 << 30)
    rows = nodes.where(chosen).select("id", "unit").limit(4 * AUDIT).collect()
    if not rows:
        return 0.0, 0
    shared = nodes.sparkSession.sparkContext.broadcast([(r["id"], bytes(r["unit"])) for r in rows])

    def run(batches):
        by: dict[int, list] = {}
        for i, u in shared.value:
            by.setdefault(len(u), []).append((i, u))
        tables = {size: (np.array([i for i, _ in own]), np.frombuffer(b"".join(u for _, u in own), np.float64).reshape(len(own), -1)) for size, own in by.items()}
        for batch in batches:
            sizes = np.array([len(u) for u in batch.column(1).to_pylist()])
            for size, (ids, q) in tables.items():
                rows = np.flatnonzero(sizes == size)
                if len(rows):
                    own = batch.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False)
                    a, b = np.nonzero(q @ matrix(batch.column(1).take(pa.array(rows))).T >= threshold)
                    a, b = ids[a], own[b]
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["u", "v"])

    true = nodes.select("id", "unit").mapInArrow(run, "u long, v long")
    rooted = true.join(roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left").join(roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left")
    inner = rooted.join(dense.select(F.col("root").alias("ru"), F.lit(True).alias("whole")), "ru", "left")
    pairs = inner.where(~(F.coalesce("whole", F.lit(False)) & F.coalesce(F.col("ru") == F.col("rv"), F.lit(False))))
    pairs = pairs.select("u", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    marks = pairs.join(links.select("a", "b").distinct().withColumn("found", F.lit(1.0)), ["a", "b"], "left")
    own = marks.groupBy("u").agg(F.avg(F.coalesce("found", F.lit(0.0))).alias("share"))
    got = own.agg(F.sum("share").alias("f"), F.count("*").alias("t")).first()
    return float(got["f"] or 0), int(got["t"])


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, k: int = K) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Equal directions are one class; classes are the nodes of the search. All cosines are computed in double precision,
    so every link found is one. n_links counts vectors, copies included.

    Null, empty or zero vectors and those with null or non-finite components link with nothing. Vectors of different
    lengths don't meet. A null key: no links, component_id null, kept. Rows that repeat a key are vectors of their own, and
    each is returned with what its own vector links with. Ties: the smaller key stands first. Empty tables give an empty result. Other columns are ignored.
    The key must be an integer.
    """
    rows = keep(prepared(table.select(F.col(key).cast("long").alias(key), vector), key, vector), "vectors")
    first, key_of_root = free([key, "ck", "unit", "id", "weight", "links", "root"], "first", "key_of_root")
    groups = rows.where(F.col("ck").isNotNull() & F.col(key).isNotNull()).groupBy("ck").agg(F.min(key).alias(first), F.count("*").alias("weight"))
    # classes are numbered in order of (least key, digest): two that hold one key stay two nodes, and the least node of a
    # component has its least key
    groups = groups.repartitionByRange(fan_out(table.sparkSession), first, "ck").sortWithinPartitions(first, "ck").withColumn("id", F.monotonically_increasing_id())
    groups = keep(groups, "classes")
    classed = lookup(rows, groups, "ck", "weight", rows.rows).withColumn("id", F.when(F.col(key).isNotNull(), F.col("id")))
    classed = keep(classed, "classed")
    nodes = keep(classed.where(F.col(first) == F.col(key)).select("id", first, "weight", "unit").dropDuplicates(["id"]), "nodes")
    firsts = nodes.select(F.col("id").alias("root"), F.col(first).alias(key_of_root))
    nodes, n = nodes.drop(first), nodes.rows
    lists, links, roots = None, None, None
    for turn in range(AGAIN + 1):
        found = keep(start(nodes, n, threshold, turn, k), "start")
        both = found if lists is None else found.union(lists)
        lists = keep(best_of(both, k), "lists")
        link = lambda e: e.where(F.col("s") >= threshold).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        links = link(found) if links is None else links.union(link(found))
        for _ in range(ROUNDS):
            better = keep(refine(lists, nodes, threshold, k), "better")
            after = keep(best_of(lists.union(better), k), "lists")
            links = links.union(link(better))
            changed = after.join(lists, ["u", "v"], "left_anti").count()
            forget(lists)
            lists = after
            if changed <= CHANGED * k * n:
                break
        links = keep(links.distinct(), "vector-links")
        roots = keep(components(links), "vector-roots")
        # saturated lists: the whole component is compared
        full = lists.where(F.col("s") >= threshold).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("u").alias("node"))
        dense = keep(roots.join(full, "node", "left_semi").select("root").distinct(), "dense")
        got, there = audit(nodes, links, roots, dense, n, threshold, turn)
        if got >= RECALL * there:
            inside = keep(roots.join(dense, "root", "left_semi").join(nodes.withColumnRenamed("id", "node"), "node").select("root", F.col("node").alias("id"), "weight", "unit"), "inside")
            break
    else:
        # still below the bar: all vectors of a length are compared in blocks, which is exact
        inside = keep(nodes.select(F.octet_length("unit").cast("long").alias("root"), "id", "weight", "unit"), "inside")
        links = keep(dense_links(inside, threshold), "vector-links")
        roots = keep(components(links), "vector-roots")
    counted = dense_counts(inside, threshold)
    weight = nodes.select(F.col("id").alias("v"), "weight")
    thin = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    thin = thin.join(inside.select(F.col("id").alias("u")), "u", "left_anti").join(weight, "v").groupBy(F.col("u").alias("id")).agg(F.sum("weight").alias("links"))
    linked = keep(counted.union(thin).join(roots.select(F.col("node").alias("id"), "root"), "id", "left").join(firsts, "root", "left").drop("root"), "linked")
    out = classed.join(linked, "id", "left")
    own = F.coalesce(F.col("weight") - 1, F.lit(0))
    out = out.select(F.col(key), (F.coalesce("links", F.lit(0)) + own).cast("long").alias("n_links"), F.when(F.col(key).isNotNull(), F.coalesce(key_of_root, first, key)).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
