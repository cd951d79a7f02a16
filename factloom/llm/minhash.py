"""Near-duplicate documents by min-max hashing, with links confirmed on full shingle sets.

Every permutation of the shingle hashes gives two values, its minimum and its maximum, so half as many permutations
fill a signature. Bands of the signature are bucket keys. Texts with equal sets are one class; classes are compared

1. with one representative of each bucket (a star), and then
2. in buckets that still hold several components, across components: first by signatures alone, and only those that may
   be similar by their whole sets, in the same blocks, which return links and no pairs.

No bucket is capped. A task holds two blocks, bounded by documents and by shingles; the members of a bucket's largest
component meet the others only, not each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pretokens as P
from .common import components, forget, free, grouped, keep, lookup
from .shingles import mix, shingle_sets

#: 64 permutations give 128 values; 25 bands of 5. A pair with similarity 0.85 misses all of them once in two million times.
PERMUTATIONS, BANDS, ROWS = 64, 25, 5
#: Below 0.85: 32 bands of 4. A pair with similarity 0.8 misses all of them less than once in ten million times.
WIDE_BANDS, WIDE_ROWS = 32, 4
SIMILAR = 85
#: The chance at most with which the signatures of a pair that is just similar enough agree in too few places to be compared by
#: their sets, for independent places; the minimum and maximum of one permutation are nearly so.
CHANCE = 1e-13
#: Documents and shingles of a block.
BLOCK, SHINGLES = 256, 1 << 20
#: Bytes of text hashed at a time.
PIECE = 2 << 20
#: Members of a star that one copy of its representative's set meets.
STAR = 512
#: Words of the bit table that marks the documents whose sets are needed (64 bits each).
MARKS = 1 << 20

_random = np.random.Generator(np.random.PCG64(977))
_MULTIPLY = _random.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 64, PERMUTATIONS, np.uint64)


def signatures(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, 2 * PERMUTATIONS): 16 bits of the minima and maxima of each permutation, alternating. Sets must not be empty."""
    out = np.empty((len(offsets) - 1, 2 * PERMUTATIONS), np.uint16)
    at = offsets[:-1]
    for k in range(PERMUTATIONS):
        x = flat * _MULTIPLY[k] + _ADD[k]
        out[:, 2 * k] = mix(np.minimum.reduceat(x, at)) >> np.uint64(48)
        out[:, 2 * k + 1] = mix(np.maximum.reduceat(x, at)) >> np.uint64(48)
    return out


def banding(similar: int) -> tuple[int, int]:
    return (BANDS, ROWS) if similar >= SIMILAR else (WIDE_BANDS, WIDE_ROWS)


def band_keys(sig: Column, similar: int) -> Column:
    """Bucket keys of a signature column: a hash of each band's bytes and of its number."""
    bands, rows = banding(similar)
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda t: F.xxhash64(F.substring(sig, t * (2 * rows) + 1, F.lit(2 * rows)), t))


def least_agreement(similar: int) -> int:
    """Equal places that the signatures of similar sets have: the binomial's lower tail below it is at most CHANCE."""
    s, n = similar / 100, 2 * PERMUTATIONS
    tail, k = 0.0, 0
    while (tail := tail + math.comb(n, k) * s**k * (1 - s) ** (n - k)) <= CHANCE:
        k += 1
    return max(1, k)


def _set_keys(flat: np.ndarray, edges: np.ndarray) -> pa.Array:
    """128 bits of each set, as binary."""
    two = np.empty((len(edges) - 1, 2), np.uint64)
    if len(two):
        two[:, 0] = np.add.reduceat(mix(flat), edges[:-1])
        two[:, 1] = np.add.reduceat(mix(flat ^ np.uint64(0x9E3779B97F4A7C15)), edges[:-1])
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(two), [None, pa.py_buffer(two.tobytes())]).cast(pa.binary())


def _spread(values: pa.Array, full: np.ndarray, n: int) -> pa.Array:
    """values at the places ``full`` of n rows, null elsewhere."""
    at = np.full(n, -1)
    at[full] = np.arange(len(full))
    return values.take(pa.array(at, mask=at < 0))


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text_hash, n_shingles, set_key (128 bits of the set, null if empty), sig (null if empty)."""
    kind = docs.schema[key].dataType.simpleString()

    def hashed(batches):
        for batch in batches:
            for at, to in P.pieces_of(batch.column(2), PIECE):
                flat, offsets = shingle_sets(batch.column(2).slice(at, to - at))
                n = np.diff(offsets)
                full = np.flatnonzero(n > 0)
                edges = np.append(offsets[:-1][full], len(flat))
                sig = signatures(flat, edges) if len(full) else np.zeros((0, 2 * PERMUTATIONS), np.uint16)
                wide = 4 * PERMUTATIONS
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(wide), len(sig), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(n), _spread(_set_keys(flat, edges), full, len(n)), _spread(rows, full, len(n))],
                    [key, "text_hash", "n_shingles", "set_key", "sig"],
                )
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(key), F.xxhash64(text).alias("text_hash"), F.col(text))
    return rows.mapInArrow(hashed, f"`{key}` {kind}, text_hash long, n_shingles long, set_key binary, sig binary")


def full_sets(docs: DataFrame, text: str) -> DataFrame:
    """id (the set's key), shingles: the whole distinct sets as array<long>, those that aren't empty."""

    def hashed(batches):
        for batch in batches:
            for at, to in P.pieces_of(batch.column(0), PIECE):
                flat, offsets = shingle_sets(batch.column(0).slice(at, to - at))
                full = np.flatnonzero(np.diff(offsets) > 0)
                edges = np.append(offsets[:-1][full], len(flat))
                yield pa.RecordBatch.from_arrays([_set_keys(flat, edges), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.view(np.int64)))], ["id", "shingles"])
            pa.default_memory_pool().release_unused()

    return docs.select(text).mapInArrow(hashed, "id binary, shingles array<long>")


def marked(docs: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Those rows of docs whose key may be in ``wanted`` (key): all that are, and as few others as a bit table of a fixed
    size tells apart. The table is broadcast (MARKS rows of two numbers at most, 16 MB), so the texts aren't shuffled."""
    h = F.xxhash64(key)
    word, bit = F.pmod(h, F.lit(MARKS)), F.pmod(F.shiftright(h, 24), F.lit(64)).cast("int")
    [at, mask] = free(docs.columns, "word", "bits")
    own = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = wanted.select(word.alias(at), own.alias(mask)).groupBy(at).agg(F.bit_or(mask).alias(mask))
    return docs.join(F.broadcast(bits), (word == F.col(at)) & (F.col(mask).bitwiseAND(own) != 0), "left_semi")


def similar_enough(both: Column, x: Column, y: Column, similar: int) -> Column:
    return 100 * both >= similar * (x + y - both)


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Those (a, b) whose full sets are similar: 100 * intersection >= similar * union. A set ``a`` that has many pairs is
    copied once for each STAR of them. ``pairs`` is a stored table."""
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("copies"), F.count("*").alias("n"))
    many = copies.where("copies > 1")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")).join(copies.drop("n"), "a")
    left = left.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    dealt = lookup(pairs, many, "a", "n", pairs.rows).withColumn("copy", F.coalesce(F.pmod(F.xxhash64("b"), F.col("copies")), F.lit(0)).cast("int")).drop("copies", "n")
    x = dealt.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(left, ["a", "copy"])
    both = F.size(F.array_intersect("x", "y"))
    # sizes alone rule out many pairs before anything is intersected
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    return x.where(100 * small >= similar * large).where(similar_enough(both, F.size("x"), F.size("y"), similar)).select("a", "b")


def _find(parent: dict, c):
    while parent[c] != c:
        parent[c] = parent[parent[c]]
        c = parent[c]
    return c


def across(members: DataFrame, reps: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Links between roots (a, b): all that the buckets' members (band, id, root) of different roots have, or enough to unite them.

    In each bucket the members outside its largest component are dealt to blocks i, all members to blocks j, and each
    (i, j) is a group. Pass one compares signatures and returns the members that may be similar to one of another root;
    pass two compares the sets of those, in the same groups.
    """
    bands, rows = banding(similar)
    agree = least_agreement(similar)
    sized = members.join(reps.select("id", "n_shingles"), "id")
    by_root = sized.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    by_band = by_root.groupBy("band").agg(
        F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("m").alias("m"), F.max("m").alias("m_top")
    ).where("roots > 1")
    blocks = lambda n, m: F.greatest(F.ceil(n / BLOCK), F.ceil(m / SHINGLES), F.lit(1)).cast("int")
    by_band = by_band.select("band", F.col("top.root").alias("largest"), "n", blocks(F.col("n") - F.col("top.n"), F.col("m") * (F.col("n") - F.col("top.n")) / F.col("n")).alias("bi"), blocks(F.col("n"), F.col("m")).alias("bj"))
    open_ = lookup(members, by_band, "band", "n", members.rows).where("largest is not null")
    both = F.array(F.when(F.col("root") != F.col("largest"), F.lit(0)), F.lit(1))
    open_ = open_.withColumn("side", F.explode(F.filter(both, lambda x: x.isNotNull())))
    own = F.when(F.col("side") == 0, F.pmod(F.xxhash64("id", F.lit(1)), F.col("bi"))).otherwise(F.pmod(F.xxhash64("id", F.lit(2)), F.col("bj"))).cast("int")
    turns = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("bj")).otherwise(F.col("bi")) - 1)
    dealt = open_.withColumn("own", own).withColumn("other", F.explode(turns))
    i, j = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    dealt = dealt.select("band", i.alias("i"), j.alias("j"), "side", "id", "root").join(reps.select("id", "n_shingles", "sig"), "id")
    dealt = dealt.select("band", "i", "j", "side", "id", "root", "n_shingles", "sig")

    def sides(g):
        side = g.column(3).to_numpy(zero_copy_only=False)
        return np.flatnonzero(side == 0), np.flatnonzero(side == 1)

    def by_signature(batches):
        for g in grouped(batches, ["band", "i", "j"]):
            left, right = sides(g)
            _, root = np.unique(np.array(g.column(5).to_pylist(), dtype=object), return_inverse=True)
            n = g.column(6).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(g.column(7).to_pylist()), np.uint16).reshape(g.num_rows, -1)
            hit = np.zeros(g.num_rows, bool)
            for x in left.tolist():
                y = right[root[right] != root[x]]
                y = y[100 * np.minimum(n[y], n[x]) >= similar * np.maximum(n[y], n[x])]
                y = y[(sig[y] == sig[x]).sum(1) >= agree]
                hit[y] = True
                hit[x] |= len(y) > 0
            if hit.any():
                yield g.select(["band", "i", "j", "side", "id", "root"]).filter(pa.array(hit))

    deal = ["band", "i", "j"]
    kind = "band long, i int, j int, side int, id binary, root binary"
    maybe = keep(dealt.repartition(*deal).sortWithinPartitions(*deal).mapInArrow(by_signature, kind), "maybe")
    whole = maybe.join(sets, "id").select(*deal, "side", "id", "root", "shingles")

    def by_sets(batches):
        for g in grouped(batches, deal):
            left, right = sides(g)
            roots = g.column(5).to_pylist()
            parent: dict = {r: r for r in roots}
            lists = g.column(6)
            edges, flat = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            n = np.diff(edges)
            out = []
            for x in left.tolist():
                mine = flat[edges[x] : edges[x + 1]]
                for y in right[100 * np.minimum(n[right], n[x]) >= similar * np.maximum(n[right], n[x])].tolist():
                    one, two = _find(parent, roots[x]), _find(parent, roots[y])
                    if one == two:
                        continue
                    theirs = flat[edges[y] : edges[y + 1]]
                    at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                    common = int((mine[at] == theirs).sum())
                    if 100 * common >= similar * (len(mine) + len(theirs) - common):
                        parent[max(one, two)] = min(one, two)
                        out.append((min(one, two), max(one, two)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["a", "b"])

    return whole.repartition(*deal).sortWithinPartitions(*deal).mapInArrow(by_sets, "a binary, b binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: int = SIMILAR) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept, text_hash (xxhash64 of the text).

    Documents of equal sets are one class; classes are linked as described above and component_id is the smallest key
    reachable by links. kept: key = component_id.

    Null or wordless text: an empty set, linked with nothing, kept. Fewer than five words: one shingle. Long texts are
    hashed whole. A null key is linked with nothing: component_id null, kept true. Rows that repeat a key are documents of
    their own; if they repeat the text too, they share the class and both are kept or not. Ties can't occur: keys
    decide. An empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select(F.col(key), F.col(text))
    prints = keep(fingerprints(docs, key, text), "minhash")
    usable = prints.where(F.col(key).isNotNull() & F.col("set_key").isNotNull())
    groups = keep(usable.groupBy("set_key").agg(F.min(key).alias("first"), F.count("*").alias("rows")), "classes")
    rows = prints.rows
    # a class is represented by its first key's row; classes of one row are their own
    copied = groups.where("rows > 1")
    marked_rows = lookup(usable.select(F.col(key).alias("k"), "set_key", "n_shingles", "sig"), copied, "set_key", "rows", rows)
    reps = marked_rows.where(F.col("first").isNull() | (F.col("k") == F.col("first"))).select(F.col("set_key").alias("id"), "k", "n_shingles", "sig")
    reps = keep(reps.dropDuplicates(["id"]), "reps")
    banded = reps.select("id", F.explode(band_keys(F.col("sig"), similar)).alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    members = keep(lookup(banded, shared, "band", "n", rows * banding(similar)[0]).where("n is not null").select("band", "id", "rep"), "buckets")
    needed = members.select("id").distinct().join(reps.select("id", "k"), "id").select(F.col("k").alias(key))
    sets = keep(full_sets(marked(docs, key, needed), text).dropDuplicates(["id"]), "sets")
    star = keep(members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "star")
    links = keep(confirmed(star, sets, similar), "links")
    roots = keep(components(links), "roots")
    placed = members.select("band", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    placed = keep(placed.select("band", "id", F.coalesce("root", "id").alias("root")), "placed")
    more = keep(across(placed, reps, sets, similar), "links")
    united = components(more)  # of roots
    final = placed.select("id", "root").distinct().join(united.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("top"))
    # the smallest key of each component, back to its classes
    named = keep(final.join(groups.select(F.col("set_key").alias("id"), "first", "rows"), "id"), "named")
    least = named.groupBy("top").agg(F.min("first").alias("component"), F.count("*").alias("n"))
    classes = lookup(named, least, "top", "n", rows).select(F.col("id").alias("set_key"), "component", "rows")
    alone = copied.select("set_key", F.col("first").alias("component"), "rows").join(classes.select("set_key"), "set_key", "left_anti")
    known = keep(classes.unionByName(alone), "components")
    for table in (members, star, links, roots, placed, more, groups, sets, reps, named):
        forget(table)
    out = lookup(prints.drop("sig"), known, "set_key", "rows", rows)
    component = F.when(F.col(key).isNotNull(), F.coalesce("component", key))
    return out.select(key, "n_shingles", component.alias("component_id"), "text_hash").select(key, "n_shingles", "component_id", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")
