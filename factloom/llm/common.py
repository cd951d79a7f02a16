"""Shared pieces of the corpus operators: scratch tables, hot-key safe lookups, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import forget, free, keep, scratch_path, shared_dir

__all__ = ["components", "fan_out", "forget", "free", "grouped", "keep", "lookup", "scratch_path", "shared_dir"]

#: Keys with more rows than this share of the table get a broadcast lookup; by counting there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1e-4


def fan_out(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(df: DataFrame, rows: int) -> DataFrame:
    """Not more tasks than a table of so many narrow rows is worth; large tables keep all shuffle partitions."""
    tasks = max(12, rows // 20_000)
    return df.coalesce(tasks) if tasks < fan_out(df.sparkSession) else df


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join on key where right has one row a key. ``weight`` is right's column with the number of left rows of the key.

    Keys above HOT_SHARE of ``total`` rows are looked up by broadcast (fewer than 1 / HOT_SHARE rows, whatever
    the size of the table), so that no task receives all rows of a hot key; the others go through a shuffle join.
    Rows with a null key are kept, without a match.
    """
    bar = max(1000, int(total * HOT_SHARE))
    rest = [c for c in right.columns if c != key]
    hot_key, hot, cold_key, spread, cold = free([*left.columns, *right.columns], "hot_key", "hot", "cold_key", "spread", "cold")
    heavy = right.where(F.col(weight) > bar)
    light = right.where(F.col(weight) <= bar)
    marks = F.broadcast(heavy.select(F.col(key).alias(hot_key), F.struct(*rest).alias(hot)))
    both = left.join(marks, F.col(key) == F.col(hot_key), "left")
    # a row with a hot key goes anywhere: its shuffle key is replaced by nothing that matches
    both = both.withColumn(cold_key, F.when(F.col(hot_key).isNull(), F.col(key)))
    both = both.withColumn(spread, F.when(F.col(cold_key).isNull(), 1 + F.floor(F.rand(7) * 4096)).otherwise(F.lit(0)).cast("int"))
    # always 0, but no literal, which the optimizer would take out of the join's keys
    zero = F.pmod(F.xxhash64(key), F.lit(1)).cast("int")
    others = light.select(F.col(key).alias(cold_key), zero.alias(spread), F.struct(*rest).alias(cold))
    both = both.join(others, [cold_key, spread], "left")
    both = both.select(*[F.col(f"`{c}`") for c in left.columns], *[F.coalesce(F.col(f"{hot}.{c}"), F.col(f"{cold}.{c}")).alias(c) for c in rest])
    return few(both, total)


def components(nodes_in_edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links, any number of them -> (node, root): the smallest node reachable. Nodes without a link don't appear.

    Alternating large-star and small-star steps on the links; each step is an aggregation and a join on narrow rows,
    stored in the shared folder. A node's star is never gathered in one task: its minimum is a partial aggregate, looked
    up by ``lookup`` so that centres with very many links are broadcast.
    """
    links = keep(
        nodes_in_edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0"
    )
    step = 0
    while links.rows:
        step += 1
        # large star: every neighbour above u points to the smallest of u's neighbourhood
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = few(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), links.rows)
        large = lookup(both, low, "u", "n", 2 * links.rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = few(large, links.rows)
        # small star: every neighbour below u, and u itself, points to the smallest of them
        down = keep(large, f"{name}-{step}l")
        low = few(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), down.rows)
        # a node with one neighbour below keeps it; only the others are looked up
        several = low.where("n > 1")
        small = lookup(down, several, "u", "n", down.rows)
        small = small.select(F.when(F.col("m").isNull(), F.col("u")).otherwise(F.col("v")).alias("u"), F.coalesce("m", "v").alias("v"))
        small = small.union(several.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = keep(few(small, down.rows), f"{name}-{step}s")
        # both steps keep the components; the same set of links as before means that all links go to roots
        same = (after.rows, after.digest) == (links.rows, links.digest)
        forget(links)
        forget(down)
        links = after
        if same:
            break
    return links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def grouped(batches, keys: list[str]):
    """Runs of equal keys in sorted batches, each as one record batch; a run may span batches."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
        for a, b in zip(edges[:-2].tolist(), edges[1:-1].tolist(), strict=True):
            yield batch.slice(a, b - a)
        rest = batch.slice(int(edges[-2]))
    if rest is not None and rest.num_rows:
        yield rest
