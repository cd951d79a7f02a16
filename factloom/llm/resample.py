"""Documents drawn by importance for a target: hashed n-gram features, a gain for each bucket, Gumbel noise on the weights."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pretokens as P
from .common import fan_out, keep

RUN, BUCKETS, PERCENT, LEAST_WORDS, SEED = 2, 10_000, 25, 20, 7
#: Bytes of text whose features make one dictionary.
PIECE = 4 << 20
#: A-Z to lower case; then words are runs of digits, a-z and all bytes above ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True


@cache
def zeros(bit: int) -> np.ndarray:
    """What 2**bit zero bytes do to a crc32, as four tables of 256 entries: one for each byte of the checksum."""
    if not bit:
        step = np.array([zlib.crc32(bytes([x])) ^ zlib.crc32(b"\0") for x in range(256)], np.uint32)
        value = np.arange(256, dtype=np.uint32)
        return np.stack([step] + [value << np.uint32(8 * (k - 1)) for k in (1, 2, 3)])
    half = zeros(bit - 1)
    return np.stack([shifted_by(half, shifted_by(half, np.arange(256, dtype=np.uint32) << np.uint32(8 * k))) for k in range(4)])


def shifted_by(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def joined(crc: np.ndarray, more: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of strings put together, from those of their parts and the bytes of the second."""
    crc, bit = crc.copy(), 0
    while len(size) and int(size.max()) >> bit:
        on = np.flatnonzero((size >> bit) & 1)
        crc[on] = shifted_by(zeros(bit), crc[on])
        bit += 1
    return crc ^ more


class Features:
    """The features of a piece of a column: runs of 1 to ``run`` words of a text.

    For each length of run: ``codes`` (one for each place, an index into the dictionary of distinct strings), ``crc`` of
    each distinct string, and ``edges`` (places before each text and in all).
    """

    def __init__(self, column: pa.Array, run: int = RUN):
        data, offsets = P.text_buffers(column)
        low = LOWER[data]
        inside = INSIDE[low]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        first = np.flatnonzero(inside & ~(np.append(False, inside[:-1]) & ~cut[:-1])) if len(data) else np.zeros(0, np.int64)
        last = np.flatnonzero(inside & (~np.append(inside[1:], False) | cut[1:])) + 1 if len(data) else first
        self.words = np.searchsorted(first, offsets)  # words before each text
        self.n_words = np.diff(self.words)
        coded = P.slices(low, first, last).dictionary_encode() if len(first) else pa.array([], pa.large_binary()).dictionary_encode()
        word = coded.indices.to_numpy().astype(np.int64)
        strings = coded.dictionary.to_pylist()
        # each distinct word is hashed once, alone and behind a blank; longer runs follow from these
        crc = np.fromiter(map(zlib.crc32, strings), np.uint32, len(strings))
        behind = np.fromiter((zlib.crc32(s, zlib.crc32(b" ")) for s in strings), np.uint32, len(strings))
        size = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        self.parts = [(word, crc, self.words)]
        code, at = word, np.arange(len(word))
        for n in range(2, run + 1):
            own = np.maximum(self.n_words - n + 1, 0)
            edges = np.append(0, np.cumsum(own))
            here = np.arange(edges[-1]) + np.repeat(self.words[:-1] - edges[:-1], own)  # first word of each run
            before = code[np.searchsorted(at, here)]
            pairs = pa.array(before * len(strings) + word[here + n - 1]).dictionary_encode()
            key = pairs.dictionary.to_numpy()
            left, right = key // max(1, len(strings)), key % max(1, len(strings))
            crc = joined(crc[left], behind[right], size[right])
            code, at = pairs.indices.to_numpy().astype(np.int64), here
            self.parts.append((code, crc, edges))

    def counts(self, buckets: int) -> np.ndarray:
        """Places of each bucket: distinct strings are counted first, then their buckets added up."""
        out = np.zeros(buckets, np.int64)
        for code, crc, _ in self.parts:
            times = np.bincount(code, minlength=len(crc))
            out += np.bincount(crc % buckets, times, buckets).astype(np.int64)
        return out

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, sum of their gains) of each text."""
        n, total = np.zeros(len(self.n_words), np.int64), np.zeros(len(self.n_words), np.int64)
        for code, crc, edges in self.parts:
            n += np.diff(edges)
            total += np.diff(np.append(0, np.cumsum(gains[crc % len(gains)][code]))[edges])
        return n, total


def bucket_counts(docs: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n of all features of all texts; a task sends one row a bucket at most, no strings."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, to in P.pieces_of(batch.column(0), PIECE):
                total += Features(batch.column(0).slice(at, to - at), run).counts(buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])

    return docs.select(F.col(text).alias("t")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain (thousandths, rounded down) of each of the buckets: how much likelier the target has it, with one more of each."""
    s = bucket_counts(docs, text, run, buckets).withColumnRenamed("n", "s")
    t = bucket_counts(target, target_text, run, buckets).withColumnRenamed("n", "t")
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    every = every.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"])
    both = Window.partitionBy()  # over the buckets, a fixed number
    every = every.withColumns({"all_s": F.sum("s").over(both), "all_t": F.sum("t").over(both)})
    number = lambda c, more: F.col(c).cast("double") + more
    ratio = (number("t", 1) * number("all_s", buckets)) / (number("s", 1) * number("all_t", buckets))
    return every.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighted(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """key, n_words, n_features, weight of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)
    kind = docs.schema[key].dataType.simpleString()

    def weigh(batches):
        for batch in batches:
            for at, to in P.pieces_of(batch.column(1), PIECE):
                own = Features(batch.column(1).slice(at, to - at), run)
                n, total = own.sums(sent.value)
                weight = total // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(own.n_words), pa.array(n), pa.array(weight)], ["k", "n_words", "n_features", "weight"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(weigh, f"k {kind}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """key, n_features, weight, score, rank of every document; rank is null for those that aren't drawn.

    Features are counted as strings in a dictionary for each piece of text, and each distinct string is hashed once there; only sums of
    buckets leave a task. The gains (one number a bucket, a fixed count) go back to every task and are added up by the
    documents' own dictionaries. Of the documents with ``least_words`` words, ``percent`` in a hundred are drawn without
    replacement: those with the highest weight plus Gumbel noise, which depends on the seed and the key alone.

    Null text has no words; an empty text or one without words weighs 0. A null key counts as an empty one for the noise
    and comes last in ties. Equal scores are drawn by key; rows that repeat a key have the same noise and any order among
    equals. Very long texts are counted whole. Empty documents or targets give what the formula gives. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = bucket_gains(docs, target, text, target_text, run, buckets).collect()  # `buckets` rows
    gains = np.zeros(buckets, np.int64)
    gains[[r["bucket"] for r in rows]] = [r["gain"] for r in rows]
    noise = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = weighted(docs, gains, key, text, run)
    # the last column only spreads rows that are alike over ranges
    scored = scored.select("k", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("fit"), F.xxhash64(F.monotonically_increasing_id()).alias("any"))
    scored = keep(scored, "scored")
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("k").asc_nulls_last(), F.col("any")]
    dealt = keep(scored.repartitionByRange(max(1, fan_out(spark)), *order).withColumn("part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"), F.count_if("fit").alias("n_fit"))
    line = Window.orderBy("part")  # one row a range
    sizes = sizes.select(
        "part", (F.sum("n").over(line) - F.col("n")).alias("before"), F.floor(F.sum("n_fit").over(Window.partitionBy()) * percent / 100).alias("drawn"),
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    out = dealt.join(F.broadcast(sizes), "part").withColumn("place", place)
    return out.select(F.col("k").alias(key), "n_features", "weight", "score", F.when(F.col("fit") & (F.col("place") <= F.col("drawn")), F.col("place")).cast("long").alias("rank"))
