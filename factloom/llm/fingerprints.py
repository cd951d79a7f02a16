"""Document fingerprints from prefix polynomial hashes.

A text of code points c_0, c_1, ... has the prefix array H(m) = sum over k < m of (c_k + 1) * B**k, modulo a prime, for two
bases B. Any span's hash is (H(j) - H(i)) / B**i, wherever it stands, so two spans are compared in constant time and the
longest common extension of two places is found by binary search. A fingerprint holds such hashes at marked places and of
the least spans of a fixed width.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fan_out, free, keep

PRIME = (1 << 31) - 1
#: Two bases; both residues together are one value of 62 bits.
BASES = (1_103_515_245, 1_812_433_253)
#: At most so many prefixes are marked, at multiples of a power of two.
MARKS = 16
#: Width of the spans in the sketch, in code points, and how many of the least it keeps.
WIDTH, SKETCH = 16, 32


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for 0 <= x < 2**62."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x == PRIME, 0, x)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) at least; a worker's table grows with the longest text it has seen."""
    table = _powers.get(base, np.ones(1, np.int64))
    while len(table) < n:
        table = np.concatenate([table, reduced(table * pow(base, len(table), PRIME))])
    _powers[base] = table
    return table


class Prefixes:
    """The prefix arrays of one text, one for each base."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays
        self.size = len(arrays[0]) - 1

    @classmethod
    def of(cls, text: str) -> Prefixes:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        made = []
        for base in BASES:
            sums = np.zeros(len(points) + 1, np.int64)
            np.cumsum(reduced(points * powers(base, len(points))[: len(points)]), out=sums[1:])
            made.append(reduced(sums))
        return cls(made)

    def edited(self, head: int, other: Prefixes, tail: int) -> Prefixes:
        """Of this text's first ``head`` code points and then the other's first ``tail``, without reading either again."""
        made = []
        for base, own, its in zip(BASES, self.arrays, other.arrays, strict=True):
            shift = int(powers(base, head + 1)[head])
            made.append(np.concatenate([own[: head + 1], reduced(reduced(its[1 : tail + 1] * shift) + own[head])]))
        return Prefixes(made)

    def prefix(self, m: int) -> int:
        return int(self.arrays[0][m]) << 31 | int(self.arrays[1][m])

    def span(self, i: int, j: int) -> int:
        """The hash of code points i to j - 1; equal to that of an equal span at any place of any text."""
        value = 0
        for base, own in zip(BASES, self.arrays, strict=True):
            back = pow(pow(base, i, PRIME), -1, PRIME)
            value = value << 31 | (int(own[j]) - int(own[i])) % PRIME * back % PRIME
        return value

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """How many code points agree from place i of this text and place j of the other on."""
        low, high = 0, min(self.size - i, other.size - j)
        while low < high:
            m = (low + high + 1) // 2
            same = self.prefix(m) == other.prefix(m) if i == j == 0 else self.span(i, i + m) == other.span(j, j + m)
            low, high = (m, high) if same else (low, m - 1)
        return low

    def sketch(self) -> np.ndarray:
        """The least distinct hashes among all spans of WIDTH code points, rising; a shorter text is one span."""
        width = min(WIDTH, self.size)
        n = self.size - width + 1
        if not self.size:
            return np.zeros(0, np.int64)
        base, own = BASES[0], self.arrays[0]
        inverse = powers(pow(base, -1, PRIME), n)[:n]
        value = reduced(reduced(own[width:] - own[:-width] + PRIME) * inverse)
        # equal distances of code points give equal distances of hashes: mixed, so that the least are any spans
        value = reduced((value ^ value >> 15) * 0x2C1B3C6D)
        value = reduced((value ^ value >> 12) * 0x297A2D39)
        bar = 16 * SKETCH * PRIME // n
        least = np.unique(value[value < bar]) if bar < PRIME else np.unique(value)
        return (least if len(least) >= SKETCH else np.unique(value))[:SKETCH]

    def fingerprint(self) -> str:
        """Code points, hash of the whole, hashes of the marked prefixes, least spans; hexadecimal, parted by points."""
        step = mark_step(self.size)
        marks = "".join(f"{self.prefix(m):016x}" for m in range(step, self.size + 1, step))
        return f"{self.size:x}.{self.prefix(self.size):016x}.{marks}.{''.join(f'{x:08x}' for x in self.sketch().tolist())}"


def mark_step(size: int) -> int:
    """The least power of two that has at most MARKS multiples up to size."""
    return 1 << max(0, (size // (MARKS + 1)).bit_length())


def likeness(one: str, other: str) -> float:
    """0 to 1 for two fingerprints: 1 for equal texts, else the share of the longer text up to the last marked prefix that
    both have, or the share of common spans by their sketches, whichever is larger."""
    if one == other:
        return 1.0
    a, b = (x.split(".") for x in (one, other))
    size_a, size_b = int(a[0], 16), int(b[0], 16)
    if not size_a or not size_b:
        return 0.0
    step_a, step_b = mark_step(size_a), mark_step(size_b)
    step = max(step_a, step_b)

    def mark(x: list[str], own: int, k: int) -> str:
        at = 16 * (k * step // own - 1)
        return x[2][at : at + 16]

    low, high = 0, min(size_a, size_b) // step
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if mark(a, step_a, k) == mark(b, step_b, k) else (low, k - 1)
    spans_a, spans_b = ({x[3][k : k + 8] for k in range(0, len(x[3]), 8)} for x in (a, b))
    union = sorted(spans_a | spans_b)[:SKETCH]
    both = sum(x in spans_a and x in spans_b for x in union) / len(union)
    # texts that differ are never called equal
    return min(max(low * step / max(size_a, size_b), both), 1 - 1 / (1 + max(size_a, size_b)))


RESULTS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"


class Document:
    """A text with its prefix arrays and fingerprint, made once for both neighbours."""

    def __init__(self, text: str):
        self.text = text
        self.prefixes = Prefixes.of(text)
        self.fingerprint = self.prefixes.fingerprint()

    def beside(self, after: Document) -> tuple:
        """RESULTS, with the document that comes next."""
        n = self.prefixes.size
        tail = n // 4
        text = self.text[: n - tail] + after.text[:tail]
        changed = self.prefixes.edited(n - tail, after.prefixes, min(tail, after.prefixes.size))
        name = changed.fingerprint() if tail else self.fingerprint
        return (
            n, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), self.fingerprint, name, likeness(self.fingerprint, name), likeness(self.fingerprint, after.fingerprint),
            self.prefixes.extension(0, changed, 0), self.prefixes.extension(0, after.prefixes, 0),
        )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_edited, common_next.

    The edited text has the next document's beginning in place of its own last quarter. Documents are dealt by ranges of
    the key and sorted within; each task walks through its range with two documents in hand. The first and last document of
    every range (two a task) are stored with their texts and meet their neighbours afterwards, so the text is shuffled once.
    common_* are the code points with which the text and the edited or the next text begin alike.

    Null text is empty; an empty text is like nothing but another empty one. A null key comes first; rows that repeat a key
    follow each other by a hash of the text; equal rows are documents of their own. The only document of a table is its own
    next. Very long texts are hashed whole. An empty table gives an empty result. Other columns are ignored.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    order: list[Column] = [F.col("k"), F.xxhash64("t")]
    rows = rows.repartitionByRange(max(1, fan_out(spark)), *order).sortWithinPartitions(*order)
    schema = f"k {kind}, {RESULTS}, edge int, t string"
    to = pa.schema(_arrow(rows.select("k"), RESULTS) + [("edge", pa.int32()), ("t", pa.string())])

    def walk(batches):
        first = last = last_key = None
        seen = 0
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for at, k in enumerate(keys):
                now = Document(batch.column(1)[at].as_py())
                if last is None:
                    first = (k, now.text)
                else:
                    out.append((last_key, *last.beside(now), None, None))
                last, last_key, seen = now, k, seen + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), to, strict=True)], schema=to)
        edges = [] if not seen else [(last_key, 2, last.text)] if seen == 1 else [(first[0], 0, first[1]), (last_key, 1, last.text)]
        if edges:
            none = [None] * len(edges)
            columns = [[e[0] for e in edges], *[none] * 8, [e[1] for e in edges], [e[2] for e in edges]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to, strict=True)], schema=to)

    walked = keep(rows.mapInArrow(walk, schema), "fingerprints")
    # two rows a task at most; a last one is followed by the next range's first, the very last by the very first
    edges = walked.where("edge IS NOT NULL").select("k", "t", "edge")
    line = Window.orderBy(*order, "edge")
    ends = Window.orderBy(*order, "edge").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("k", "t", F.coalesce(F.lead("t").over(line), F.first("t").over(ends)).alias("next"), "edge").where("edge > 0")
    done = pa.schema(_arrow(rows.select("k"), RESULTS))

    def meet(batches):
        for batch in batches:
            out = [(k, *Document(t).beside(Document(after))) for k, t, after in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), done, strict=True)], schema=done)

    edges = edges.select("k", "t", "next").mapInArrow(meet, f"k {kind}, {RESULTS}")
    whole = walked.where("edge IS NULL").drop("edge", "t").unionByName(edges)
    return whole.withColumnRenamed("k", key)


def _arrow(df: DataFrame, results: str) -> list[pa.Field]:
    """The fields of df and then those of ``results`` for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return [*to_arrow_schema(df.schema), *[pa.field(name, kinds[kind]) for name, kind in (x.split() for x in results.split(", "))]]


def extensions(pairs: DataFrame, one: str, other: str, at_one: str, at_other: str, result: str = "extension") -> DataFrame:
    """Adds how many code points of column ``one`` from at_one on agree with those of ``other`` from at_other on.

    Null texts are empty, null places are 0; a place beyond the end gives 0. Repeated rows are answered each, long texts
    whole; an empty table stays empty; a column of pairs named like the result is dropped first.
    """
    kept = pairs.drop(result)
    a, b, i, j = free(kept.columns, "one", "other", "i", "j")
    rows = kept.withColumns({a: F.coalesce(one, F.lit("")), b: F.coalesce(other, F.lit("")), i: F.coalesce(at_one, F.lit(0)).cast("long"), j: F.coalesce(at_other, F.lit(0)).cast("long")})
    width = len(kept.columns)
    schema = T.StructType([*kept.schema.fields, T.StructField(result, T.LongType())])

    def answer(batches):
        for batch in batches:
            found = []
            for x, y, m, n in zip(*(batch.column(width + c).to_pylist() for c in range(4)), strict=True):
                x, y = Prefixes.of(x), Prefixes.of(y)
                found.append(x.extension(m, y, n) if m < x.size and n < y.size else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(found, pa.int64())], [*batch.schema.names[:width], result])

    return rows.mapInArrow(answer, schema)
