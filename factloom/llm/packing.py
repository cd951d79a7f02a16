"""Best-fit packing of token sequences by bin completion.

Only the histogram of lengths decides how to pack, and it has at most ``capacity`` entries whatever the corpus. The
driver solves it and gets back a plan of a few thousand rows (pattern, how often); a broadcast of the plan then tells
every piece, by its rank among the pieces of its length, its sequence and its place. No piece ever reaches the driver.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens as P
from .common import fan_out, keep
from .tokens import encoder, vectorisable, whole_tokens

CAPACITY = 2048
#: Steps that the search may take before its best plan so far stands, about half a minute. ``pack`` logs the plan's sequences, a
#: lower bound for any plan and whether the plan is proven to be the best.
STEPS = 30_000_000
#: Fillings that are looked at together and tried in order of waste; one without waste is tried at once.
FAN = 500
#: Levels of the search that stay open for other branches, the deepest ones; what they hold bounds the driver's memory.
OPEN = 64


@dataclass
class Trace:
    """What a search did: steps taken, branches tried after a first one, branches cut by a bound, fillings found dominated."""

    steps: int = 0
    branches: int = 0
    cut: int = 0
    dominated: int = 0
    proven: bool = False


class OutOfSteps(Exception):
    pass


def fillings(sizes: list[int], have: dict[int, int], room: int, waste: int, trace: Trace, most: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room``: multisets of the available sizes (descending) that leave at most ``waste`` free, the best-fit one first.

    A branch is dropped once even all smaller documents can't bring the free room under ``waste``. A filling is dominated
    if a document that is left fits beside its members, or in place of a smaller member. ``sizes`` ascend.
    """
    below, total = {}, 0
    for s in sizes:  # what all documents up to a size fill
        total += s * have[s]
        below[s] = total

    def dominated(taken: list[int], used: dict[int, int], left: int) -> bool:
        for x in [0, *dict.fromkeys(taken)]:
            k = bisect_right(sizes, x + left) - 1
            while k >= 0 and sizes[k] > x:
                if used.get(sizes[k], 0) < have[sizes[k]]:
                    return True
                k -= 1
        return False

    # depth first without recursion: per level the index of the size to try next
    taken: list[int] = []
    used: dict[int, int] = {}
    level = [bisect_right(sizes, room) - 1]
    left, leaf = room, False
    while level:
        trace.steps += 1
        if trace.steps > most:
            raise OutOfSteps
        if leaf:  # the last document filled up the room: a smaller one in its place leaves room for another, or is dominated
            level[-1] = min(level[-1], bisect_right(sizes, left - sizes[0]) - 1)
        k = level[-1]
        while k >= 0 and used.get(sizes[k], 0) >= have[sizes[k]]:
            k -= 1
        if k >= 0 and left - below[sizes[k]] <= waste:
            s = sizes[k]
            level[-1] = k - 1
            taken.append(s)
            used[s] = used.get(s, 0) + 1
            left -= s
            level.append(bisect_right(sizes, min(left, s)) - 1)
            leaf = False
            continue
        if k >= 0:
            trace.cut += 1
        # nothing can be put in any more
        leaf = level.pop() < 0 or not sizes or left < sizes[0]
        if left <= waste:
            if dominated(taken, used, left):
                trace.dominated += 1
            else:
                yield tuple(taken)
        if taken:
            s = taken.pop()
            used[s] -= 1
            left += s


def best_fit(have: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing on a histogram: (sizes of a sequence, number of such sequences). The incumbent of the search."""
    left = dict(have)
    sizes = sorted(left)
    plan: list[tuple[tuple[int, ...], int]] = []
    while sizes:
        room, taken, used = capacity, [], {}
        s = sizes[-1]
        while room > 0:
            k = bisect_right(sizes, min(room, s)) - 1
            while k >= 0 and used.get(sizes[k], 0) >= left[sizes[k]]:
                k -= 1
            if k < 0:
                break
            s = sizes[k]
            n = min(left[s] - used.get(s, 0), room // s)
            taken += [s] * n
            used[s] = used.get(s, 0) + n
            room -= n * s
        times = min(left[s] // n for s, n in used.items())
        plan.append((tuple(taken), times))
        for s, n in used.items():
            left[s] -= n * times
        sizes = [s for s in sizes if left[s] > 0]
    return plan


def least_sequences(have: dict[int, int], capacity: int) -> int:
    """A lower bound: for each length k up to half a sequence, documents longer than capacity - k stand alone among those of
    k and more, those longer than half are apart, and what is left of k and more must fit beside these or into others."""
    sizes = sorted(have)
    best = -(-sum(s * n for s, n in have.items()) // capacity)
    for k in [0, *(s for s in sizes if 2 * s <= capacity)]:
        alone = sum(have[s] for s in sizes if s > capacity - k)
        apart = [(s, have[s]) for s in sizes if capacity - k >= s and 2 * s > capacity]
        rest = sum(s * have[s] for s in sizes if 2 * s <= capacity and s >= k)
        room = sum(n * (capacity - s) for s, n in apart)
        best = max(best, alone + sum(n for _, n in apart) + max(0, -(-(rest - room) // capacity)))
    return best


def complete(have: dict[int, int], capacity: int, steps: int = STEPS, trace: Trace | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion by branch and bound on a histogram of lengths: (sizes of a sequence, number of such sequences).

    The largest length left opens a sequence; its undominated fillings are branches, in order of waste, and each is
    applied as often as the counts allow, then less often. Best-fit-decreasing is the first incumbent. A branch is cut
    when the waste so far can't stay below the incumbent's, or when the sequences so far and a lower bound for the rest
    (their tokens, or those longer than half a sequence) reach the incumbent. A plan with ceil(sum / capacity) sequences
    is the best and ends the search; so does an exhausted tree. Otherwise the incumbent stands after ``steps``. Only the
    OPEN deepest levels are returned to; a search that went deeper proves its plan by the bound alone.
    """
    trace = Trace() if trace is None else trace
    have = {s: n for s, n in have.items() if n > 0}
    total = sum(s * n for s, n in have.items())
    bound = max(-(-total // capacity), sum(n for s, n in have.items() if 2 * s > capacity))
    best = best_fit(have, capacity)
    fewest = sum(n for _, n in best)
    left, sizes = dict(have), sorted(have)
    plan: list[tuple[tuple[int, ...], int]] = []
    bins = waste = 0
    tokens, halves = total, sum(n for s, n in have.items() if 2 * s > capacity)

    def options(after: tuple[int, ...] | None) -> Iterator[tuple[int, ...]]:
        """Branches at the largest length left; ``after``: the filling just left off, which mustn't come again."""
        top = sizes[-1]
        left[top] -= 1
        mine, counts = [s for s in sizes if left[s] > 0], dict(left)
        left[top] += 1
        most = (fewest - 1) * capacity - total - waste
        found = ((top, *f) for f in fillings(mine, counts, capacity - top, most, trace, steps))
        while True:
            some = []
            for f in islice(found, FAN):
                if f != after:
                    some.append(f)
                if sum(f) == capacity:
                    break
            else:
                if not some:
                    return
            yield from sorted(some, key=lambda f: (-sum(f), len(f)))

    def turns() -> Iterator[tuple[tuple[int, ...], int]]:
        after = plan[-1][0] if plan and plan[-1][0][0] == sizes[-1] else None
        for f in options(after):
            most = min(left[s] // f.count(s) for s in set(f))
            yield from ((f, t) for t in range(most, 0, -1))

    closed = 0  # levels whose other branches were given up
    given_up = False
    try:
        stack: list[Iterator] = []
        if fewest > bound:
            stack.append(turns())
        while stack:
            trace.steps += 1
            if trace.steps > steps:
                raise OutOfSteps
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                closed = min(closed, len(stack))
                if plan:  # undo what led here
                    taken, times = plan.pop()
                    bins, waste, tokens = bins - times, waste - times * (capacity - sum(taken)), tokens + times * sum(taken)
                    halves += times * sum(2 * s > capacity for s in taken)
                    for s in taken:
                        left[s] += times
                    sizes = sorted(s for s in left if left[s] > 0)
                    trace.branches += 1
                continue
            taken, times = step
            spare = waste + times * (capacity - sum(taken))
            rest = max(-(-(tokens - times * sum(taken)) // capacity), halves - times * sum(2 * s > capacity for s in taken))
            if bins + times + rest >= fewest or spare > (fewest - 1) * capacity - total:
                trace.cut += 1
                continue
            plan.append(step)
            bins, waste, tokens = bins + times, spare, tokens - times * sum(taken)
            halves -= times * sum(2 * s > capacity for s in taken)
            for s in taken:
                left[s] -= times
            sizes = [s for s in sizes if left[s] > 0]
            if sizes:
                stack.append(turns())
                if len(stack) - closed > OPEN:
                    stack[closed] = iter(())
                    closed, given_up = closed + 1, True
                continue
            best, fewest = list(plan), bins
            if fewest <= bound:
                break
            stack.append(iter(()))
        trace.proven = not given_up or fewest <= bound
    except OutOfSteps:
        trace.proven = fewest <= bound
    return best


def plan_table(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """The plan as intervals of ranks: pieces of a length with ranks from ``key`` on go, ``each`` at a time, to sequences from ``sequence`` on."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for sizes, times in plan:
        at = 0
        for s in dict.fromkeys(sizes):
            n = sizes.count(s)
            first = taken.get(s, 0)
            rows.append((s, first, n, sequence, at))
            taken[s] = first + n * times
            at += n * s
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return {"key": (cols[0] << 44) + cols[1], "first": cols[1], "each": cols[2], "sequence": cols[3], "offset": cols[4]}


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32. A document is its ids and then ``end``; only one that is
    longer than ``capacity`` is cut, into full pieces behind a shorter first one."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer) if vectorisable(tokenizer) else {})
    kind = docs.schema[key].dataType

    def cut(batches):
        code = encoder(tokenizer, whole.value)
        stop = np.array([end], "<u4").tobytes()
        for batch in batches:
            column, keys = batch.column(1), batch.column(0)
            for at, to in P.pieces_of(column):
                flat, counts = code.encode(column.slice(at, to - at))
                raw, pos = memoryview(flat.astype("<u4", copy=False).tobytes()), 0
                row, piece, start, length, crc = [], [], [], [], []
                for k, n in enumerate(counts.tolist()):
                    size = n + 1
                    own = raw[4 * pos : 4 * (pos + n)]
                    pos += n
                    begin, number = 0, 0
                    head = size % capacity or capacity
                    while begin < size:
                        last = min(size, begin + head)
                        value = zlib.crc32(own[4 * begin : 4 * last])
                        row.append(at + k)
                        piece.append(number)
                        start.append(begin)
                        length.append(last - begin)
                        crc.append(zlib.crc32(stop, value) if last == size else value)
                        begin, number, head = last, number + 1, capacity
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [key, "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(cut, f"`{key}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Packs all documents into few sequences of at most ``capacity`` tokens: key, piece, start, length, ids_crc32, sequence_id, offset.

    Tokens are made once; their lengths and checksums are stored in the shared folder and the ids go no further. Ranks
    within a length come from counts of (length, bucket) with as many buckets as shuffle partitions, so a length that a
    third of all pieces share is ranked by many tasks.

    Null or empty text is a document of the end token alone. A null key is kept as it is. Very long texts are cut as
    stated. Rows that repeat a key are documents of their own. Ties may be packed in any order. An empty table gives an
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    spread = max(1, fan_out(spark))
    cut = pieces(docs, tokenizer, key, text, capacity, end)
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(spread)).cast("int"))
    cut = keep(cut, "pieces")
    counts = cut.groupBy("length", "_bucket").count()
    counts = keep(counts, "piece-counts")
    have = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    trace = Trace()
    best = complete(have, capacity, trace=trace)
    made, least = sum(n for _, n in best), least_sequences(have, capacity)
    logging.getLogger(__name__).info("%d sequences, at least %d, %s", made, least, "proven" if trace.proven or made == least else f"not proven after {trace.steps} steps")
    plan = spark.sparkContext.broadcast(plan_table(best, capacity))
    from pyspark.sql import Window

    before = counts.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "_bucket", F.coalesce("_before", F.lit(0)).cast("long").alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("ids_crc32", key, "piece", "start")
    ranked = cut.withColumn("_rank", F.row_number().over(within).cast("long") - 1).join(before.hint("merge"), ["length", "_bucket"])
    ranked = ranked.select(key, "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))
    fields = ranked.drop("_rank").schema
    names = [f.name for f in fields]

    def place(batches):
        p = plan.value
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            at = np.searchsorted(p["key"], (length << 44) + rank, "right") - 1
            turn, copy = np.divmod(rank - p["first"][at], p["each"][at])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(p["sequence"][at] + turn), pa.array(p["offset"][at] + copy * length)], [*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    return ranked.mapInArrow(place, T.StructType([*fields.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
