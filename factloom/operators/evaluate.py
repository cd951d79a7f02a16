"""Scoring against gold labels, curves, ranks, resampling, cross-validation and training."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import distances
from ..functions.features import features, measured
from ..functions.store import free, keep


#: Strings on either side of a block of pairs, and tasks at most as long as a task has no more blocks than this.
SIDE = 2000
TASKS = 2000
#: Pairs of which found ones become rows together, and letters up to which strings are compared by blocks.
ROWS = 1 << 18
LONG = 100


def score(extractions: DataFrame, gold: DataFrame, threshold: float = 0.0, keep_unscored: bool = True, order: str | None = None) -> DataFrame:
    """Adds score from gold (extraction, correct). Of repeated gold rows the last by ``order`` counts; without an order any
    if they agree, else the true one."""
    once = gold.groupBy("extraction").agg((F.max("correct") if order is None else F.max_by("correct", order)).alias("score"))
    out = extractions.where(F.col("confidence") >= threshold).join(once, "extraction", "left")
    return out if keep_unscored else out.where(F.col("score").isNotNull())


def grown_gold(gold: DataFrame, scored: DataFrame) -> DataFrame:
    """Gold and newly scored extractions, one row each."""
    return gold.select("extraction", "correct").unionByName(scored.where("score is not null").select("extraction", F.col("score").alias("correct"))).groupBy("extraction").agg(F.max("correct").alias("correct"))


def _segments(length: Column, most: Column) -> Column:
    """A string of this length as most + 1 stretches of almost equal length: array of (i, start, size), from 1 on."""
    each, longer = F.floor(length / (most + 1)), length % (most + 1)
    short = most + 1 - longer  # stretches of the smaller size, which come first

    def one(i: Column) -> Column:
        start = 1 + (i - 1) * each + F.greatest(i - 1 - short, F.lit(0))
        return F.struct(i.cast("int").alias("i"), start.cast("int").alias("start"), (each + F.when(i > short, 1).otherwise(0)).cast("int").alias("size"))

    return F.transform(F.sequence(F.lit(1).cast("long"), (most + 1).cast("long")), one)


def _candidates(extractions: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(extraction, suggestion, most) pairs, and rows (lb, extractions, suggestions) of two arrays that all meet: pairs among which all are that differ in at most ``most`` places, below half the extraction's length.

    Pigeonhole: cut into most + 1 stretches, an extraction keeps one of them unchanged in any such string, with at most
    i - 1 changes before the i-th and the others behind it; so a gold string holds it at one of few places. Stretches meet
    those substrings by equality of (length, i, text). An extraction whose stretches are so frequent that this would give
    more pairs than there are gold strings of similar length meets just those instead, by equal lengths: ``banded``. These
    pairs, as many as the extractions times the gold of their length, are a grid of blocks of SIDE by SIDE strings, dealt
    to as many tasks as there are blocks, or to TASKS and more; the strings of either side travel as one array.
    """
    a = extractions.select("extraction").distinct().select("extraction", F.length("extraction").alias("la"))
    a = a.withColumn("most", (F.floor(F.col("la") / 2) - 1).cast("int")).where("most >= 0")
    # dealt to a given number of tasks while rows are short: each gold string gives many probes
    spread = 3 * gold.sparkSession.sparkContext.defaultParallelism
    b = gold.select(F.col("extraction").alias("suggestion")).repartition(spread, "suggestion").distinct().where("suggestion IS NOT NULL").withColumn("lb", F.length("suggestion"))
    lengths = sorted(r["la"] for r in a.select("la").distinct().collect())  # no more than the longest extraction has letters
    if not lengths:
        return a.select("extraction", F.lit(None).cast("string").alias("suggestion"), "most").where("false"), None
    half = lambda n: F.floor(n / 2) - 1
    near = F.filter(F.array(*map(F.lit, lengths)), lambda n: F.abs(n - F.col("lb")) <= half(n))
    probes = b.withColumn("la", F.explode(near)).withColumn("most", half(F.col("la")))
    probes = probes.select("suggestion", "la", "lb", "most", F.explode(_segments(F.col("la"), F.col("most"))).alias("s")).select("suggestion", "la", "lb", "most", "s.*")
    shift, rest = F.col("lb") - F.col("la"), F.col("most") + 1 - F.col("i")
    low = F.greatest(F.lit(1), F.col("start") - F.col("i") + 1, F.col("start") + shift - rest).cast("int")
    high = F.least(F.col("lb") - F.col("size") + 1, F.col("start") + F.col("i") - 1, F.col("start") + shift + rest).cast("int")
    at = F.when(high >= low, F.sequence(low, high))
    probes = probes.withColumn("texts", F.array_distinct(F.transform(at, lambda p: F.substring("suggestion", p, F.col("size")))))
    probes = keep(probes.select("suggestion", "la", "i", F.explode("texts").alias("piece")), "probes")
    own = a.select("extraction", "la", "most", F.explode(_segments(F.col("la"), F.col("most"))).alias("s"))
    own = own.select("extraction", "la", "most", F.col("s.i").alias("i"), F.substring("extraction", F.col("s.start"), F.col("s.size")).alias("piece"))
    often = probes.groupBy("la", "i", "piece").agg(F.count("*").alias("n"))
    per_length = b.groupBy("lb").agg(F.count("*").alias("n"))
    band = per_length.withColumn("la", F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: F.abs(n - F.col("lb")) <= half(n)))).groupBy("la").agg(F.sum("n").alias("band"))
    cost = own.join(often, ["la", "i", "piece"], "left").groupBy("extraction", "la", "most").agg(F.sum("n").alias("pairs"))
    cost = keep(cost.where("pairs > 0").join(band, "la").withColumn("banded", F.col("pairs") >= F.col("band")), "costs")
    few = own.join(cost.where("not banded").select("extraction"), "extraction")
    met = few.join(probes, ["la", "i", "piece"]).select("extraction", "suggestion", "most").distinct()
    wide = cost.where("banded").select("extraction", "la", "most").withColumn("lb", F.explode(F.sequence(F.col("la") - F.col("most"), F.col("la") + F.col("most"))))
    wide = keep(wide.join(per_length.select("lb"), "lb").select("lb", "extraction"), "banded")
    if not wide.rows:
        return met, None
    left = _blocks(wide, "extraction", "x")
    right = _blocks(keep(b.join(wide.select("lb").distinct(), "lb", "left_semi").select("lb", "suggestion"), "gold"), "suggestion", "y")
    pairs = left.select("lb", "x").join(right.select("lb", "y"), "lb")
    n, longest = pairs.agg(F.count("*"), F.max("lb")).first()
    # dealt in turn to a given number of tasks: by their few bytes the blocks would end in one
    both = pairs.join(left.drop("lb"), "x").join(right.drop("lb"), "y").select("lb", "extractions", "suggestions")
    both = both.repartition(min(n, max(TASKS, n // TASKS)))
    both.longest = longest
    return met, both


def _blocks(rows: DataFrame, text: str, key: str) -> DataFrame:
    """The kept strings for each length lb in order, cut into blocks of SIDE strings at most, fewer if they are long: lb,
    an array named like the column with an s, and a number. Neighbours stand in one block, so that they share their
    beginnings."""

    def cut(batches):
        length, held = None, []
        for batch in batches:
            for lb, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (lb != length or len(held) == SIDE or len(held) * lb >= SIDE * LONG):
                    yield pa.RecordBatch.from_pydict({"lb": pa.array([length], pa.int32()), "block": [held]})
                    held = []
                length = lb
                held.append(one)
        if held:
            yield pa.RecordBatch.from_pydict({"lb": pa.array([length], pa.int32()), "block": [held]})

    parts = min(TASKS, -(-rows.rows // (4 * SIDE)))
    dealt = rows.select(F.col("lb").cast("int").alias("lb"), text).repartitionByRange(max(1, parts), "lb", text).sortWithinPartitions("lb", text)
    return keep(dealt.mapInArrow(cut, "lb int, block array<string>").select("lb", F.col("block").alias(f"{text}s"), F.monotonically_increasing_id().alias(key)), "blocks")


def candidates(extractions: DataFrame, gold: DataFrame) -> DataFrame:
    """(extraction, suggestion, most): all pairs that ``suggest`` compares."""
    met, blocks = _candidates(extractions, gold)
    if blocks is None:
        return met
    pairs = blocks.select("suggestions", F.explode("extractions").alias("extraction")).select("extraction", F.explode("suggestions").alias("suggestion"))
    return met.unionByName(pairs.withColumn("most", (F.floor(F.length("extraction") / 2) - 1).cast("int")))


def _nearest(batches):
    """Rows (extraction, suggestion, distance) of pairs of blocks: those nearer than half the extraction's length."""
    for batch in batches:
        for own, others in zip(batch.column(0), batch.column(1), strict=True):
            extractions, suggestions = own.values, others.values
            texts = extractions.to_pylist()
            most = np.array([len(t) // 2 - 1 for t in texts], np.uint8)
            apart = distances(texts, suggestions.to_pylist())
            step = max(1, ROWS // max(1, len(suggestions)))
            for at in range(0, len(texts), step):
                part = apart[at : at + step]
                near = part <= most[at : at + step, None]
                row = np.repeat(np.arange(len(part), dtype=np.int32), near.sum(1))
                column = (np.flatnonzero(near) - row.astype(np.int64) * len(suggestions)).astype(np.int32)
                if len(row):
                    yield pa.RecordBatch.from_arrays([extractions.take(pa.array(row + np.int32(at))), suggestions.take(pa.array(column)), pa.array(part[near].astype(np.int32))], ["extraction", "suggestion", "distance"])


def suggest(extractions: DataFrame, gold: DataFrame) -> DataFrame:
    """(extraction, suggestion, distance): gold strings nearer than half the extraction's length, among ``candidates``.

    Null strings have no partners; repeated ones count once; an extraction of two or three letters meets its equal only.
    All pairs of two blocks are compared together (functions.distance), and those that are too far apart never become
    rows. Strings of more than LONG letters share little, and are compared one by one.
    """
    met, blocks = _candidates(extractions, gold)
    near = met.withColumn("distance", F.levenshtein("extraction", "suggestion")).where("distance <= most").select("extraction", "suggestion", "distance")
    if blocks is None:
        return near
    near = near.unionByName(blocks.where(F.col("lb") <= LONG).select("extractions", "suggestions").mapInArrow(_nearest, "extraction string, suggestion string, distance int"))
    if blocks.longest <= LONG:
        return near
    one = blocks.where(F.col("lb") > LONG).select("extractions", F.explode("suggestions").alias("suggestion"))
    told = F.transform("extractions", lambda x: F.struct(x.alias("extraction"), F.levenshtein(x, F.col("suggestion")).alias("distance")))
    close = F.filter(told, lambda x: x["distance"] < F.floor(F.length(x["extraction"]) / 2))
    return near.unionByName(one.select("suggestion", F.inline(close)).select("extraction", "suggestion", "distance"))


def precision_yield(scored: DataFrame, conf: str, correct: Column, ties: list[str], by: list[str] | None = None, whole: bool = False) -> DataFrame:
    """One point for each correct row in order of confidence: yield (correct so far) and precision (correct / seen).

    The running sums are taken in two levels: within ranges of (group, confidence, ties), which a shuffle by range keeps
    balanced even where one group or one confidence holds most rows, and over the sums of the ranges, of which there are
    as many as shuffle partitions. ``whole``: with all columns of the rows.
    """
    by = by or []
    [flag, cell, n, y, n0, y0, seen] = free([*scored.columns, "confidence", "yield", "precision"], "flag", "cell", "n", "y", "n0", "y0", "seen")
    order = [F.desc(conf), *[F.asc(t) for t in ties]]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scored.where(correct.isNotNull()).withColumn(flag, F.when(correct, 1).otherwise(0))
    # stored, as another sampling of the ranges would give other cells
    rows = keep(rows.repartitionByRange(parts, *by, *order).withColumn(cell, F.spark_partition_id()), "ranges")
    sums = rows.groupBy(*by, cell).agg(F.count("*").alias(n), F.sum(flag).alias(y))
    before = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"{c}_of_sum") for c in by], F.col(cell).alias(f"{cell}_of_sum"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n0), F.coalesce(F.sum(y).over(before), F.lit(0)).alias(y0))
    w = Window.partitionBy(*by, cell).orderBy(*order)
    rows = rows.withColumn(seen, F.row_number().over(w)).withColumn(y, F.sum(flag).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_of_sum")) for c in (*by, cell)]
    out = rows.join(sums, on).where(F.col(flag) == 1)
    count = (F.col(y) + F.col(y0)).cast("long")
    own = [F.col(c) for c in scored.columns if c not in ("yield", "precision")] if whole else [*map(F.col, by), F.col(conf).alias("confidence")]
    return out.select(*own, count.alias("yield"), (count / (F.col(seen) + F.col(n0))).alias("precision"))


def area(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under precision over yield by trapezoids, from the first point on: one row (auc), or one a group with points.

    Neighbouring points differ by one in yield, so they meet in an equi-join; nothing is sorted.
    """
    by = by or []
    after = points.select(*by, (F.col("yield") - 1).alias("yield"), F.col("precision").alias("_next"))
    both = points.join(after, [*by, "yield"], "left" if by else "inner")
    return both.groupBy(*by).agg(F.coalesce(F.sum((F.col("precision") + F.col("_next")) / 2), F.lit(0.0)).alias("auc"))


def merge_curves(curves: list[DataFrame]) -> DataFrame:
    """Outer merge of (yield, precision) curves: yield, precision_0, precision_1 ..."""
    rows = None
    for i, c in enumerate(curves):
        one = c.select("yield", "precision", F.lit(i).alias("i"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("yield").agg(*[F.max(F.when(F.col("i") == i, F.col("precision"))).alias(f"precision_{i}") for i in range(len(curves))])


def rank(scored: DataFrame, by: str, correct: Column) -> DataFrame:
    """by, precision, n: of rows with a score."""
    return scored.where(correct.isNotNull()).groupBy(by).agg(F.avg(correct.cast("int")).alias("precision"), F.count("*").alias("n"))


def group_scored(scored: DataFrame, by: str, correct: Column, conf: str = "confidence") -> DataFrame:
    """Every scored row with the precision and size of its group; reports order by precision, then confidence, descending."""
    return scored.where(correct.isNotNull()).join(rank(scored, by, correct), by)


def _copies(key: Column, iteration: Column, seed: int) -> Column:
    """How often a sentence is drawn in an iteration: Poisson with mean 1, from a hash in plain integer arithmetic."""
    prime = 2147483647
    mixed = F.pmod((F.pmod(key, F.lit(prime)) + 1) * 48271 + F.pmod((iteration + 1) * 69621 + seed * 16807, F.lit(prime)), F.lit(prime))
    u = F.pmod(F.pmod(mixed * 40692, F.lit(prime)) * 16807, F.lit(prime)) / float(prime)
    return sum((F.when(u >= s, 1).otherwise(0) for s in POISSON), F.lit(0))


#: Chances that Poisson(1) is at most 0, 1, 2 ...
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def resampled(systems: DataFrame, iterations: int = 1000, seed: int = 1, value: str = "correct") -> DataFrame:
    """systems (sentence, system, correct) -> (iteration, system, precision): sentences drawn with replacement.

    Each sentence (a number) gets a Poisson(1) number of copies per iteration from a hash, the distributed form of the
    bootstrap; the same copies for all systems, so differences are paired. Rows are first summed by sentence, and the
    iterations are unfolded from those sums. ``value`` may hold any score, of which the mean is taken.
    """
    own = systems.groupBy("sentence", "system").agg(F.sum(F.col(value).cast("double")).alias("hits"), F.count(value).alias("n"))
    drawn = own.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("copies", _copies(F.col("sentence").cast("long"), F.col("iteration").cast("long"), seed))
    return drawn.groupBy("iteration", "system").agg((F.sum(F.col("copies") * F.col("hits")) / F.sum(F.col("copies") * F.col("n"))).alias("precision"))


def beaten(drawn: DataFrame, better: str, worse: str, value: str) -> DataFrame:
    """One row: iterations, those in which ``better`` isn't above ``worse``, and their share (the p-value)."""
    both = drawn.groupBy("iteration").agg(F.max(F.when(F.col("system") == better, F.col(value))).alias("b"), F.max(F.when(F.col("system") == worse, F.col(value))).alias("w"))
    lost = F.sum(F.when(F.col("b") > F.col("w"), 0).otherwise(1))
    return both.agg(F.count("*").alias("iterations"), lost.alias("lost"), (lost / F.count("*")).alias("p_value"))


def significance(systems: DataFrame, better: str, worse: str, iterations: int = 1000, seed: int = 1, value: str = "correct") -> DataFrame:
    """``beaten`` for the resampled means."""
    return beaten(resampled(systems, iterations, seed, value), better, worse, "precision")


def _draws(sentence: np.ndarray, iterations: int, seed: int) -> np.ndarray:
    """The copies of ``_copies`` for many sentences at once: (sentences, iterations)."""
    prime = 2147483647
    shift = (np.arange(1, iterations + 1, dtype=np.int64) * 69621 + seed * 16807) % prime
    mixed = ((sentence.astype(np.int64) % prime + 1)[:, None] * 48271 + shift) % prime
    u = mixed * 40692 % prime * 16807 % prime / float(prime)
    return sum((u >= s).astype(np.int64) for s in POISSON)


#: Rows whose copies in all iterations are held at a time.
BLOCK = 1024


def resampled_auc(systems: DataFrame, conf: str, ties: list[str], iterations: int = 1000, seed: int = 1) -> DataFrame:
    """The metric version: (iteration, system, auc), the area under each resampled precision-yield curve. A row drawn k
    times stands k times in a row in order of confidence; a curve without a point has no area.

    Rows are shuffled once, by ranges of (system, confidence, ties), whatever the number of iterations. A range adds up one
    vector of copies and one of correct copies, an entry an iteration; sums of the vectors over the ranges before give
    every range its place in all curves, and a second pass adds up the precisions of its points for all iterations
    together. Both passes hold BLOCK rows at a time. A row without a verdict (null) is left out; the sentence is a number.
    """
    parts = int(systems.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"tie{i}" for i in range(len(ties))]
    rows = systems.where("correct IS NOT NULL").select("system", F.col(conf).alias("conf"), *[F.col(t).alias(n) for t, n in zip(ties, names, strict=True)], F.col("sentence").cast("long").alias("sentence"), F.col("correct").cast("boolean").alias("hit"))
    order = ["system", F.desc("conf"), *names]
    rows = keep(rows.repartitionByRange(parts, *order).withColumn("cell", F.spark_partition_id()), "drawn-ranges")
    kind = rows.schema["system"].dataType.simpleString()

    def columns(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return dict(zip(batch.schema.names, batch.columns, strict=True))

    def blocks(c: dict[str, pa.Array], at: int, to: int):
        """(copies, correct copies) of rows at..to, a block at a time."""
        for i in range(at, to, BLOCK):
            n = min(BLOCK, to - i)
            copies = _draws(c["sentence"].slice(i, n).to_numpy(zero_copy_only=False), iterations, seed)
            yield copies, copies * c["hit"].slice(i, n).to_numpy(zero_copy_only=False).astype(np.int64)[:, None]

    def stretches(c: dict[str, pa.Array]) -> list[tuple[tuple, int, int]]:
        keys = list(zip(c["system"].to_pylist(), c["cell"].to_pylist(), strict=True))
        edges = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
        return [(keys[i], i, j) for i, j in zip(edges[:-1], edges[1:], strict=True)]

    def tally(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            c = columns(batch)
            for own, at, to in stretches(c):
                both = sums.setdefault(own, np.zeros((2, iterations), np.int64))
                for copies, hits in blocks(c, at, to):
                    both += np.stack([copies.sum(0), hits.sum(0)])
        if sums:
            yield pa.RecordBatch.from_pydict({"system": [k[0] for k in sums], "cell": pa.array([k[1] for k in sums], pa.int32()), "n": [x[0] for x in sums.values()], "y": [x[1] for x in sums.values()]})

    sums = rows.select("system", "cell", "sentence", "hit").mapInArrow(tally, f"system {kind}, cell int, n array<bigint>, y array<bigint>")
    sums = sums.select("system", "cell", F.posexplode(F.arrays_zip("n", "y")).alias("iteration", "x")).groupBy("system", "cell", "iteration").agg(F.sum("x.n").alias("n"), F.sum("x.y").alias("y"))
    before = Window.partitionBy("system", "iteration").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("system", "cell", F.struct("iteration", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("y").over(before), F.lit(0)).alias("y")).alias("x"))
    ahead = ahead.groupBy("system", "cell").agg(F.sort_array(F.collect_list("x")).alias("x")).select("system", "cell", F.lit(0).alias("turn"), F.transform("x", lambda x: x["n"]).alias("n"), F.transform("x", lambda x: x["y"]).alias("y"))

    def walk(batches):
        own, seen, done, total, first, last = None, None, None, None, None, None

        def points():
            value = lambda x: pa.array([x], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([own[0]]), pa.array([own[1]], pa.int32()), value(total), value(first), value(last)], ["system", "cell", "total", "first", "last"])

        for batch in batches:
            c = columns(batch)
            turn = c["turn"].to_numpy(zero_copy_only=False)
            for key, at, to in stretches(c):
                if turn[at] == 0:  # a range begins with the sums of those before it
                    if own is not None:
                        yield points()
                    own, seen, done = key, np.array(c["n"][at].as_py(), np.int64), np.array(c["y"][at].as_py(), np.int64)
                    total, first, last = np.zeros(iterations), np.full(iterations, np.nan), np.full(iterations, np.nan)
                    at += 1
                for copies, hits in blocks(c, at, to):
                    n, y = seen + np.cumsum(copies, 0) - copies, done + np.cumsum(hits, 0) - hits
                    for j in range(1, int(hits.max(initial=0)) + 1):
                        total += np.where(hits >= j, (y + j) / (n + j), 0.0).sum(0)
                    drawn = hits > 0
                    some = np.flatnonzero(drawn.any(0))
                    head, tail = drawn.argmax(0)[some], len(drawn) - 1 - drawn[::-1].argmax(0)[some]
                    first[some] = np.where(np.isnan(first[some]), (y[head, some] + 1) / (n[head, some] + 1), first[some])
                    k = hits[tail, some]
                    last[some] = (y[tail, some] + k) / (n[tail, some] + k)
                    seen, done = seen + copies.sum(0), done + hits.sum(0)
        if own is not None:
            yield points()

    marked = rows.withColumn("turn", F.lit(1)).unionByName(ahead, allowMissingColumns=True)
    walked = marked.repartition(parts, "cell").sortWithinPartitions("system", "cell", "turn", F.desc("conf"), *names).mapInArrow(walk, f"system {kind}, cell int, total array<double>, first array<double>, last array<double>")
    each = walked.select("system", "cell", F.posexplode(F.arrays_zip("total", "first", "last")).alias("iteration", "x")).select("system", "cell", "iteration", "x.*")
    known = lambda c, by: by(c, F.when(~F.isnan(c), F.col("cell")))
    ends = (known("first", F.min_by) + known("last", F.max_by)) / 2
    return each.groupBy("iteration", "system").agg(F.coalesce(F.sum("total") - F.nanvl(ends, F.lit(None)), F.lit(0.0)).alias("auc"))


def folds(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Adds fold by the hash of a key: balanced, stable, and without a global sort."""
    return rows.withColumn("fold", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n)).cast("int"))


def fixed_windows(rows: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """Adds fold: n stretches of floor(rows / n) rows in an order; what is left over has none (null).

    Rows are numbered within ranges of the order and then over the ranges, so no task sorts the whole table. The order
    must tell all rows apart.
    """
    cell, at, before, size = free(rows.columns, "cell", "at", "before", "size")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(rows.repartitionByRange(parts, *order).withColumn(cell, F.spark_partition_id()), "windows")
    sums = dealt.groupBy(F.col(cell).alias(f"{cell}_of_sum")).agg(F.count("*").alias(size))  # a row for each range
    over = Window.orderBy(f"{cell}_of_sum").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(f"{cell}_of_sum", F.coalesce(F.sum(size).over(over), F.lit(0)).alias(before))
    numbered = dealt.withColumn(at, F.row_number().over(Window.partitionBy(cell).orderBy(*order)) - 1).join(F.broadcast(sums), F.col(cell) == F.col(f"{cell}_of_sum"))
    fold = F.floor((F.col(at) + F.col(before)) / max(1, dealt.rows // n)).cast("int")
    return numbered.select(*rows.columns, F.when(fold < n, fold).alias("fold"))


def annotate(gold: DataFrame, marks: DataFrame) -> DataFrame:
    """gold (extraction, correct) after marks (extraction, mark, at): ``=`` is true, ``-`` false, a blank takes the label away; the
    last mark by ``at`` counts."""
    last = marks.groupBy("extraction").agg(F.max_by("mark", "at").alias("mark"))
    both = gold.groupBy("extraction").agg(F.max("correct").alias("correct")).join(last, "extraction", "full")
    kept = both.where(F.col("mark").isNull() | (F.col("mark") != " "))
    return kept.select("extraction", F.when(F.col("mark").isNull(), F.col("correct")).otherwise(F.col("mark") == "=").alias("correct"))


#: Newton steps of a fit, and the weight of the squared coefficients for each row.
STEPS, RIDGE = 8, 0.01


def fit_folds(rows: DataFrame, names: list[str], label: str = "label", fold: str | None = None, n: int = 1, steps: int = STEPS, ridge: float = RIDGE) -> list[dict[str, float]]:
    """Logistic regression, for each of n folds on the rows outside it: weights by name, with Intercept. Without ``fold`` one
    fit on all rows; a row without a fold (null) trains them all.

    A fixed number of Newton steps, each one scan that adds up the gradients and Hessians of all folds together: what a
    task sends is n vectors and matrices of the features' number, whatever its rows. ``ridge`` keeps separable rows finite.
    Rows without a label or with a null feature are left out.
    """
    d = len(names) + 1
    used = rows.select(F.col(label).cast("double").alias("y"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    used = used.na.drop(subset=["y", *[f"x{i}" for i in range(d - 1)]])
    w = np.zeros((n, d))
    for _ in range(steps):
        now = w

        def add(batches, now=now):
            total = np.zeros((n, d * d + d + 1))
            for batch in batches:
                y, own = batch.column(0).to_numpy(zero_copy_only=False), np.nan_to_num(batch.column(1).to_numpy(zero_copy_only=False), nan=-1)
                x = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[2:])])
                p = 1 / (1 + np.exp(-(x @ now.T)))
                for k in range(n):
                    at = own != k
                    here, q = x[at], p[at, k]
                    total[k, : d * d] += (here.T @ (here * (q * (1 - q))[:, None])).reshape(-1)
                    total[k, d * d : -1] += here.T @ (y[at] - q)
                    total[k, -1] += at.sum()
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.repeat(np.arange(n), total.shape[1]), pa.int32()), "i": pa.array(np.tile(np.arange(total.shape[1]), n), pa.int32()), "v": total.reshape(-1)})

        sums = used.mapInArrow(add, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()  # n x (features + 1)^2
        total = np.zeros((n, d * d + d + 1))
        for r in sums:
            total[r["k"], r["i"]] = r["v"]
        keepers = np.diag([0.0] + [1.0] * (d - 1)) * ridge
        w = now.copy()
        for k in range(n):
            count = total[k, -1]
            if count:
                hessian, gradient = total[k, : d * d].reshape(d, d) / count + keepers, total[k, d * d : -1] / count - keepers @ now[k]
                w[k] = now[k] + np.linalg.lstsq(hessian, gradient, rcond=None)[0]
    return [{"Intercept": float(x[0])} | dict(zip(names, map(float, x[1:]), strict=True)) for x in w]


def train(rows: DataFrame, names: list[str], label: str = "label") -> dict[str, float]:
    """Logistic regression on columns ``names``: weights by name, with Intercept."""
    return fit_folds(rows, names, label)[0]


def logistic(weights: dict[str, float]) -> Column:
    total = F.lit(float(weights["Intercept"]))
    for c, w in weights.items():
        if c != "Intercept":
            total = total + F.col(f"`{c}`").cast("double") * w
    return 1 / (1 + F.exp(-total))


def cross_validate(rows: DataFrame, names: list[str], key: str, label: str = "label", n: int = 10, steps: int = STEPS) -> DataFrame:
    """(fold, accuracy, auc): of each fixed window in order of the key, with weights trained on all other rows, the accuracy at
    0.5 and the area under precision over yield; fold -1 has the means of the windows. Rows that are left over behind the
    last window train every fold and test none.

    All folds are trained together (``fit_folds``), and all are tested in one pass, each row with its own fold's weights.
    """
    dealt = keep(fixed_windows(rows.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), *[F.col(f"`{c}`").cast("double").alias(c) for c in names]), ["key"], n), "folds")
    weights = fit_folds(dealt, names, "label", "fold", n, steps)
    odds = F.lit(None).cast("double")
    for k, w in enumerate(weights):
        odds = F.when(F.col("fold") == k, logistic(w)).otherwise(odds)
    tested = keep(dealt.where("fold IS NOT NULL").select("fold", "key", F.col("label").alias("hit"), odds.alias("confidence")), "tested")
    right = ((F.col("confidence") >= 0.5) == (F.col("hit") == 1)).cast("int")
    curves = precision_yield(tested, "confidence", F.col("hit") == 1, ["key"], ["fold"])
    each = tested.groupBy("fold").agg(F.avg(right).alias("accuracy")).join(area(curves, ["fold"]), "fold", "left")
    each = each.select("fold", "accuracy", F.coalesce("auc", F.lit(0.0)).alias("auc"))
    return each.unionByName(each.agg(F.lit(-1).alias("fold"), F.avg("accuracy").alias("accuracy"), F.avg("auc").alias("auc")))


def train_from_instances(labelled: DataFrame, names: list[str] | None = None) -> dict[str, float]:
    """Weights from labelled instances (sources.readers.instances): every feature, or those named."""
    names = sorted(features()) if names is None else names
    rows = measured(labelled, lambda known: {n: c for n, c in features(known).items() if n in names})
    return train(rows.select(F.col("score").cast("int").alias("label"), *[F.col(f"`{n}`") for n in names]), names)
