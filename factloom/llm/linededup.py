"""Removal of passages that repeat across the corpus, by content-defined chunks of lines. Column expressions alone.

A chunk is a stretch of neighbouring lines that all occur more than once in the corpus. Where it ends depends on the two
lines at the boundary alone, so a passage is cut in the same places wherever it stands: where the lines, or the two of
them together, don't occur equally often in the corpus, beside a line that is a passage by itself, and where the rolling
hash over the last two line hashes says so.
From each chunk on, and up to each chunk, the least stretch of touching chunks with enough words is looked up in the
whole corpus; where it occurs earlier as a whole, it goes, once the bytes of its chunks have been compared with those of all other places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, free, keep, lookup
from .quality import BLANK_RE, BLANKS

#: Words from which on a repeated passage goes, and the mean number of lines between boundaries set by the rolling hash.
MIN_WORDS, MEAN_LINES = 50, 8


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_k, _h, seq (among lines with a word), pos (among all), lh, lh2, words: one row for each line with a word."""
    numbered = F.filter(F.transform(_lines(F.col(text)), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    # the text's hash comes before its lines part: else every line's row would carry the text and hash it again
    rows = docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_h"), numbered.alias("_lines")).select("_k", "_h", F.posexplode("_lines").alias("seq", "x"))
    line = F.col("x.line")
    return rows.select(
        "_k", "_h", "seq", F.col("x.pos").alias("pos"), F.xxhash64(line).alias("lh"), F.xxhash64(F.lit("second"), line).alias("lh2"),
        F.size(F.split(F.trim(line, F.lit(BLANKS)), BLANK_RE)).alias("words"),
    )


def chunk_table(lines: DataFrame, min_words: int, mean_lines: int) -> DataFrame:
    """_k, _h, first, last (seq), begin, end (pos), words, ck: chunks of lines that occur more than once."""
    counts = lines.groupBy("lh").agg(F.count("*").alias("n")).where("n > 1")
    # rows that repeat key and text count once; the windows below use the same partitioning
    again = lookup(lines, counts, "lh", "n", lines.rows).where("n is not null").repartition("_k", "_h").dropDuplicates(["_k", "_h", "seq"])
    order = Window.partitionBy("_k", "_h").orderBy("seq")
    lag = lambda c: F.lag(c).over(order)
    near = F.col("seq") == lag("seq") + 1
    paired = keep(again.withColumn("pair", F.when(near, F.xxhash64(lag("lh"), "lh"))).withColumn("n_before", lag("n")).withColumn("words_before", lag("words")), "pairs")
    pairs = paired.where("pair is not null").groupBy("pair").agg(F.count("*").alias("n_pair"))
    again = lookup(paired, pairs, "pair", "n_pair", paired.rows)
    edge = (
        F.col("pair").isNull() | (F.col("n_pair") != F.col("n")) | (F.col("n_before") != F.col("n"))
        | (F.col("words") >= min_words) | (F.col("words_before") >= min_words)
        | (F.pmod("pair", F.lit(mean_lines)) == 0)
    )
    cut = again.withColumn("_edge", F.when(edge, 1).otherwise(0)).withColumn("_chunk", F.sum("_edge").over(order))
    cut = cut.withColumn("_at", F.row_number().over(Window.partitionBy("_k", "_h", "_chunk").orderBy("seq")))
    chunks = cut.groupBy("_k", "_h", "_chunk").agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.min("pos").alias("begin"), F.max("pos").alias("end"),
        F.sum("words").alias("words"), F.bit_xor(F.xxhash64("lh", "_at")).alias("_one"), F.bit_xor(F.xxhash64("_at", "lh2")).alias("_two"),
    )
    return chunks.withColumn("ck", F.concat(F.hex("_one"), F.lit("-"), F.hex("_two"))).drop("_chunk", "_one", "_two")


def windows(chunks: DataFrame, min_words: int) -> DataFrame:
    """_k, _h, first, last, wk: of every document the least stretches of touching chunks that have ``min_words`` words, one
    from each chunk on and one up to each chunk. Together they cover every stretch that has so many words.

    Every chunk has a word, so by the words before it in its run of touching chunks a stretch is a range of fewer than
    ``min_words`` of them; a row never holds more chunks than that, however long the document is.
    """
    doc = Window.partitionBy("_k", "_h").orderBy("first")
    gap = F.when(F.lag("last").over(doc) + 1 == F.col("first"), 0).otherwise(1)
    runs = chunks.select("_k", "_h", "first", "last", "words", "ck", gap.alias("gap")).withColumn("run", F.sum("gap").over(doc))
    run = Window.partitionBy("_k", "_h", "run")
    runs = runs.withColumn("upto", F.sum("words").over(run.orderBy("first"))).withColumn("before", F.col("upto") - F.col("words"))
    onward = run.orderBy("before").rangeBetween(0, min_words - 1)
    back = run.orderBy("upto").rangeBetween(1 - min_words, 0)
    ahead = F.struct("first", F.last("last").over(onward).alias("last"), F.collect_list("ck").over(onward).alias("cks"), (F.last("upto").over(onward) - F.col("before")).alias("n"))
    behind = F.struct(F.first("first").over(back).alias("first"), "last", F.collect_list("ck").over(back).alias("cks"), (F.col("upto") - F.first("before").over(back)).alias("n"))
    both = runs.select("_k", "_h", ahead.alias("ahead"), behind.alias("behind")).select("_k", "_h", F.inline(F.array("ahead", "behind")))
    key = F.concat_ws("-", F.hex(F.xxhash64("cks")), F.hex(F.xxhash64(F.lit("second"), "cks")))
    return both.where(F.col("n") >= min_words).select("_k", "_h", "first", "last", key.alias("wk")).dropDuplicates(["_k", "_h", "first", "last"])


def decisions(lines: DataFrame, min_words: int = MIN_WORDS, mean_lines: int = MEAN_LINES) -> DataFrame:
    """_k, _h, marks: for each document its chunks that go, and those that stay as first places of what goes elsewhere, in order.

    What goes repeats as a whole: a stretch of ``min_words`` words that stands at an earlier place too, not overlapping
    that place. Longer passages are covered by such stretches.
    """
    chunks = keep(chunk_table(lines, min_words, mean_lines), "chunks")
    spans = keep(windows(chunks, min_words), "windows")
    place = F.struct("_k", "_h", "first", "last")
    groups = spans.groupBy("wk").agg(F.count("*").alias("n"), F.min(place).alias("home")).where("n > 1")
    found = lookup(spans, groups, "wk", "n", spans.rows).where("n is not null")
    same_doc = F.col("_k").eqNullSafe(F.col("home._k")) & (F.col("_h") == F.col("home._h"))
    found = found.withColumn("again", ~(same_doc & (F.col("first") <= F.col("home.last")))).withColumn("home", same_doc & (F.col("first") == F.col("home.first")))
    found = found.where("again or home").select("_k", "_h", "first", F.col("last").alias("reach"), F.when(F.col("again"), F.col("last")).alias("gone_reach"))
    # a chunk lies in a stretch if one that begins no later reaches its end: running maxima over both, in order of place
    none = F.lit(None).cast("int")
    own = chunks.select("_k", "_h", "first", "last", "begin", "end", "ck", none.alias("reach"), none.alias("gone_reach"))
    rows = own.unionByName(found, allowMissingColumns=True)
    order = Window.partitionBy("_k", "_h").orderBy("first", F.col("last").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("reach", F.max("reach").over(order)).withColumn("gone_reach", F.max("gone_reach").over(order))
    rows = rows.where(F.col("last").isNotNull() & (F.col("last") <= F.col("reach"))).withColumn("gone", F.coalesce(F.col("last") <= F.col("gone_reach"), F.lit(False)))
    # blank lines between two chunks that go, go with them
    line = Window.partitionBy("_k", "_h").orderBy("first")
    following = lambda c: F.lead(c).over(line)
    upto = F.when(F.col("gone") & following("gone") & (following("first") == F.col("last") + 1), following("begin") - 1)
    rows = rows.withColumn("upto", F.coalesce(upto, F.col("end")))
    return rows.groupBy("_k", "_h").agg(F.sort_array(F.collect_list(F.struct("begin", "end", "upto", "ck", "gone"))).alias("marks"))


def once(value: Column, use) -> Column:
    """use(value) with the value computed once a row, however often a lambda inside reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, mean_lines: int = MEAN_LINES) -> DataFrame:
    """All columns of docs with repeated passages taken out of ``text``, and n_lines and n_removed (both long).

    The first place of a chunk, by (key, hash of the text, line), stays. Null text stays null with 0 lines; empty text stays. Very
    long texts are handled whole. A null key orders first and is otherwise like any key. Rows that repeat key and text
    are treated alike: none is the other's copy. Empty tables stay empty. Columns of docs named n_lines or n_removed are
    dropped first.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")])
    lines = keep(line_table(docs, key, text), "lines")
    decided = decisions(lines, min_words, mean_lines)
    own = docs.columns
    names = ("text_hash", "marks", "k", "h", "bad", "gone", "all_lines", "left", "ck", "lo", "hi")
    text_hash, marks, k, h, bad, gone, all_lines, left, ck, lo, hi = free([*own, "n_lines", "n_removed"], *names)
    whole = docs.withColumn(text_hash, F.xxhash64(text))
    here = F.col(key).eqNullSafe(F.col(k)) & (F.col(text_hash) == F.col(h))
    both = whole.join(decided.select(F.col("_k").alias(k), F.col("_h").alias(h), F.col("marks").alias(marks)), here, "left").select(*own, text_hash, marks)
    both = keep(both, "marked")
    forget(lines)
    # byte comparison: the least and the greatest text of a chunk's places are the same
    def texts(l: Column) -> Column:
        inside = lambda x: F.filter(F.slice(l, x["begin"] + 1, x["end"] - x["begin"] + 1), lambda y: y.rlike(r"[^\x20\x09-\x0D]"))
        return F.transform(marks, lambda x: F.struct(x["ck"].alias("ck"), F.array_join(inside(x), "\n").alias("body")))

    bodies = both.where(F.col(marks).isNotNull()).select(F.inline(once(_lines(F.col(text)), texts)))
    differ = keep(bodies.groupBy(F.col("ck").alias(ck)).agg(F.min("body").alias(lo), F.max("body").alias(hi)).where(F.col(lo) != F.col(hi)).select(ck), "differ")
    goes = F.filter(marks, lambda x: x["gone"])
    if differ.rows:  # hashes that collided: their places stay
        known = both.where(F.col(marks).isNotNull()).select(F.col(key).alias(k), F.col(text_hash).alias(h), F.explode(F.col(marks)["ck"]).alias(ck))
        known = known.join(differ, ck).groupBy(k, h).agg(F.collect_set(ck).alias(bad))
        both = both.join(known, here, "left")
        goes = F.filter(marks, lambda x: x["gone"] & ~F.coalesce(F.array_contains(bad, x["ck"]), F.lit(False)))

    def without(x: Column) -> Column:
        """The lines between the stretches that go: as many slices as stretches and one more."""
        n = F.size(x["gone"])

        def stretch(i: Column) -> Column:
            start = F.when(i > 0, F.get(x["gone"], i - 1)["upto"] + 1).otherwise(0)
            return F.slice(x["l"], start + 1, F.when(i < n, F.get(x["gone"], i)["begin"]).otherwise(F.size(x["l"])) - start)

        return F.flatten(F.transform(F.sequence(F.lit(0), n), stretch))

    both = both.withColumn(gone, goes)
    some = F.coalesce(F.size(gone) > 0, F.lit(False))
    breaks = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    both = both.withColumn(all_lines, breaks + 1).withColumn(left, F.when(some, once(F.struct(_lines(F.col(text)).alias("l"), F.col(gone).alias("gone")), without)))
    return both.select(
        *[F.when(some, F.array_join(left, "\n")).otherwise(F.col(c)).alias(c) if c == text else F.col(f"`{c}`") for c in own],
        F.when(F.col(text).isNull(), 0).otherwise(F.col(all_lines)).cast("long").alias("n_lines"),
        F.when(some, F.col(all_lines) - F.size(left)).otherwise(0).cast("long").alias("n_removed"),
    )
