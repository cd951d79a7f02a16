"""Conversations brought back to a legal order of roles: faults by windows, the cheapest edits by a fold over sorted turns.

A legal order is nothing, or pairs of a user's and an assistant's turn with at most one system turn before them. The fold
carries four states, each a (cost, audit, steps) struct or null: nothing kept yet (E), and a system (S), user (U) or
assistant (A) turn kept last. Costs and letters decide by ``least``: a struct's cost comes first, then its audit. Two ways to
a state with equal costs differ before either ends (what one has more costs more), so the least way is the least so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, UNMENDED = 3, 4, 3, 3
#: Turn numbers that one fold covers; longer conversations are folds of folds.
CHUNK = 256
SPACE = " \t\n\x0b\f\r"
STATES = ("E", "S", "U", "A")
STATE = "struct<cost:bigint,audit:string,steps:string>"
FOLD = f"struct<E:{STATE},S:{STATE},U:{STATE},A:{STATE}>"


def _state(cost, audit, steps) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).alias("audit"), F.lit(steps).alias("steps"))


def _after(x: Column, cost, letters, steps=None) -> Column:
    """State x with more edits; null stays null."""
    letters = F.lit(letters)
    steps = letters if steps is None else F.lit(steps)
    return F.when(x.isNotNull(), F.struct((x["cost"] + cost).alias("cost"), F.concat(x["audit"], letters).alias("audit"), F.concat(x["steps"], steps).alias("steps")))


def _row(acc: Column, turn: Column) -> Column:
    """All four states after one distinct turn: its first copy may be kept, given another role or deleted, other copies are deleted.

    An insertion stands only before a turn that stays: before a deleted one it costs the same and reads later. One is
    enough, as a second one would bring back the role before.
    """
    gone = F.repeat(F.lit("D"), turn["others"].cast("int"))
    extra = DELETE * turn["others"]
    late = F.when(turn["truncated"], UNMENDED).otherwise(0)

    def stays(base: Column, initial: str) -> Column:
        own = turn["initial"] == initial
        letter = F.when(own, "K").otherwise("R")
        return _after(base, late + F.when(own, 0).otherwise(REROLE) + extra, F.concat(letter, gone), letter)

    def inserted(x: Column) -> Column:
        return _after(x, INSERT, "I")

    def deleted(x: Column) -> Column:
        return _after(x, DELETE + extra, F.concat(F.lit("D"), gone), "D")

    e, s, u, a = (acc[k] for k in STATES)
    free = F.struct(
        deleted(e).alias("E"),
        F.least(deleted(s), F.when(turn["initial"] == "s", _after(e, late + extra, F.concat(F.lit("K"), gone), "K"))).alias("S"),
        F.least(deleted(u), stays(F.least(e, s, a, inserted(u)), "u")).alias("U"),
        F.least(deleted(a), stays(F.least(u, inserted(e), inserted(s), inserted(a)), "a")).alias("A"),
    )
    forced = F.struct(*[_after(acc[k], extra, gone, "").alias(k) for k in STATES])
    return F.when(turn["free"], free).otherwise(forced)


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _from(state: str) -> Column:
    """The fold's beginning in one state."""
    return F.struct(*[(_state(0, "", "") if k == state else _null(STATE)).alias(k) for k in STATES])


def _chained(acc: Column, folds: Column) -> Column:
    """States after a chunk, from the states before it and its folds from each of them."""

    def both(a: Column, b: Column) -> Column:
        return F.when(
            a.isNotNull() & b.isNotNull(),
            F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"), F.concat(a["steps"], b["steps"]).alias("steps")),
        )

    return F.struct(*[F.least(*[both(acc[start], folds[i][end]) for i, start in enumerate(STATES)]).alias(end) for end in STATES])


def _total(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + value(r))


def repair(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired (array of role and text) of each conversation.

    Turns are taken by number, null first, ties by role and text. Equal turns of one number are counted before anything is
    shuffled as text; faults come from a window over equal role and text; turns whose numbers share a chunk of ``chunk``
    numbers are folded together from each of the four states (those without a number, below ``chunk`` or negative are the
    first chunk, which begins with nothing only), and a second fold joins the chunks. So the audits of a long conversation
    are made by many tasks. Its repaired turns are one value, as its digest needs them, within Spark's limit for a value.

    Null role or text is one blank, an empty role has no initial. A null key is a conversation of its own. Very long texts
    are judged whole. Repeated turns are duplicates. Of equally cheap edits the ASCII-least letters are taken. An empty
    table gives an empty result. Other columns are ignored.
    """
    number, said, spoke = F.col("turn"), F.col("text"), F.col("role")
    rows = turns.select(F.col(key).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    end = F.rtrim(said, F.lit(SPACE))
    first = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(number.asc_nulls_first())) == 1
    rows = rows.select("conv", "turn", "role", "text", "n", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open"), first.alias("first"))
    free = F.col("first") & ~F.col("blank")
    initial = F.left(spoke, F.lit(1))
    rows = rows.select(
        "conv", F.when(number >= chunk, number - number % chunk).otherwise(0).alias("chunk"),
        F.struct(
            "turn", "role", "text", "n", "blank", free.alias("free"), (free & F.col("open")).alias("truncated"), (F.col("n") - free.cast("long")).alias("others"),
            F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"),
        ).alias("row"),
    )
    chunks = rows.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    starts = F.when(F.col("chunk") == 0, F.array(_from("E"))).otherwise(F.array(*[_from(s) for s in STATES]))
    narrow = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in ("free", "truncated", "others", "initial")]))
    chunks = chunks.withColumn("narrow", narrow)
    chunks = chunks.select("conv", F.struct("chunk", "rows", F.transform(starts, lambda s: F.aggregate(F.col("narrow"), s, _row)).alias("folds")).alias("part"))
    whole = chunks.groupBy("conv").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    # a part's folds hold the states that its chunk can begin with; get() gives null for the others
    whole = whole.select(
        "conv", F.flatten(F.transform("parts", lambda p: p["rows"])).alias("rows"),
        F.aggregate(F.transform("parts", lambda p: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(p["folds"], i))), _from("E"), _chained).alias("ways"),
    )
    ways = F.col("ways")
    best = F.least(ways["E"], ways["A"], _after(ways["U"], INSERT, "I"), _after(ways["S"], 2 * INSERT, "II"))
    whole = whole.select("conv", "rows", best.alias("best"))
    numbers = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    pairs = F.aggregate(
        "rows", F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, r: F.struct(r["initial"].alias("last"), (a["n"] + r["n"] - 1 + F.when((a["last"] == "") | F.concat(a["last"], r["initial"]).isin("su", "ua", "au"), 0).otherwise(1)).alias("n")),
    )
    steps = F.col("best")["steps"]
    whole = whole.select(
        "conv", numbers.alias("numbers"), F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), pairs["n"].alias("illegal"),
        _total(F.col("rows"), lambda r: F.when(r["blank"], r["n"]).otherwise(0)).alias("blank"),
        _total(F.col("rows"), lambda r: F.when(r["blank"], 0).otherwise(r["others"])).alias("duplicate"),
        _total(F.col("rows"), lambda r: r["truncated"].cast("long")).alias("truncated"),
        F.arrays_zip(
            F.transform(F.filter("rows", lambda r: r["free"]), lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("row"),
            F.filter(F.split(F.translate(steps, "I", ""), ""), lambda x: x != "").alias("step"),
            F.split(steps, "[KRD]").alias("before"),
        ).alias("edits"),
    )
    made = F.struct(_null("string").alias("role"), F.lit("").alias("text"))

    def emitted(x: Column) -> Column:
        own = F.struct(F.when(x["step"] == "K", x["row"]["role"]).alias("role"), x["row"]["text"].alias("text"))
        return F.concat(F.array_repeat(made, F.length(x["before"])), F.when(x["step"].isin("K", "R"), F.array(own)).otherwise(F.array().cast("array<struct<role:string,text:string>>")))

    whole = whole.withColumn("kept", F.flatten(F.transform("edits", emitted)))
    lead = F.startswith(F.coalesce(F.get("kept", F.lit(0))["role"], F.lit("")), F.lit("s")).cast("int")
    whole = whole.withColumn("lead", lead)
    role_at = lambda r, i: F.coalesce(r["role"], F.when((i - F.col("lead")) % 2 == 0, "user").otherwise("assistant"))
    return whole.select(
        F.col("conv").alias(key), F.coalesce(F.array_max("numbers") - F.array_min("numbers") + 1 - F.size(F.array_distinct("numbers")), F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.transform("kept", lambda r, i: F.struct(role_at(r, i).alias("role"), r["text"].alias("text"))).alias("repaired"),
    )


def damage(turns: DataFrame) -> DataFrame:
    """Turns with the faults of a test, by crc32 of conv_id:turn modulo 20; nulls count as one blank.

    0 drops a turn, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes the user speak. Rows alike are treated
    alike, long and empty texts as any other; an empty table stays empty; other columns are left out.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """What repairing the damaged conversations finds, for every conv_id of the table: counts, cost, audit and a digest of the repaired turns."""
    found = repair(damage(conversations))
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = found.select(F.col("conv_id").alias("found"), *counts, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    ids = conversations.select("conv_id").distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
