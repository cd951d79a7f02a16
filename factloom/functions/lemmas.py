"""Lemmas by suffix rules that are learned from pairs of form and lemma.

A rule takes some letters off a word's end and puts others on. Which rule a word gets is told by the longest of its suffixes
that has one; a word seen in training is a suffix of its own (with ``^`` in front).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the longest suffix, and how often a suffix must have been seen with a rule.
LONGEST, LEAST = 6, 2


def _suffixes(word: Column, longest: int, shortest: Column) -> Column:
    """The suffixes of a word from the shortest on, and the whole word with ``^``."""
    size = F.length(word)
    sizes = F.when(shortest <= F.least(size, F.lit(longest)), F.sequence(shortest, F.least(size, F.lit(longest)))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(sizes, lambda k: F.right(word, k)), F.array(F.concat(F.lit("^"), word)))


def learn(pairs: DataFrame, form: str = "form", lemma: str = "lemma", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """suffix, strip, put, n: of each suffix the rule that most pairs with it have, ties by fewer letters off, then by text.

    Distinct pairs count once, in lower case. A suffix needs ``least`` pairs with its rule, a whole word one. Pairs with a
    null or of several words teach nothing; an empty table gives no rules.
    """
    word, base = F.lower(form), F.lower(lemma)
    rows = pairs.select(word.alias("w"), base.alias("l")).where("w <> '' AND l <> '' AND w NOT LIKE '% %' AND l NOT LIKE '% %'").distinct()
    sizes = F.sequence(F.lit(0), F.least(F.length("w"), F.length("l")))
    common = F.array_max(F.filter(sizes, lambda k: F.left("w", k) == F.left("l", k)))
    rows = rows.withColumn("strip", F.length("w") - common).withColumn("put", F.substring("l", common + 1, F.length("l")))
    seen = rows.select("strip", "put", F.explode(_suffixes(F.col("w"), longest, F.greatest("strip", F.lit(1)))).alias("suffix"))
    counts = seen.groupBy("suffix", "strip", "put").agg(F.count("*").alias("n")).where((F.col("n") >= least) | F.col("suffix").startswith("^"))
    best = counts.groupBy("suffix").agg(F.min(F.struct((-F.col("n")).alias("less"), "strip", "put")).alias("x"))
    return best.select("suffix", "x.strip", "x.put", (-F.col("x.less")).alias("n"))


def lemmatize(words: DataFrame, rules: DataFrame, column: str = "word", result: str = "lemma", longest: int = LONGEST) -> DataFrame:
    """words (distinct texts in ``column``) with their lemma: the longest suffix with a rule decides; without one a word is its
    own lemma. Null stays null."""
    low = F.lower(column)
    rows = words.select(*[c for c in words.columns if c != result], low.alias("_w"), F.explode_outer(_suffixes(low, longest, F.lit(1))).alias("suffix"))
    met = rows.join(rules.select("suffix", "strip", "put"), "suffix", "left")
    rule = F.max_by(F.when(F.col("strip").isNotNull(), F.struct("strip", "put")), F.when(F.col("strip").isNotNull(), F.length("suffix") + F.when(F.col("suffix").startswith("^"), 1000).otherwise(0)))
    best = met.groupBy(*[c for c in words.columns if c != result], "_w").agg(rule.alias("rule"))
    made = F.concat(F.left("_w", F.length("_w") - F.col("rule.strip")), F.col("rule.put"))
    return best.select(*[c for c in words.columns if c != result], F.coalesce(made, F.col("_w")).alias(result))


class Lemmas:
    """Rules as sorted arrays, one for each length of suffix, for all words of a batch at once."""

    def __init__(self, rules: list[tuple[str, int, str]]):
        self.changes = list(dict.fromkeys((strip, put) for _, strip, put in rules))
        number = {x: i for i, x in enumerate(self.changes)}
        by: dict[int, list[tuple[str, int]]] = {}
        for suffix, strip, put in rules:
            key = suffix[1:] if suffix.startswith("^") else suffix
            by.setdefault(-len(key) if suffix.startswith("^") else len(key), []).append((key, number[strip, put]))
        self.tables = {size: (np.array([k for k, _ in own], dtype=str), np.array([n for _, n in own])) for size, own in ((s, sorted(x)) for s, x in by.items())}

    def __call__(self, words: list[str]) -> list[str]:
        if not words:
            return []
        distinct, where = np.unique(np.char.lower(np.array(words, dtype=str)), return_inverse=True)
        size = np.char.str_len(distinct)
        width = max(1, int(size.max()))
        points = distinct.astype(f"U{width}").view(np.uint32).reshape(len(distinct), width)
        rule = np.full(len(distinct), -1)
        # whole words first, then suffixes from the longest on
        for length in sorted(self.tables, key=lambda k: (k > 0, -abs(k))):
            keys, numbers = self.tables[length]
            n = abs(length)
            at = np.flatnonzero((rule < 0) & (size == n if length < 0 else size >= n))
            if len(at) and n:
                ends = np.take_along_axis(points[at], size[at][:, None] - n + np.arange(n), 1)
                text = np.ascontiguousarray(ends).view(f"U{n}").reshape(-1)
                place = np.minimum(np.searchsorted(keys, text), len(keys) - 1)
                hit = keys[place] == text
                rule[at[hit]] = numbers[place[hit]]
        out = distinct.astype(object)
        for i in np.unique(rule[rule >= 0]).tolist():
            strip, put = self.changes[i]
            at = np.flatnonzero(rule == i)
            cut = points[at].copy()
            cut[np.arange(width) >= (size[at] - strip)[:, None]] = 0
            out[at] = np.char.add(np.ascontiguousarray(cut).view(f"U{width}").reshape(-1), put).astype(object)
        return out[where.reshape(-1)].tolist()
