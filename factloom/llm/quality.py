"""Quality rules, line first, as column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

#: White space that separates words, and the characters counted as symbols.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture. A short line with one of them fails.
BOILERPLATE = (
    "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "click here", "read more", "sign up", "log in", "subscribe to", "newsletter", "share this", "follow us",
    "enable javascript", "back to top", "skip to content", "lorem ipsum",
)
#: A line shorter than this (characters) can fail for its ending or as page furniture; a longer one is prose or symbols. An argument of ``judge``.
SHORT = 200
#: A document whose lines lose more than this share of their characters is rejected.
MOST_LOST = 0.5


def words(text: Column) -> Column:
    """Words of a whole text; null has none."""
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(text.isNull() | (bare == ""), F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RE))


def symbol_count(text: Column) -> Column:
    """The test in front spares most texts the rewriting."""
    return F.when(text.rlike(r"[#*$%&|<>]"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))).otherwise(0).cast("long")


def line_fails(line: Column, short_line: int = SHORT) -> Column:
    """Whether the rules remove a line; one shorter than ``short_line`` also for its ending or as furniture. Lines without a letter, with noise, in capitals, of navigation or furniture fail."""
    n = F.length(line)
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    noise = symbol_count(line) * 20 >= n  # navigation bars, tables of links, symbols after every word
    cries = F.when(line.contains("!"), F.length(line) - F.length(F.replace(line, F.lit("!"), F.lit("")))).otherwise(0) * 20 >= n
    capitals = (~line.rlike(r"\p{Ll}{2}")) & line.rlike(r"\p{Lu}{2}") & (letters >= 20)
    short = n < short_line
    furniture = short & F.lower(line).rlike("|".join(BOILERPLATE))
    unended = short & ~line.rlike(r"[.!?:;…。！？»”’\"')\]]\s*$")
    return (~line.rlike(r"\p{L}")) | noise | cries | capitals | furniture | unended


def judge(docs: DataFrame, text: str = "text", most_lost: float = MOST_LOST, short_line: int = SHORT) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and clean_text to docs.

    Base: n_words < 10 or 100 * n_repeat_words > 20 * n_words fails. Line-first verdict: ``line_fails`` is evaluated for
    every line, failing lines are left out of clean_text, and the document is rejected if they held more than
    ``most_lost`` of the characters. One narrow stage: no shuffle, no Python. Repeated five-word windows are found by
    their 64-bit hashes, sorted within the row, and only in texts that have any.

    Null text: no words, zero counts, base_failed, not kept, clean_text null. Empty text: likewise, clean_text empty.
    Very long texts are judged whole. Repeated rows are judged each, alike. Empty tables stay empty. Columns of docs
    named like a result are dropped first.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")
    own = [c for c in docs.columns if c.lower() not in names]
    # temporary columns are called like none of the input
    again, bag, size, hashes, twice, order, places, lines, full, left_lines, enough = free([*own, *names], "again", "bag", "size", "hashes", "twice", "order", "places", "lines", "full", "left_lines", "enough")
    t, w, n, h = F.col(again), F.col(bag), F.col(size), F.col(hashes)
    df = docs.select(*[F.col(f"`{c}`") for c in own], F.col(text).alias(again)).withColumn(bag, words(t))
    df = df.withColumn(size, F.size(bag).cast("int"))
    df = df.withColumn(hashes, F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))))
    df = df.withColumn(twice, F.coalesce(F.size(F.array_distinct(h)) < F.size(h), F.lit(False)))
    df = df.withColumn(order, F.when(F.col(twice), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    s = F.col(order)
    same = lambda x, y: y["h"].eqNullSafe(x["h"])
    again_at = F.filter(F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x["p"])), lambda p: p.isNotNull())
    df = df.withColumn(places, F.when(F.col(twice), F.array_sort(again_at)))
    step = lambda a, p: F.struct((a["c"] + (p + 5) - F.greatest(p, a["e"])).alias("c"), (p + 5).alias("e"))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("c"), F.lit(0).alias("e")), step, lambda a: a["c"])
    df = df.withColumn(lines, F.split(t, "\n", -1))
    df = df.withColumn(full, F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn(left_lines, F.filter(lines, lambda x: ~line_fails(x, short_line)))
    left = F.length(F.array_join(left_lines, ""))
    df = df.select(
        *[F.col(f"`{c}`") for c in own],
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.coalesce(symbol_count(t), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(F.size(full) - F.size(F.array_distinct(full)), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.coalesce(F.try_divide(left, F.length(F.array_join(lines, ""))) >= 1 - most_lost, F.lit(False)).alias(enough),
        F.array_join(left_lines, "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # one generated row a document: a filter on a result would otherwise be rewritten, copy by copy, down to the text
    result = F.struct(*names[:5], failed.alias("base_failed"), (~failed & F.col(enough)).alias("kept"), "clean_text")
    return df.select(*[F.col(f"`{c}`") for c in own], F.inline(F.array(result)))


#: The same for DuckDB, by words, windows and lines as rows.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             string_split(t, chr(10)) AS l, t FROM d),
g AS (SELECT doc_id, i, w[i] || chr(1) || w[i+1] || chr(1) || w[i+2] || chr(1) || w[i+3] || chr(1) || w[i+4] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 5) AS x(k) GROUP BY doc_id),
x AS (SELECT doc_id, l, len(l) AS n, len(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) AS s,
             len(regexp_replace(l, '[^\pL]', '', 'g')) AS a
      FROM (SELECT doc_id, unnest(l) AS l FROM w)),
k AS (SELECT doc_id, sum(n) AS n, sum(CASE WHEN
        NOT regexp_matches(l, '\pL') OR s * 20 >= n OR (n - len(replace(l, '!', ''))) * 20 >= n AND contains(l, '!')
        OR NOT regexp_matches(l, '\p{Ll}{2}') AND regexp_matches(l, '\p{Lu}{2}') AND a >= 20
        OR n < 200 AND regexp_matches(lower(l), '@FURNITURE@')
        OR n < 200 AND NOT regexp_matches(l, '[.!?:;…。！？»”’"'')\]]\s*$')
        THEN 0 ELSE n END) AS kept FROM x GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(list_aggregate(w.w, 'string_agg', '')) AS BIGINT) AS wc,
        CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(list_filter(w.l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
             - len(list_distinct(list_filter(w.l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, k.n AS chars, k.kept
      FROM w LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(kept / nullif(chars, 0) >= 0.5, false) AS kept
FROM b
""".replace("@FURNITURE@", "|".join(BOILERPLATE))
