"""Histograms, multimaps and their merges; component counts of patterns and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    """(key, n) tables -> their sum by key."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("n"))


def list_multimap(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Values of a key, the last first."""
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value)), asc=False), lambda x: x[value]).alias("values"))


def set_multimap(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def bag_multimap(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values of a key with their counts, as a map; two aggregations, so a hot key is summed before it is gathered."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("values"))


def keep_common(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows whose key occurs at least so often. The counts meet the rows in a semi-join, pre-aggregated."""
    return df.join(df.groupBy(key).count().where(F.col("count") >= least).select(key), key, "left_semi")


def keep_diverse(df: DataFrame, key: str, other: str, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows whose key comes with so many distinct others, the rest)."""
    good = df.select(key, other).distinct().groupBy(key).count().where(F.col("count") >= least).select(key)
    return df.join(good, key, "left_semi"), df.join(good, key, "left_anti")


def merge_keys(df: DataFrame, key: str, merges: dict[str, str]) -> DataFrame:
    """Rows of equal key merged column by column: sum, min, max, list (in order), set, any or every."""
    how = {"sum": F.sum, "min": F.min, "max": F.max, "list": lambda c: F.array_sort(F.collect_list(c)), "set": lambda c: F.array_sort(F.collect_set(c)), "any": F.bool_or, "every": F.bool_and}
    unknown = set(merges.values()) - set(how)
    if unknown:
        raise ValueError(f"unknown ways to merge: {sorted(unknown)}")
    return df.groupBy(key).agg(*[how[m](c).alias(c) for c, m in merges.items()])


def frequent_with_examples(df: DataFrame, key: str, example: str, above: int = 100, show: int = 5) -> DataFrame:
    """key, n, examples: keys that occur more than ``above`` times with their first examples in order.

    The first ones are picked by ranks within the key, so no group is gathered as a whole; a rank limit cuts every
    partition's share before the shuffle.
    """
    counts = df.groupBy(key, example).agg(F.count("*").alias("m"))
    totals = counts.groupBy(key).agg(F.sum("m").alias("n")).where(F.col("n") > above)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(example))
    first = counts.where(F.col(example).isNotNull()).select(key, example).withColumn("rank", rank).where(F.col("rank") <= show)
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return totals.join(lists, key, "left").select(key, "n", F.coalesce("examples", F.array().cast(lists.schema["examples"].dataType)).alias("examples"))


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in an order; Spark keeps n rows of each partition."""
    return df.orderBy(*order).limit(n)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b doesn't have; nulls are equal."""
    return a.subtract(b)


def union_all(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def search(df: DataFrame, column: str, words: str) -> DataFrame:
    """Rows whose text contains the words."""
    return df.where(F.col(column).contains(words))


def with_extraction(sentences: DataFrame, extractions: DataFrame, key: str, after=None) -> DataFrame:
    """Sentences that have an extraction, and stand behind ``after`` if it is given."""
    rows = sentences if after is None else sentences.where(F.col(key) > F.lit(after))
    return rows.join(extractions.select(key).distinct(), key, "left_semi")


def pattern_components(patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """kind (edge, tag), component, n over pattern strings, which are made once."""
    found = lambda kind, regex: F.transform(F.regexp_extract_all(F.col(column), F.lit(regex), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("component")))
    both = F.concat(found("edge", r"[<>]([\w:]+)[<>]"), found("tag", r"postag=(\w+)"))
    # repeated patterns are counted before they are taken apart
    each = patterns.groupBy(F.col(column)).agg(F.count("*").alias("n"))
    return each.select("n", F.inline(both)).groupBy("kind", "component").agg(F.sum("n").alias("n"))


def sentence_components(edges: DataFrame, tokens: DataFrame) -> DataFrame:
    """kind (edge, tag, piece), component, n over edges (sent, src, dst, label) and tokens (sent, node, postag); a piece is ``tag label tag``, both ways."""
    tag = lambda a, t: tokens.select("sent", F.col("node").alias(a), F.col("postag").alias(t))
    full = edges.join(tag("src", "ts"), ["sent", "src"]).join(tag("dst", "td"), ["sent", "dst"])
    pieces = full.select(F.explode(F.array(F.concat_ws(" ", "ts", F.concat(F.lit(">"), "label", F.lit(">")), "td"), F.concat_ws(" ", "td", F.concat(F.lit("<"), "label", F.lit("<")), "ts"))).alias("component"))
    rows = edges.select(F.lit("edge").alias("kind"), F.col("label").alias("component"))
    rows = rows.unionByName(tokens.select(F.lit("tag").alias("kind"), F.col("postag").alias("component"))).unionByName(pieces.select(F.lit("piece").alias("kind"), "component"))
    return rows.groupBy("kind", "component").agg(F.count("*").alias("n"))
