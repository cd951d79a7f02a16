"""Small column functions: token ranges, argument clean-up, soft equality of facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token ranges are half open: structs with s and e, or any pair of integer columns.


def borders(a: Column, b: Column) -> Column:
    return (a["e"] == b["s"]) | (b["e"] == a["s"])


def intersects(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def superset(a: Column, b: Column) -> Column:
    return (a["s"] <= b["s"]) & (b["e"] <= a["e"])


def union(a: Column, b: Column) -> Column:
    """The least range over both."""
    return F.struct(F.least(a["s"], b["s"]).alias("s"), F.greatest(a["e"], b["e"]).alias("e"))


def distance(a: Column, b: Column) -> Column:
    """Tokens from the end of one to the start of the other, 0 if they touch or overlap."""
    return F.greatest(b["s"] - a["e"], a["s"] - b["e"], F.lit(0))


def soft_match(arg1: tuple[Column, Column], arg2: tuple[Column, Column], lemmas: tuple[Column, Column]) -> Column:
    """Two facts say the same: each pair of arguments contains the other way round or this way, and the relation lemmas are the same set."""
    either = lambda p: p[0].contains(p[1]) | p[1].contains(p[0])
    a, b = (F.array_sort(F.array_distinct(x)) for x in lemmas)
    return either(arg1) & either(arg2) & (a == b)


def proper(tags: Column) -> Column:
    """Tags of a proper argument: determiners, prepositions and proper nouns, one of them at least."""
    return F.forall(tags, lambda t: t.isin("DT", "IN", "NNP", "NNPS")) & F.exists(tags, lambda t: t.isin("NNP", "NNPS"))


def strip(words: Column, by: Column, drop: Column) -> Column:
    """Words whose counterpart in ``by`` (tags or lemmas) isn't among ``drop``."""
    pairs = F.filter(F.arrays_zip(words.alias("w"), by.alias("b")), lambda p: ~F.array_contains(drop, p["b"]))
    return F.transform(pairs, lambda p: p["w"])


def strip_matching(words: Column, by: Column, regex: str) -> Column:
    pairs = F.filter(F.arrays_zip(words.alias("w"), by.alias("b")), lambda p: ~p["b"].rlike(f"^(?:{regex})$"))
    return F.transform(pairs, lambda p: p["w"])


def clean_argument(words: Column, tags: Column) -> Column:
    """Text of an argument without determiners."""
    return F.array_join(strip(words, tags, F.array(F.lit("DT"))), " ")


def connections(deps: Column, a: Column, b: Column) -> Column:
    """Edges (structs label, src, dst) between the tokens of two parts (arrays of places), either way."""
    contains = F.array_contains
    return F.filter(deps, lambda d: (contains(a, d["src"]) & contains(b, d["dst"])) | (contains(b, d["src"]) & contains(a, d["dst"])))
