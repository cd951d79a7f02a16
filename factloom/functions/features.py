"""Confidence features and the logistic score, as column expressions over extraction rows (see operators.extract.SCHEMA)."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import free

#: Hypothetical verbs, tags of prepositions, tags that open and close an argument.
HYPOTHETICAL = ("can", "would", "could", "might")
PREP_TAGS = ("IN", "TO", "WP")
OPEN_TAGS, CLOSE_TAGS = ("PR", "NN", "DT", "CD", "JJ"), ("NN", "CD", "JJ")
#: Beginnings of a relation's last word and second arguments that say nothing together.
VACUOUS = (("this", "way"), ("went", "public"), ("for", "example"), ("with", "eye"), ("in", "fact"), ("for", "use"), ("for", "us"), ("were", "able"), ("in", "part"), ("be", "part"), ("is", "part"))


def counted() -> Column:
    """Whether no token is missing, so that each one's place is its index."""
    return F.col("tokens.idx") == F.sequence(F.lit(0), F.size("tokens") - 1)


def near(low: Column, high: Column, whole: Column) -> Column:
    """The tokens among which those of the places from low to before high are: just these where the tokens are counted
    (``whole``), or else all, as places may be missing; what is looked for is compared in any case."""
    return F.when(whole & (low >= 0) & (high >= low), F.slice("tokens", low + 1, high - low)).otherwise(F.col("tokens"))


def tags(at: Column, whole: Column) -> Column:
    """Tags of the tokens inside a part's span."""
    return F.transform(F.filter(near(at["s"], at["e"], whole), lambda t: (t["idx"] >= at["s"]) & (t["idx"] < at["e"])), lambda t: t["postag"])


def shared(whole: Column | None = None) -> dict[str, Column]:
    """What several features look at, each to be computed once a row: the tags of the parts, the sentence's text, the last token left of the first argument and the first one behind the second (null if there is none), and the relation's first.

    ``whole``: a column that holds ``counted``.
    """
    a1, r, a2 = F.col("arg1"), F.col("rel"), F.col("arg2")
    whole = counted() if whole is None else whole
    own, first = near(F.array_min(r["idx"]), F.array_max(r["idx"]) + 1, whole), F.get(r["idx"], F.lit(0))
    sentence, left = F.array_join("tokens.text", " "), F.least(a1["s"], F.size("tokens"))
    return {
        "arg1_tags": tags(a1, whole), "arg2_tags": tags(a2, whole), "rel_tags": F.transform(F.filter(own, lambda t: F.array_contains("rel.idx", t["idx"])), lambda t: t["postag"]),
        "sentence": sentence,
        "before": F.try_element_at(F.filter(near(F.greatest(left - 1, F.lit(0)), left, whole), lambda t: t["idx"] < a1["s"]), F.lit(-1)),
        "behind": F.get(F.filter(near(a2["e"], a2["e"] + 1, whole), lambda t: t["idx"] >= a2["e"]), F.lit(0)),
        "rel_first": F.get(F.filter(near(first, first + 1, whole), lambda t: t["idx"] == first), F.lit(0)),
    }


def _bad(text: Column) -> Column:
    """More than five capitals, or fewer than two vowels and digits; only U+0130 holds a vowel in lower case besides the vowels."""
    vowel = "[aeiouyAEIOUY\u01300-9]"
    return text.rlike("[A-Z](?:[^A-Z]*+[A-Z]){5}") | ~text.rlike(f"(?s){vowel}.*{vowel}")


def _cased(word: str) -> list[str]:
    """The word in every case of its letters: what is equal to it in lower case, without changing each text."""
    return ["".join(x) for x in product(*((c.lower(), c.upper()) for c in word))]


def _nvn(own: Column) -> Column:
    return F.array_join(F.transform(own, lambda t: F.when(t.startswith("NN"), "N").when(t.startswith("VB"), "V").otherwise("x")), "").rlike("N.*V.*N")


def _appositive(at: Column) -> Column:
    ends = lambda x: (x == at["s"]) | (x == at["e"] - 1)
    return F.exists("deps", lambda d: (d["label"] == "appos") & (ends(d["src"]) | ends(d["dst"])))


def features(known: dict[str, Column] | None = None) -> dict[str, Column]:
    """Name of the weight -> 0/1 (or the extractor's confidence). The odd ones are as in the trained weights: the question
    mark is looked for in the extraction, and ``rel starts with be`` compares the first token with "be ".

    ``known``: columns that hold what ``shared`` computes; ``measured`` makes and uses them.
    """
    a1, r, a2 = F.col("arg1"), F.col("rel"), F.col("arg2")
    own = shared() if known is None else known
    sentence, before, behind = own["sentence"], own["before"], own["behind"]
    t1, tr, t2 = own["arg1_tags"], own["rel_tags"], own["arg2_tags"]
    last = F.substring_index(r["text"], " ", -1)
    idx = F.array_sort(F.array_distinct(F.concat(a1["idx"], r["idx"], a2["idx"])))
    bare = F.regexp_replace(F.regexp_replace(r["text"], "^be ", ""), r" \w+$", "")
    verb = lambda t: t.startswith("VB")
    rel_words = F.split(F.lower(r["text"]), " ")
    hyp = F.exists("tokens", lambda t: F.coalesce(F.lower(t["text"]).isin(*HYPOTHETICAL) & ~F.array_contains(rel_words, F.lower(t["text"])), F.lit(False)))
    said = sentence.rlike(rf"(?i)(?:\A| )(?:{'|'.join(HYPOTHETICAL)})(?: |\z)")
    first, final = lambda t: F.get(t, F.lit(0)), lambda t: F.try_element_at(t, F.lit(-1))
    out = {
        "sentence has question mark": F.concat_ws(" ", a1["text"], r["text"], a2["text"]).contains("?"),
        "sentence is imperative": F.exists(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: verb(F.get("tokens", i)["postag"]) & ((i == 0) | (F.get("tokens", i - 1)["postag"] == ","))),
        "arg2 contains infinitive": F.exists(F.zip_with(t2, F.slice(t2, 2, F.size(t2)), lambda p, t: (p == "TO") & verb(t)), lambda x: F.coalesce(x, F.lit(False))),
        "rel is contiguous": sentence.contains(r["text"]),
        "prep right before arg1": F.coalesce(before["postag"].isin(*PREP_TAGS), F.lit(False)),
        "rel starts with be": F.coalesce(own["rel_first"]["text"].startswith("be "), F.lit(False)),
        "prep right after arg2": F.coalesce(behind["postag"].isin(*PREP_TAGS), F.lit(False)),
        "arg1 is proper": F.forall(t1, lambda t: t.startswith("NNP")),
        "arg2 is proper": F.forall(t2, lambda t: t.startswith("NNP")),
        "sentence starts with extraction": F.least(a1["s"], r["s"], a2["s"]) == 0,
        "sentence begins with arg1": a1["s"] == 0,
        "sentence ends with arg2": F.forall("tokens", lambda t: ~F.coalesce(t["idx"] >= a2["e"], F.lit(False)) | t["postag"].isin(".", "?")),
        "pattern confidence": F.least(F.lit(1.0), F.col("pattern_confidence")),
        "arg2 before arg1": a2["e"] <= a1["s"],
        "arg2 before rel": a2["e"] <= r["s"],
        "args start and end with noun": F.coalesce(first(t1).isin(*OPEN_TAGS) & first(t2).isin(*OPEN_TAGS) & final(t1).isin(*CLOSE_TAGS) & final(t2).isin(*CLOSE_TAGS), F.lit(False)),
        "if right before arg1": F.coalesce(before["text"].isin(*_cased("if")), F.lit(False)),
        "arg1 contains pronoun": F.exists(t1, lambda t: t.startswith("PRP")),
        "arg2 contains pronoun": F.exists(t2, lambda t: t.startswith("PRP")),
        "rel ends with of": last.isin(*_cased("of")),
        "rel contains verb": F.exists(tr, verb),
        "rel contains gerund": F.exists(tr, lambda t: t == "VBG"),
        "arg1 bad characters": _bad(a1["text"]),
        "rel bad characters": _bad(r["text"]),
        "arg2 bad characters": _bad(a2["text"]),
        "long relation": F.size(F.split(r["text"], " ")) > 10,
        "hyp words in rel": F.when(r["text"].isNull(), None).when(~said, False).otherwise(hyp),
        "vacuous extraction": (F.size(F.split(a2["text"], " ")) <= 2) & F.reduce(F.array(*[last.startswith(x) & F.array_contains(F.split(F.lower(a2["text"]), " "), y) for x, y in VACUOUS]), F.lit(False), lambda a, b: a | b),
        "prep in arg2": F.exists(t2, lambda t: t.isin(*PREP_TAGS)),
        "noun-verb-noun in arg1": _nvn(t1),
        "noun-verb-noun in arg2": _nvn(t2),
        "arg1 borders appositive": _appositive(a1),
        "arg2 borders appositive": _appositive(a2),
        "gap of 10 in rel": F.exists(F.zip_with(idx, F.slice(idx, 2, F.size(idx)), lambda x, y: y - x > 10), lambda x: F.coalesce(x, F.lit(False))),
        "non-contiguous rel": ~sentence.contains(bare),
        "nn edges in pattern": F.array_contains("pattern_labels", "nn"),
        "semantic constraints in pattern": F.col("semantic"),
        "prep mismatch in pattern": F.col("prep_mismatch"),
    }
    return {name: c.cast("double") for name, c in out.items()}


def further_features() -> dict[str, Column]:
    """Features that no weight of the trained model uses; they can be trained like the others."""
    a1, r, a2 = F.col("arg1"), F.col("rel"), F.col("arg2")
    begin, end = F.least(a1["s"], r["s"], a2["s"]), F.greatest(a1["e"], r["e"], a2["e"])
    closed = ~F.exists("tokens", lambda t: t["idx"] >= end)
    out = {"extraction spans sentence": (begin == 0) & closed, "sentence ends with extraction": closed}
    return {name: c.cast("double") for name, c in out.items()}


#: The weights of the trained model; ``pattern confidence`` is the extractor's own.
DEFAULT_WEIGHTS = {
    "args start and end with noun": 0.030924657084179144,
    "rel ends with of": 0.1013506657501542,
    "arg1 contains pronoun": 0.19630801348782667,
    "arg2 contains pronoun": -0.13341646099789348,
    "long relation": -0.3547145229191737,
    "gap of 10 in rel": -0.34306426484946456,
    "vacuous extraction": -0.6389807893982924,
    "nn edges in pattern": 0.9130032848389,
    "arg1 is proper": 0.07933280909554899,
    "Intercept": 0.0,
    "sentence begins with arg1": -0.1588407285556643,
    "if right before arg1": -1.2206208992816086,
    "arg2 is proper": -0.04306420146120506,
    "arg2 borders appositive": -0.0017006187220647805,
    "rel contains gerund": -0.26200297625650837,
    "arg1 borders appositive": -0.13448972417475485,
    "noun-verb-noun in arg1": 0.0,
    "prep right after arg2": 0.19212879336967245,
    "prep in arg2": 0.16539493294341892,
    "arg2 contains infinitive": -0.0,
    "prep mismatch in pattern": -0.20092201136389673,
    "sentence is imperative": 0.11745202578145564,
    "hyp words in rel": -0.1449927441123399,
    "sentence ends with arg2": 0.11610654106632967,
    "noun-verb-noun in arg2": 0.07217080739835992,
    "rel is contiguous": 0.12562188545360878,
    "non-contiguous rel": -0.1849662870655201,
    "semantic constraints in pattern": -0.4343558913425681,
    "pattern confidence": 0.43411514029724824,
    "arg1 bad characters": -0.40339032821185783,
    "sentence starts with extraction": 0.18854224217974247,
    "arg2 bad characters": -0.009939551407472108,
    "rel contains verb": 0.4757113580400253,
    "rel starts with be": 0.0,
    "prep right before arg1": -0.2350155331052106,
    "sentence has question mark": 0.0,
    "arg2 before arg1": -0.35791735399208685,
    "arg2 before rel": -0.023882392179128745,
    "rel bad characters": -0.11794120943690224,
}


def confidence(weights: dict[str, float] | None = None, known: dict[str, Column] | None = None) -> Column:
    """1 / (1 + exp(-(intercept + sum of weight times feature))); without weights given (None) the default ones."""
    weights = DEFAULT_WEIGHTS if weights is None else weights
    own = features(known)
    total = F.lit(float(weights.get("Intercept", 0.0)))
    for name, w in weights.items():
        if name != "Intercept" and w:
            # files of other origin name the extractor's confidence after their extractor
            feature = own["pattern confidence"] if name not in own and name.endswith(" confidence") else own[name]
            total = total + feature * float(w)
    return 1 / (1 + F.exp(-total))


def measured(rows: DataFrame, columns: Callable[[dict[str, Column]], dict[str, Column]]) -> DataFrame:
    """rows with further columns, which ``columns`` makes from what the features share; that is computed once a row, below
    them, and leaves again. Columns of rows named like a new one are replaced."""
    [whole] = free(rows.columns, "counted")
    parts = shared(F.col(f"`{whole}`"))
    names = dict(zip(parts, free([*rows.columns, whole], *parts), strict=True))
    new = columns({k: F.col(f"`{n}`") for k, n in names.items()})
    wide = rows.withColumn(whole, counted()).withColumns({names[k]: c for k, c in parts.items()})
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in new]
    return wide.select(*kept, *[c.alias(n) for n, c in new.items()])
