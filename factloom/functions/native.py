"""Graph columns: codec, collapsing, tags and templates as column expressions; no Python runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token of the serial form: text, tag, place and offset, joined by underscores.
_NODE = r"(.*?_[^_\s]+?_\d+_-?\d+)"
_EDGE = rf"([\w:]+)\({_NODE}, {_NODE}\)(?:; |$)"
_HEAD = r"^(?:\(\S*_[^_\s]+_\d+_-?\d+\), )+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once a row however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_graph(column: str | Column) -> Column:
    """struct(tokens, deps) of a graph string, null if it isn't one (no edge, or something between the edges).

    One search finds the edges; they are the whole string if their lengths add up to it. An edge is cut at its first
    parenthesis and its only comma, and a token at its last three underscores; more commas are left to an expression.
    """
    g = F.col(column) if isinstance(column, str) else column
    place = lambda n: F.substring_index(F.substring_index(n, "_", -2), "_", 1).cast("int")
    token = lambda n: F.struct(
        place(n).alias("idx"), F.left(n, F.length(n) - F.length(F.substring_index(n, "_", -3)) - 1).alias("text"), F.substring_index(F.substring_index(n, "_", -3), "_", 1).alias("postag"), F.substring_index(n, "_", -1).cast("int").alias("offset"),
    )

    def ends(e: Column, label: Column, inner: Column) -> Column:
        plain = F.length(F.substring_index(inner, ", ", 1)) + F.length(F.substring_index(inner, ", ", -1)) + 2 == F.length(inner)
        part = lambda k: F.when(plain, F.substring_index(inner, ", ", k)).otherwise(F.regexp_extract(e, _EDGE, 2 if k > 0 else 3))
        return F.struct(label.alias("label"), part(1).alias("src"), part(-1).alias("dst"))

    def edge(e: Column) -> Column:
        inner = lambda n: F.substring(e, n + 2, F.length(e) - n - F.when(F.endswith(e, F.lit("; ")), 4).otherwise(2))
        return once(F.substring_index(e, "(", 1), lambda label: once(inner(F.length(label)), lambda x: ends(e, label, x)))

    def graph(head: Column, edges: Column) -> Column:
        alone = F.when(head == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(head, F.lit(r"\((\S*_[^_\s]+_\d+_-?\d+)\), "), F.lit(1)))
        nodes = F.array_distinct(F.concat(alone, edges["src"], edges["dst"]))
        deps = F.transform(edges, lambda x: F.struct(x["label"].alias("label"), place(x["src"]).alias("src"), place(x["dst"]).alias("dst")))
        return F.struct(F.sort_array(F.transform(nodes, token)).alias("tokens"), F.sort_array(F.array_distinct(deps)).alias("deps"))

    def read(head: Column) -> Column:
        found = F.regexp_extract_all(F.substring(g, F.length(head) + 1, F.length(g)), F.lit(_EDGE), F.lit(0))
        length = lambda e: F.aggregate(e, F.length(head), lambda n, x: n + F.length(x))
        return once(found, lambda e: F.when((F.size(e) > 0) & (length(e) == F.length(g)), once(F.transform(e, edge), lambda x: graph(head, x))))

    return once(F.when(F.startswith(g, F.lit("(")), F.regexp_extract(g, _HEAD, 0)).when(g.isNotNull(), F.lit("")), read)


def collapse(tokens: Column, deps: Column) -> Column:
    """deps with prep and pobj edges over a preposition made one edge prep_X, where nothing else hangs below the preposition."""
    below = lambda d: F.filter(deps, lambda x: x["src"] == d["dst"])
    joint = lambda d: (d["label"] == "prep") & F.exists(deps, lambda x: x["src"] == d["dst"]) & F.forall(below(d), lambda x: x["label"] == "pobj")
    word = lambda d: F.lower(F.get(F.filter(tokens, lambda t: t["idx"] == d["dst"]), F.lit(0))["text"])
    new = F.flatten(F.transform(F.filter(deps, joint), lambda d: F.transform(below(d), lambda x: F.struct(F.concat(F.lit("prep_"), word(d)).alias("label"), d["src"].alias("src"), x["dst"].alias("dst")))))
    gone = F.transform(F.filter(deps, joint), lambda d: d["dst"])
    left = F.filter(deps, lambda d: ~joint(d) & ~((d["label"] == "pobj") & F.array_contains(gone, d["src"])))
    return F.when(F.exists(deps, lambda d: d["label"] == "prep"), F.array_sort(F.array_distinct(F.concat(left, new)))).otherwise(deps)


def simplify_tags(tokens: Column, verbs: bool = False) -> Column:
    """Plural noun tags become singular; with ``verbs`` all VB* become VB."""

    def simple(t: Column) -> Column:
        tag = F.when(t["postag"].isin("NNS", "NNPS", "PRPS"), F.regexp_replace(t["postag"], "S$", "")).otherwise(t["postag"])
        return F.when(tag.startswith("VB"), F.lit("VB")).otherwise(tag) if verbs else tag

    return F.transform(tokens, lambda t: F.struct(t["idx"].alias("idx"), t["text"].alias("text"), simple(t).alias("postag"), t["offset"].alias("offset")))


def fill_template(template: Column, caught: Column, center: Column, rel: Column, tokens: Column, deps: Column) -> Column:
    """The relation that a template makes: its ``{names}`` replaced by what was caught; with ``be`` in front the verb is
    put in behind the last modal or ``to``, else at the start, unless a verb of the relation already is an auxiliary or
    copula beside its center."""
    text = F.aggregate(F.map_entries(caught), F.regexp_replace(template, "^be ", ""), lambda a, x: F.replace(a, F.concat(F.lit("{"), x["key"], F.lit("}")), F.replace(x["value"], F.lit("_"), F.lit(" "))))
    inside = F.filter(tokens, lambda t: F.array_contains(rel["idx"], t["idx"]))
    verbs = F.transform(F.filter(inside, lambda t: t["postag"].startswith("VB")), lambda t: t["idx"])
    helped = once(verbs, lambda v: F.exists(deps, lambda d: (d["label"].startswith("aux") | (d["label"] == "cop")) & (((d["src"] == center) & F.array_contains(v, d["dst"])) | ((d["dst"] == center) & F.array_contains(v, d["src"])))))
    modals = F.transform(F.filter(inside, lambda t: t["postag"].startswith("MD") | (t["postag"] == "TO")), lambda t: t["text"])

    def with_be(words: Column, known: Column) -> Column:
        behind = F.coalesce(F.array_max(F.transform(words, lambda w, i: F.when(F.array_contains(known, w), i + 1))), F.lit(0))
        return once(behind, lambda n: F.array_join(F.concat(F.slice(words, F.lit(1), n), F.array(F.lit("be")), F.slice(words, n + 1, F.size(words))), " "))

    return once(text, lambda t: F.when(template.startswith("be ") & ~helped, once(F.split(t, " "), lambda w: once(modals, lambda m: with_be(w, m)))).otherwise(t))
