"""Output formats: display lines, tab-separated, serialised, stand-off annotations, DOT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import DEFAULT_WEIGHTS, features
from ..functions.graph import Graph
from ..functions.store import free
from ..operators.evaluate import precision_yield
from ..operators.extract import fact_text


def optional(c: Column) -> Column:
    """Some(x) or None, as readers of the tabbed format expect."""
    return F.coalesce(F.concat(F.lit("Some("), c, F.lit(")")), F.lit("None"))


def number(c: Column) -> Column:
    """A confidence with at most three decimals."""
    return F.call_function("format_number", c, F.lit("#.###"))


def attribution() -> Column:
    return F.when(F.col("attrib_arg").isNotNull(), F.concat_ws(" ", "attrib_arg", "attrib_rel"))


#: The columns of the tabbed formats.
TABBED_COLUMNS = ("confidence", "arg1", "rel", "arg2", "enabler", "attribution", "text", "pattern", "dependencies")
SINGLE_COLUMNS = ("confidence", "extraction", "enabler", "attribution", "text", "pattern", "dependencies")
TABBED_HEADER, SINGLE_HEADER = "\t".join(TABBED_COLUMNS), "\t".join(SINGLE_COLUMNS)


def interactive(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """line: confidence and fact. A sentence without any extraction (arg1 null, see extract's keep_empty) says so; one
    whose extractions all stay below the threshold says nothing."""
    said = F.when(F.col("arg1").isNull(), F.lit("No extractions found.")).otherwise(F.concat_ws(": ", number(F.col("confidence")), fact_text()))
    return df.where(F.col("arg1").isNull() | (F.col("confidence") >= threshold)).select(said.alias("line"))


def dialogue(df: DataFrame, sentence: str, order: list[str], threshold: float = 0.0) -> DataFrame:
    """As in a conversation: each sentence and, below it, what was found in it, or that nothing was; in one row a sentence."""
    facts, n = free([*order, sentence], "facts", "n")
    fact = F.when(F.col("arg1").isNotNull() & (F.col("confidence") >= threshold), F.struct((-F.col("confidence")).alias("c"), F.concat_ws(": ", number(F.col("confidence")), fact_text()).alias("t")))
    rows = df.groupBy(*order, sentence).agg(F.array_sort(F.collect_list(fact)).alias(facts), F.count("arg1").alias(n))
    below = F.when(F.col(n) == 0, F.array(F.lit("No extractions found."))).otherwise(F.transform(facts, lambda x: x["t"]))
    return rows.select(*order, F.array_join(F.concat(F.array(F.col(sentence)), below), "\n").alias("line"))


def _fields(*columns: Column) -> Column:
    """Joined by tabs; a field that is null is empty."""
    return F.array_join(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), "\t")


def tabbed(df: DataFrame) -> DataFrame:
    """TABBED_COLUMNS in one line each."""
    return df.select(_fields(number(F.col("confidence")), F.col("arg1.text"), F.col("rel.text"), F.col("arg2.text"), optional(F.col("enabler")), optional(attribution()), F.col("text"), F.col("pattern"), F.col("graph")).alias("line"))


def tabbed_single(df: DataFrame) -> DataFrame:
    """SINGLE_COLUMNS in one line each."""
    return df.select(_fields(number(F.col("confidence")), fact_text(), optional(F.col("enabler")), optional(attribution()), F.col("text"), F.col("pattern"), F.col("graph")).alias("line"))


def part_text(p: str) -> Column:
    """``text ;;; node; node``: a part with its tokens."""
    own = F.filter("tokens", lambda t: F.array_contains(f"{p}.idx", t["idx"]))
    nodes = F.transform(own, lambda t: F.concat_ws("_", t["text"], t["postag"], t["idx"].cast("string"), t["offset"].cast("string")))
    return F.concat(F.col(f"{p}.text"), F.lit(" ;;; "), F.array_join(nodes, "; "))


def context(words: list[str], places: list[Column]) -> Column:
    """A context: texts and places joined by underscores, an underscore of a text written ``_UNSC_``; None without one."""
    parts = [F.replace(F.col(w), F.lit("_"), F.lit("_UNSC_")) for w in words] + [p.cast("string") for p in places]
    return F.when(F.col(words[0]).isNotNull(), F.concat_ws("_", *parts)).otherwise(F.lit("None"))


def _phrase(df: DataFrame) -> DataFrame:
    """Adds the enabler without its first word."""
    return df.withColumn("enabler_phrase", F.expr("substring(enabler, length(enabler_prefix) + 2)"))


def instance(df: DataFrame) -> DataFrame:
    """line: graph, extractor (kind, template, pattern, confidence), parts, confidence, contexts; what labels and trainers read."""
    last = lambda c: F.col(c) - 1
    enabler = context(["enabler_prefix", "enabler_phrase"], [F.col("enabler_s"), last("enabler_e")])
    said = context(["attrib_arg", "attrib_rel"], [F.col("attrib_s"), last("attrib_e"), F.col("attrib_rel_s"), last("attrib_rel_e")])
    parts = [F.replace(c, F.lit("\t"), F.lit("_TAB_")) for c in (*map(part_text, ("arg1", "rel", "arg2")), F.format_string("%.5f", "pattern_confidence"), enabler, said)]
    return _phrase(df).withColumn("line", _fields(F.col("graph"), F.lit("Template"), F.col("template"), F.col("pattern"), F.col("pattern_confidence"), *parts))


def serialized(df: DataFrame) -> DataFrame:
    return instance(df).select(_fields(number(F.col("confidence")), fact_text(), F.col("line")).alias("line"))


def labelled(df: DataFrame, score: str = "score") -> DataFrame:
    """Lines of labelled instances: 1 or 0, fact and instance; sources.readers.instances reads them."""
    return instance(df).select(_fields(F.when(F.col(score), "1").otherwise("0"), fact_text(), F.col("line")).alias("line"))


FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"interactive": interactive, "tabbed": tabbed, "tabbedsingle": tabbed_single, "serialized": serialized}
HEADERS = {"tabbed": TABBED_HEADER, "tabbedsingle": SINGLE_HEADER}


def pattern_lines(df: DataFrame, verbose: bool = False) -> DataFrame:
    """Extractions by patterns alone: confidence, fact, pattern, text and graph; ``verbose`` as a sentence of words."""
    conf = F.format_string("%1.6f", "pattern_confidence")
    if verbose:
        return df.select(F.concat(F.lit("extraction: "), conf, F.lit(" "), fact_text(), F.lit(" with ("), F.col("pattern"), F.lit(")")).alias("line"))
    return df.select(_fields(conf, fact_text(), F.col("pattern"), F.col("text"), F.col("graph")).alias("line"))


def template_lines(df: DataFrame, detailed: bool = False) -> DataFrame:
    """template, pattern, count; ``detailed``: and the slots' words with their counts (column slots, a map)."""
    own = [F.col("template"), F.col("pattern"), F.col("count")]
    if detailed:
        own.append(F.array_join(F.transform(F.map_entries("slots"), lambda x: F.concat_ws(" -> ", x["key"], x["value"].cast("string"))), "\t"))
    return df.select(_fields(*own).alias("line"))


def weight_lines(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    """A classifier as lines of name and weight, in order of name."""
    return spark.createDataFrame([(f"{k}\t{v!r}",) for k, v in sorted(weights.items())], "line string")


#: The columns that stand before the features in a report.
REPORT_COLUMNS = ("score", "conf", "op-conf", "yield", "precision", "extr", "enabler", "attrib", "sentence", "dependencies")


def feature_report(scored: DataFrame, weights: dict[str, float] | None = None, ties: tuple[str, ...] = ("graph",)) -> DataFrame:
    """One row for each correct extraction in order of confidence: REPORT_COLUMNS with the running yield and precision,
    then a column for each weighted feature. ``weight_row`` makes the row of weights that a file has above them."""
    known, used = features(), DEFAULT_WEIGHTS if weights is None else weights
    rows = scored.withColumn("fact", fact_text())
    points = precision_yield(rows, "confidence", F.col("score"), ["fact", *ties], whole=True)
    own = {
        "score": F.col("score").cast("int"), "conf": F.col("confidence"), "op-conf": F.col("pattern_confidence"), "yield": F.col("yield"), "precision": F.col("precision"), "extr": F.col("fact"),
        "enabler": F.col("enabler").isNotNull(), "attrib": F.col("attrib_arg").isNotNull(), "sentence": F.col("text"), "dependencies": F.col("graph"),
    }
    return points.select(*[own[c].alias(c) for c in REPORT_COLUMNS], *[known[n].alias(n) for n in sorted(used) if n in known])


def weight_row(weights: dict[str, float] | None = None) -> list[str]:
    known, used = features(), DEFAULT_WEIGHTS if weights is None else weights
    return ["" for _ in REPORT_COLUMNS] + [repr(used[n]) for n in sorted(used) if n in known]


def standoff(df: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """doc, number, line: entity lines T and relation lines R with running ids for each document.

    df: doc, order columns, and for arg1, rel, arg2 the columns x_start, x_end, x_text (characters). An extraction takes
    three T ids, arguments first, though its relation is printed first, and two R ids.
    """
    n = F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1
    rows = df.withColumn("n", n)
    entity = lambda k, kind, x: F.format_string("T%d\t%s %d %d\t%s", F.col("n") * 3 + k, F.lit(kind), f"{x}_start", f"{x}_end", f"{x}_text")
    relation = lambda k, kind, x: F.format_string("R%d\t%s Arg1:T%d Arg2:T%d", F.col("n") * 2 + k, F.lit(kind), F.col("n") * 3 + 3, F.col("n") * 3 + x)
    made = F.array(entity(3, "Relation", "rel"), entity(1, "Argument", "arg1"), entity(2, "Argument", "arg2"), relation(1, "Arg1", 1), relation(2, "Arg2", 2))
    return rows.select(doc, "n", F.posexplode(made).alias("k", "line")).select(doc, (F.col("n") * 5 + F.col("k")).alias("number"), "line")


def to_dot(g: Graph, marked: set[int] | None = None) -> str:
    """A graph in the DOT language; tokens at marked places are filled."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    name = {n: quote(f"{n.text}_{n.start}") for n in g.nodes}
    body = [f"  {name[n]} [label={quote(n.text + ' / ' + n.postag)}{', style=filled' if n.start in (marked or ()) else ''}];" for n in g.vertices]
    body += [f"  {name[e.src]} -> {name[e.dst]} [label={quote(e.label)}];" for e in g.edges]
    return "digraph sentence {\n" + "\n".join(body) + "\n}\n"


def dot(tokens: Column, deps: Column, marked: Column | None = None) -> Column:
    """``to_dot`` as a column: of tokens (idx, text, postag) and edges (label, src, dst); ``marked`` is an array of places."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    name = lambda t: quote(F.concat_ws("_", t["text"], t["idx"].cast("string")))
    filled = lambda t: F.when(F.array_contains(marked, t["idx"]), ", style=filled").otherwise("") if marked is not None else F.lit("")
    ends = F.array_distinct(F.flatten(F.transform(deps, lambda d: F.array(d["src"], d["dst"]))))
    used = F.filter(tokens, lambda t: F.array_contains(ends, t["idx"]))
    nodes = F.transform(used, lambda t: F.concat(F.lit("  "), name(t), F.lit(" [label="), quote(F.concat_ws(" / ", t["text"], t["postag"])), filled(t), F.lit("];")))
    at = lambda i: name(F.get(F.filter(tokens, lambda t: t["idx"] == i), F.lit(0)))
    ordered = F.array_sort(F.transform(deps, lambda d: F.struct(d["src"].alias("src"), d["dst"].alias("dst"), d["label"].alias("label"))))
    edges = F.transform(ordered, lambda d: F.concat(F.lit("  "), at(d["src"]), F.lit(" -> "), at(d["dst"]), F.lit(" [label="), quote(d["label"]), F.lit("];")))
    return F.concat(F.lit("digraph sentence {\n"), F.array_join(F.concat(nodes, edges), "\n"), F.lit("\n}\n"))


def write_lines(df: DataFrame, path: str, header: str | None = None) -> None:
    """Lines as text files, in one job: its commit puts all parts in place at once, a failed job leaves none, and of several
    attempts of a task one counts. A header is a part of its own that sorts first."""
    rows = df.select("line")
    if header is not None:
        rows = df.sparkSession.createDataFrame([(header,)], "line string").coalesce(1).union(rows)
    rows.write.text(path)
