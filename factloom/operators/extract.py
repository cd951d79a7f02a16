"""Extraction over a DataFrame of sentences, native duplicate removal, n-ary facts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import extraction as X
from ..functions import graph as G
from ..functions.batch import Batch
from ..functions.features import DEFAULT_WEIGHTS, confidence, features, measured
from ..functions.lemmas import Lemmas
from ..functions.native import collapse, fill_template, parse_graph, simplify_tags
from ..functions.store import free
from ..functions.voice import switched

_PART = "struct<text:string,s:int,e:int,idx:array<int>>"
TOKENS = "array<struct<idx:int,text:string,postag:string,lemma:string,offset:int>>"
DEPS = "array<struct<label:string,src:int,dst:int>>"
#: Sentences that are matched and expanded together.
CHUNK = 2000
#: One row per extraction; a sentence without any gives none.
SCHEMA = (
    f"arg1 {_PART}, rel {_PART}, arg2 {_PART}, pattern_confidence double, pattern string, template string, pattern_labels array<string>,"
    "semantic boolean, prep_mismatch boolean, enabler string, enabler_prefix string, enabler_s int, enabler_e int,"
    "attrib_arg string, attrib_rel string, attrib_s int, attrib_e int, attrib_rel_s int, attrib_rel_e int,"
    f"passive boolean, active boolean, tokens {TOKENS}, deps {DEPS}"
)


@dataclass(frozen=True)
class Configuration:
    """Options of a run; the threshold applies to patterns before anything is matched."""

    threshold: float = 0.005
    expand: bool = True
    collapse: bool = True
    simplify_tags: bool = True
    collapse_verbs: bool = False
    all_arguments: bool = False
    duplicates: bool = False
    ignore_errors: bool = True
    #: verbs that attribute a statement; None: those of communication and thinking
    attributing: tuple[str, ...] | None = None


#: What a batch gives for a fact: SCHEMA without what columns add, and what templates need.
_FACT = (
    f"struct<arg1:{_PART},rel:{_PART},arg2:{_PART},pattern_confidence:double,pattern:string,template:string,pattern_labels:array<string>,semantic:boolean,prep_mismatch:boolean,"
    "enabler:string,enabler_prefix:string,enabler_s:int,enabler_e:int,attrib_arg:string,attrib_rel:string,attrib_s:int,attrib_e:int,attrib_rel_s:int,attrib_rel_e:int,center:int,caught:map<string,string>>"
)


def _read(batch: pa.RecordBatch, names: list[str], at: int, parser) -> tuple[list, list]:
    """(tokens, deps) as lists of rows, by a parser given as a function."""
    tokens, deps = [], []
    for raw in batch.column(at).to_pylist():
        g = None if raw is None else parser(raw)
        tokens.append([] if g is None else [{"idx": n.start, "text": n.text, "postag": n.postag, "offset": n.offset} for n in g.nodes])
        deps.append([] if g is None else [{"label": e.label, "src": e.src.start, "dst": e.dst.start} for e in g.edges])
    return tokens, deps


_TOKENS_IN = "array<struct<idx:int,text:string,postag:string,offset:int>>"


def parsed(sentences: DataFrame, graph: str, tokens: str, deps: str, parser: Callable[[str], G.Graph] | None, ignore_errors: bool) -> DataFrame:
    """Adds the tokens and edges of each sentence. Graph strings are read by column expressions; a ``parser`` (a function
    from a string to a graph) runs in Arrow batches. What can't be read has neither, or raises without ignore_errors."""
    if parser is None:
        [whole] = free([*sentences.columns, tokens, deps], "whole")
        both = sentences.withColumn(whole, parse_graph(graph))
        if not ignore_errors:
            bad = F.raise_error(F.concat(F.lit("not a dependency graph: "), F.substring(graph, 1, 80))).cast(both.schema[whole].dataType)
            both = both.withColumn(whole, F.when(F.col(graph).isNotNull() & F.col(whole).isNull(), bad).otherwise(F.col(whole)))
        return both.select(*sentences.columns, F.col(whole)["tokens"].alias(tokens), F.col(whole)["deps"].alias(deps))
    names, at = sentences.columns, sentences.columns.index(graph)
    from pyspark.sql.pandas.types import to_arrow_schema

    extra = T.StructType.fromDDL(f"{tokens} {_TOKENS_IN}, {deps} {DEPS}")
    arrow = to_arrow_schema(extra)

    def tolerant(raw: str) -> G.Graph | None:
        try:
            return parser(raw)
        except Exception:
            if ignore_errors:
                return None
            raise

    def run(batches):
        for batch in batches:
            columns = _read(batch, names, at, tolerant)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]], [*names, tokens, deps])

    return sentences.mapInArrow(run, T.StructType([*sentences.schema.fields, *extra.fields]))


def extract(sentences: DataFrame, model: list[str] | None = None, config: Configuration | None = None, graph: str = "graph", parser: Callable[[str], G.Graph] | None = None, keep_empty: bool = False, build: Callable[[Column], Column] | None = None, valid: Callable[[Column], Column] | None = None, lemmas: list[tuple[str, int, str]] | None = None) -> DataFrame:
    """All columns of sentences and SCHEMA, a row for each extraction. The model (small) goes to every worker with the function; no shuffle.

    Reading, normal forms, templates, duplicates and order are column expressions; matching and expansion run over all
    sentences of an Arrow batch together. ``keep_empty``: sentences without extractions give a row of nulls.
    ``lemmas``: learned rules (suffix, strip, put) for the tokens' lemmas in place of the fixed ones (functions.lemmas).
    ``build`` changes a fact (a struct column of SCHEMA's first fields) before duplicates go, ``valid`` tells which ones stay.
    Null rows and what can't be read give nothing; without ignore_errors the latter raises. Columns of ``sentences`` that
    are called like one of SCHEMA are dropped first.
    """
    config, lines = config or Configuration(), X.SEED_MODEL if model is None else model
    X.read_model(lines)  # a bad model fails here, not in a task
    result = T.StructType.fromDDL(SCHEMA)
    taken = {c.lower() for c in result.names}
    names = [c for c in sentences.columns if c.lower() not in taken or c == graph]
    tokens, deps, found = free([*names, *result.names], "tokens_read", "deps_read", "facts_read")
    df = parsed(sentences.select(*names), graph, tokens, deps, parser, config.ignore_errors)
    if config.collapse:
        df = df.withColumn(deps, collapse(F.col(tokens), F.col(deps)))
    if config.simplify_tags or config.collapse_verbs:
        df = df.withColumn(tokens, simplify_tags(F.col(tokens), config.collapse_verbs))
    out = T.StructType([*df.select(*names).schema.fields, T.StructField(tokens, T._parse_datatype_string(TOKENS)), T.StructField(deps, T._parse_datatype_string(DEPS)), T.StructField(found, T._parse_datatype_string(f"array<{_FACT}>"))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    n = len(names)
    attributing = None if config.attributing is None else frozenset(config.attributing)

    def run(batches):
        extractors = X.read_model(lines)
        of = None if lemmas is None else Lemmas(lemmas)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                b = Batch.of_arrow(batch.column(n), batch.column(n + 1), of)
                facts = X.facts(b, extractors, config.threshold, config.expand, not config.all_arguments, attributing)
                ints = lambda x: pa.array(x, pa.int32())
                t = pa.StructArray.from_arrays([ints(b.place), pa.array(b.text, pa.string()), pa.array(b.tag, pa.string()), pa.array(b.lemma, pa.string()), ints(b.offset)], names=["idx", "text", "postag", "lemma", "offset"])
                d = pa.StructArray.from_arrays([pa.array(b.names, pa.string()).take(pa.array(b.code)), ints(b.place[b.src]), ints(b.place[b.dst])], names=["label", "src", "dst"])
                edges = np.searchsorted(b.sentence[b.src], np.arange(b.sentences + 1))
                new = [pa.ListArray.from_arrays(ints(b.begin), t).cast(arrow.field(n).type), pa.ListArray.from_arrays(ints(edges), d).cast(arrow.field(n + 1).type), pa.array(facts, arrow.field(n + 2).type)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], arrow.names)

    df = df.select(*names, tokens, deps).mapInArrow(run, out)
    if not keep_empty:
        df = df.where(F.size(found) > 0)
    fixed = lambda f: F.when(f["template"].isNotNull(), fill_template(f["template"], f["caught"], f["center"], f["rel"], F.col(tokens), F.col(deps))).otherwise(f["rel"]["text"])
    df = df.withColumn(found, F.transform(found, lambda f: f.withField("rel.text", fixed(f)).dropFields("center", "caught")))
    for hook, over in ((build, F.transform), (valid, F.filter)):
        if hook is not None:
            df = df.withColumn(found, over(found, hook))
    if not config.duplicates:
        df = df.withColumn(found, unique_facts(F.col(found)))
    order = lambda x, y: F.when(x["pattern_confidence"] != y["pattern_confidence"], F.when(x["pattern_confidence"] > y["pattern_confidence"], -1).otherwise(1)).otherwise(F.when(_bare(x) < _bare(y), -1).when(_bare(x) > _bare(y), 1).otherwise(0))
    df = df.withColumn(found, F.array_sort(found, order))
    explode = F.explode_outer if keep_empty else F.explode
    fact = free([*names, tokens, deps, found], "fact_read")[0]
    df = df.select(*names, tokens, deps, explode(found).alias(fact))
    f = F.col(fact)
    own = {
        "passive": f["pattern"].contains("nsubjpass") | f["rel"]["text"].endswith(" by"),
        "active": (f["pattern"].contains("nsubj<") | f["pattern"].contains(">nsubj")) & (f["pattern"].contains("nsubj<") | ~f["pattern"].contains("nsubjpass")),
        "tokens": F.col(tokens), "deps": F.col(deps),
    }
    out = df.select(*names, *[own.get(c, f[c] if c not in own else None).alias(c) for c in result.names])
    out.complete = build is None and not keep_empty  # every field that a score needs is there
    return out


def _bare(f: Column) -> Column:
    return F.concat(F.lit("("), f["arg1"]["text"], F.lit("; "), f["rel"]["text"], F.lit("; "), f["arg2"]["text"], F.lit(")"))


def unique_facts(facts: Column) -> Column:
    """An array of facts without repeats (of equal confidence and texts the first pattern in order stays) and without
    those that a surer one of the same relation contains: one argument within its argument."""
    same = lambda x, y: (x["pattern_confidence"] == y["pattern_confidence"]) & (_bare(x) == _bare(y))
    first = lambda f, g: F.when(f["pattern"] != g["pattern"], g["pattern"] < f["pattern"]).otherwise(g["rel"]["idx"] < f["rel"]["idx"])
    once = F.array_distinct(F.filter(facts, lambda f: ~F.exists(facts, lambda g: same(f, g) & first(f, g))))
    inside = lambda f, g: (f["rel"]["text"] == g["rel"]["text"]) & (f["rel"]["idx"] == g["rel"]["idx"]) & (f["pattern_confidence"] < g["pattern_confidence"]) & (g["arg1"]["text"].contains(f["arg1"]["text"]) | g["arg2"]["text"].contains(f["arg2"]["text"]))
    return F.when(F.size(facts) > 1, F.filter(once, lambda f: ~F.exists(facts, lambda g: inside(f, g)))).otherwise(facts)  # one fact has no other


def with_confidence(extractions: DataFrame, weights: dict[str, float] | None = None, threshold: float = 0.0) -> DataFrame:
    """Adds confidence by column expressions and keeps what reaches the threshold.

    The rows are kept by exploding an array of one confidence or none: a filter would be moved below the columns and
    compute the whole score once more. Every score is above 0, so a threshold of 0 only drops rows without one, and what
    ``extract`` gives has one always: there nothing is computed unless the score is read.
    """
    rows = measured(extractions, lambda known: {"confidence": confidence(weights, known)})
    if threshold <= 0 and getattr(extractions, "complete", False):
        return rows
    others = [F.col(f"`{c}`") for c in rows.columns if c != "confidence"]
    return rows.select(*others, F.explode(F.when(F.col("confidence") >= threshold, F.array("confidence"))).alias("confidence"))


def fact_text() -> Column:
    """(arg1; rel; arg2)[enabler=...;attrib=...]"""
    notes = F.concat_ws(";", F.when(F.col("enabler").isNotNull(), F.concat(F.lit("enabler="), F.col("enabler"))), F.when(F.col("attrib_arg").isNotNull(), F.concat(F.lit("attrib="), F.col("attrib_arg"), F.lit(" "), F.col("attrib_rel"))))
    return F.concat(F.format_string("(%s; %s; %s)", "arg1.text", "rel.text", "arg2.text"), F.when(notes != "", F.concat(F.lit("["), notes, F.lit("]"))).otherwise(""))


def in_order(facts: DataFrame, sentence: list[str], place: str = "place") -> DataFrame:
    """Adds the place of each fact within its sentence: by confidence, descending, then by text."""
    w = Window.partitionBy(*sentence).orderBy(F.desc("confidence"), fact_text())
    return facts.withColumn(place, F.row_number().over(w))


def drop_subsumed(df: DataFrame, group: list[str], rel: str, arg1: str, arg2: str, conf: str) -> DataFrame:
    """Duplicates of a group (a sentence): equal rows once, then the ones that a surer row of equal relation contains.

    Groups are gathered as arrays, as a sentence has few extractions; one shuffle, by group.
    """
    rows = df.select(*group, F.struct(F.col(conf).alias("c"), F.col(arg1).alias("x"), F.col(rel).alias("r"), F.col(arg2).alias("y")).alias("q"))
    sets = rows.groupBy(*group).agg(F.collect_set("q").alias("qs"))
    covered = lambda p: F.exists("qs", lambda o: (o["r"] == p["r"]) & (p["c"] < o["c"]) & (o["x"].contains(p["x"]) | o["y"].contains(p["y"])))
    kept = sets.select(*group, F.explode(F.filter("qs", lambda p: ~covered(p))).alias("q"))
    return kept.select(*group, F.col("q.c").alias(conf), F.col("q.x").alias(arg1), F.col("q.r").alias(rel), F.col("q.y").alias(arg2))


def longest_preposition(rel: str) -> Column:
    """The longest known preposition that ends a relation, or null."""
    options = sorted(G.PREPOSITIONS, key=lambda p: (-len(p), p))
    return F.nullif(F.regexp_extract(F.col(rel), r" (" + "|".join(options) + r")$", 1), F.lit(""))


def nary(df: DataFrame, group: list[str], arg1: str, rel: str, arg2: str, start: str, conf: str) -> DataFrame:
    """Facts of one subject and verb with several complements: group, arg1, rel, suffixes (array of struct), n.

    The relation loses its longest final preposition, which goes before the second argument; suffixes are in order of
    their start and one for each start; groups of one aren't n-ary. Where the facts say who states them (attrib_arg,
    attrib_rel) or on what condition (enabler), the distinct ones of all facts of a group come with it: attributions
    (array of struct) and enablers (array of string), in order, without nulls.
    """
    prep = longest_preposition(rel)
    base = F.when(prep.isNotNull(), F.expr(f"substring({rel}, 1, length({rel}) - length(_p) - 1)")).otherwise(F.col(rel))
    rows = df.withColumn("_p", prep).withColumn("_b", base)
    suffix = F.struct(F.col(start).alias("start"), F.concat_ws(" ", "_p", arg2).alias("text"), F.col(conf).alias("conf"))
    notes = {}
    if {"attrib_arg", "attrib_rel"} <= set(df.columns):
        notes["attributions"] = F.when(F.col("attrib_arg").isNotNull(), F.struct(F.col("attrib_arg").alias("arg"), F.col("attrib_rel").alias("rel")))
    if "enabler" in df.columns:
        notes["enablers"] = F.col("enabler")
    one = rows.groupBy(*group, arg1, "_b", start).agg(F.max(suffix).alias("x"), *[F.collect_set(c).alias(k) for k, c in notes.items()])
    gathered = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(k)))).alias(k) for k in notes]
    return one.groupBy(*group, arg1, F.col("_b").alias(rel)).agg(F.array_sort(F.collect_list("x")).alias("suffixes"), F.count("*").alias("n"), *gathered).where("n > 1")


def switch_voices(sentences: DataFrame, graph: str = "graph") -> DataFrame:
    """All columns, with the graph in the other voice: a row for each clause that can be turned, none for others.

    Graphs are read by column expressions; null rows and what can't be read give nothing. Repeated rows are turned each.
    """
    names = sentences.columns
    [whole] = free(names, "whole")
    # what can't be read stays as a null, an empty sentence to the batch: a filter would be moved below and read each graph twice
    rows = sentences.withColumn(whole, parse_graph(graph))

    def run(batches):
        for every in batches:
            for at in range(0, every.num_rows, CHUNK):
                batch = every.slice(at, CHUNK)
                tokens, deps = batch.column(len(names)).flatten()
                row, turned = switched(Batch.of_arrow(tokens, deps))
                own = batch.select(names).take(pa.array(row))
                yield own.set_column(names.index(graph), graph, turned)

    return rows.select(*names, F.col(whole)).mapInArrow(run, sentences.schema)


def feature_matrix(extractions: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """confidence, fact and a column for each weighted feature, in order of name; the weights are those of ``with_confidence``."""
    used = DEFAULT_WEIGHTS if weights is None else weights
    names = [n for n in sorted(used) if n in features()]
    rows = extractions.withColumn("fact", fact_text())
    return measured(rows, lambda known: {n: c for n, c in features(known).items() if n in names}).select("confidence", "fact", *[F.col(f"`{n}`") for n in names])
