"""Command line: python -m factloom TOOL OPTIONS. Every tool is a thin shell over a function of the library."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.extraction import SEED_MODEL
from .functions.features import confidence, features
from .functions.native import parse_graph
from .functions.patterns import parse_pattern
from .operators import collections as C
from .operators import evaluate as V
from .operators import learn as L
from .operators.extract import Configuration, extract, with_confidence
from .sources import readers as R
from .sources import writers as W


def validate(patterns: list[str]) -> list[str]:
    """``valid: pattern`` or ``invalid: pattern`` for each."""
    out = []
    for raw in patterns:
        try:
            ok = parse_pattern(raw).valid
        except ValueError:
            ok = False
        out.append(f"{'valid' if ok else 'invalid'}: {raw}")
    return out


def tsv(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.array_join(F.col(f"`{c}`"), "\t") if t.startswith("array") else F.when(F.col(f"`{c}`"), "1").otherwise("0") if t == "boolean" else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c, t in df.dtypes]).alias("line"))


def sentences(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """graph and text: from files of graphs (the last field of a line), from text, or from standard input (``-``)."""
    if o.input == ["-"]:
        rows = R.stdin_lines(spark).select(F.col("sentence").alias("value"))
    elif o.split:
        rows = R.paragraphs(spark, o.input).select(F.col("sentence").alias("value"))
    else:
        rows = R.lines(spark, o.input, o.encoding).select(F.col("sentence").alias("value"))
    if o.parser == "deserialize":
        rows = rows.select(F.element_at(F.split("value", "\t", -1), -1).alias("graph")).where(parse_graph("graph").isNotNull())
        return rows.withColumn("text", F.array_join(F.transform(parse_graph("graph")["tokens"], lambda t: t["text"]), " "))
    return rows.select(F.col("value").alias("graph"), F.col("value").alias("text"))


def run_console(spark: SparkSession, o: argparse.Namespace) -> str:
    """Answers sentences as they are typed, until the input ends."""
    from .streaming.stream import console

    config = Configuration(o.pattern_threshold, not o.no_expand, not o.no_collapse, True, o.collapse_verbs, o.all, o.duplicates, o.ignore_errors)
    weights = None if o.weights is None else {"Intercept": 0.0} if o.weights == "None" else R.weights(spark, o.weights)
    model = R.model_lines(spark, o.model) if o.model else SEED_MODEL
    reader = None if o.parser == "deserialize" else R.PARSERS[o.parser]

    def answer(batch: DataFrame) -> DataFrame:
        facts = extract(batch.select("number", F.col("sentence").alias("text"), F.col("sentence").alias("graph")), model, config, parser=reader, keep_empty=True)
        return W.dialogue(facts.withColumn("confidence", confidence(weights)), "text", ["number"], o.threshold)

    query = console(spark, answer, prompt=o.prompt)
    query.feeder.join()
    return "the input has ended"


def run_extract(spark: SparkSession, o: argparse.Namespace) -> str:
    """Extracts from files of graphs or text, writes the chosen format and returns a summary."""
    if o.input == ["-"] and o.format == "interactive" and not o.output:
        return run_console(spark, o)
    began = time.time()
    rows = sentences(spark, o)
    config = Configuration(o.pattern_threshold, not o.no_expand, not o.no_collapse, True, o.collapse_verbs, o.all, o.duplicates, o.ignore_errors)
    weights = None if o.weights is None else {"Intercept": 0.0} if o.weights == "None" else R.weights(spark, o.weights)
    seen, made = Observation("sentences"), Observation("facts")
    reader = None if o.parser == "deserialize" else R.PARSERS[o.parser]
    talk = o.format == "interactive"
    facts = extract(rows.observe(seen, F.count("*").alias("n")), R.model_lines(spark, o.model) if o.model else SEED_MODEL, config, parser=reader, keep_empty=talk)
    facts = facts.withColumn("confidence", confidence(weights)) if talk else with_confidence(facts, weights, o.threshold)
    facts = facts.observe(made, F.count("arg1").alias("n"))
    if talk:
        lines = W.dialogue(facts, "text", ["graph"], o.threshold)
    elif o.format == "patterns":
        lines = W.pattern_lines(facts, o.verbose)
    else:
        lines = W.FORMATS[o.format](facts)
    W.write_lines(lines, o.output, W.HEADERS.get(o.format))
    return f"{made.get['n']} extractions from {seen.get['n']} sentences in {time.time() - began:.1f} seconds"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="factloom")
    tools = top.add_subparsers(dest="tool", required=True)

    def tool(name: str, *options: tuple) -> argparse.ArgumentParser:
        p = tools.add_parser(name)
        for flags, how in options:
            p.add_argument(*flags, **how)
        return p

    files, out = (("input",), {"nargs": "+"}), (("--output",), {"required": True})
    yes = {"action": "store_true"}
    tool("extract", files, (("--output",), {"help": "a folder; without one, sentences of standard input are answered as they come"}), (("--prompt",), {"default": None}), (("--model",), {}), (("--weights",), {"help": "a file, or None for confidence without features"}), (("--threshold",), {"type": float, "default": 0.0}),
         (("--pattern-threshold",), {"type": float, "default": 0.005}), (("--format",), {"choices": [*W.FORMATS, "patterns"], "default": "tabbed"}), (("--parser",), {"choices": [*R.PARSERS], "default": "deserialize"}), (("--encoding",), {"default": "UTF-8"}),
         (("--split",), yes), (("--verbose",), yes), (("--duplicates",), yes), (("--all",), yes),
         (("--no-expand",), yes), (("--no-collapse",), yes), (("--collapse-verbs",), yes), (("--ignore-errors",), yes))
    tool("validate", (("pattern",), {"nargs": "*"}))
    tool("find-arguments", files, out, (("--bound",), {"type": int, "default": 20}))
    tool("find-extractions", files, out, (("--arguments",), {"required": True}), (("--relations",), {}))
    tool("filter-extractions", files, out)
    tool("build-patterns", files, out, (("--length",), {"type": int}))
    tool("keep-common", files, out, (("--min",), {"type": int, "default": 10}))
    tool("keep-diverse", files, out, (("--min",), {"type": int, "default": 5}), (("--debug",), {}))
    tool("build-templates", files, out, (("--minimum",), {"type": int, "default": 5}), (("--filter-nnedge",), yes), (("--filter-amodedge",), yes), (("--filter-siderel",), yes),
         (("--filter-prepmismatch",), yes), (("--reltemplates",), {}), (("--relation-semantics",), yes), (("--slot-semantics",), yes), (("--from-histogram",), yes), (("--detailed",), yes), (("--debug",), {}))
    tool("generalize", files, out, (("--category",), {"action": "append", "default": [], "help": "NAME=FILE, a list of lemmas"}))
    tool("analyze", files, out, (("--above",), {"type": int, "default": 100}))
    tool("count-components", files, out)
    tool("train", files, out)
    tool("cross-validate", files, out, (("--folds",), {"type": int, "default": 10}))
    tool("features", files, out, (("--weights",), {}))
    tool("search", files, out, (("--words",), {"required": True}))
    tool("confidence", files, out)
    tool("mirrors", files, out)
    tool("score", files, out, (("--gold",), {"required": True}), (("--gold-output",), {}), (("--threshold",), {"type": float, "default": 0.0}), (("--keep-skipped",), yes))
    tool("curve", files, out)
    tool("merge-curves", files, out)
    tool("rank", files, out, (("--column",), {"type": int, "default": 0}))
    tool("significance", files, out, (("--iterations",), {"type": int, "default": 1000}))
    return top


def run(spark: SparkSession, o: argparse.Namespace) -> str:
    read = lambda name, path=None: R.table(spark, path or o.input, name)
    if o.tool == "validate":
        return "\n".join(validate(o.pattern or [x.rstrip("\n") for x in sys.stdin]))
    if o.tool == "extract":
        return run_extract(spark, o)
    if o.tool == "find-arguments":
        out = L.target_arguments(read("argument_counts"), o.bound).orderBy(F.desc("count"), "lemma")
    elif o.tool == "find-extractions":
        out = L.target_extractions(read("raw_triples"), read("target_arguments", o.arguments), read("relations", o.relations) if o.relations else None)
    elif o.tool == "filter-extractions":
        out = L.seeds(read("target_extractions"))
    elif o.tool == "build-patterns":
        out = L.build_patterns(read("lemma_grep"), o.length)
    elif o.tool == "keep-common":
        out = C.keep_common(read("patterned"), "pattern", o.min)
    elif o.tool == "keep-diverse":
        out, rest = C.keep_diverse(read("patterned"), "pattern", "rel", o.min)
        if o.debug:
            W.write_lines(tsv(rest), o.debug)
    elif o.tool == "build-templates":
        rows = read("histogram" if o.from_histogram else "patterned")
        if o.from_histogram:
            rows = rows.withColumn("slots", F.map_from_entries(F.transform(F.array_distinct("slots"), lambda w: F.struct(w, F.size(F.filter("slots", lambda x: x == w)).cast("long")))))
        known = read("relation_templates", o.reltemplates) if o.reltemplates else None
        out = L.build_templates(rows, o.minimum, o.filter_nnedge, o.filter_amodedge, o.filter_siderel, o.filter_prepmismatch, known, o.relation_semantics, o.slot_semantics, o.from_histogram, o.debug)
        out = out.orderBy(F.desc("count"), "template", "pattern")
        if o.detailed:
            W.write_lines(W.template_lines(out.withColumn("slots", F.create_map().cast("map<string,bigint>")), True), o.output)
            return o.output
    elif o.tool == "generalize":
        out = L.generalize_templates(read("templates"), R.categories(spark, dict(x.split("=", 1) for x in o.category)))
    elif o.tool == "analyze":
        out = C.frequent_with_examples(read("patterned"), "pattern", "rel", o.above).orderBy(F.desc("n"), "pattern")
    elif o.tool == "count-components":
        out = C.pattern_components(read("templates")).orderBy(F.desc("n"), "kind", "component")
    elif o.tool == "train":
        W.write_lines(W.weight_lines(spark, V.train_from_instances(R.instances(spark, o.input))), o.output)
        return o.output
    elif o.tool == "cross-validate":
        known = features()
        rows = R.instances(spark, o.input).select(F.concat_ws("\t", "fact", "graph").alias("key"), F.col("score").cast("int").alias("label"), *[known[n].alias(n) for n in known])
        out = V.cross_validate(rows, [*known], "key", n=o.folds)
    elif o.tool == "features":
        weights = R.weights(spark, o.weights) if o.weights else None
        rows = R.instances(spark, o.input).withColumn("confidence", confidence(weights))
        report = W.feature_report(rows, weights)
        W.write_lines(tsv(report), o.output, "\t".join(report.columns) + "\n" + "\t".join(W.weight_row(weights)))
        return o.output
    elif o.tool == "search":
        out = C.search(R.lines(spark, o.input), "sentence", o.words)
    elif o.tool == "confidence":
        out = L.counts_to_confidence(read("templates")).select("template", "pattern", F.format_string("%1.4f", "confidence").alias("confidence"))
    elif o.tool == "mirrors":
        parts = F.split("value", "\t", -1)
        lines = spark.read.text(o.input).select(F.get(parts, F.lit(0)).alias("template"), F.get(parts, F.lit(1)).alias("pattern"), F.coalesce(F.get(parts, F.lit(2)), F.lit("1.0")).alias("confidence"))
        out = L.voice_mirrors(lines.where("pattern is not null"))  # the line that names the kind of model has no pattern
    elif o.tool == "score":
        gold = read("gold", o.gold)
        scored = V.score(read("extractions"), gold, o.threshold, o.keep_skipped)
        if o.gold_output:
            W.write_lines(tsv(V.grown_gold(gold, scored)), o.gold_output)
        out = scored.select("score", "confidence", "extraction", "pattern", "text", "deps")
    elif o.tool == "curve":
        out = V.precision_yield(read("scored"), "confidence", F.col("score"), ["extraction"]).orderBy("yield")
    elif o.tool == "merge-curves":
        out = V.merge_curves([read("curve", p) for p in o.input]).orderBy("yield")
    elif o.tool == "rank":
        out = V.rank(read("scored").withColumn("group", F.get("extra", F.lit(o.column))), "group", F.col("score")).orderBy(F.desc("precision"), F.desc("n"), "group")
    else:
        rows = None
        for i, p in enumerate(o.input):
            one = read("scored", p).where("score is not null").select(F.pmod(F.xxhash64(F.get("extra", F.lit(1))), F.lit(1 << 62)).alias("sentence"), F.lit(str(i)).alias("system"), F.col("score").alias("correct"))
            rows = one if rows is None else rows.unionByName(one)
        out = V.resampled(rows, o.iterations)
    W.write_lines(tsv(out), o.output)
    return o.output


def main(args: list[str] | None = None) -> None:
    options = parser().parse_args(args)
    print(run(SparkSession.builder.getOrCreate(), options))


if __name__ == "__main__":
    main()
