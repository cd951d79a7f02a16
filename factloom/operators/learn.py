"""Learning patterns: arguments, seeds, induction, templates, mirrors, confidence."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graph as G
from ..functions.batch import Batch
from ..functions.columns import proper
from ..functions.induction import Facts, induce
from ..functions.native import parse_graph
from .extract import CHUNK

#: Argument lemmas that say nothing, tags of arguments, and words that negate.
EMPTY_ARGUMENTS = ("inc", "ltd", "page", "vehicle", "turn", "site", "photo", "image", "gallery")
ARGUMENT_TAGS = ("DT", "IN", "NNP", "NNPS")
NEGATION = ("not", "no", "n't", "never")


def target_arguments(counts: DataFrame, bound: int = 20) -> DataFrame:
    """(string, lemma, postag, count) -> lemma, count of proper, clean lemmas above the bound."""
    tags = F.split("postag", " ")
    clean = (F.length("lemma") > 2) & (F.length("lemma") < 64) & ~F.col("lemma").isin(*EMPTY_ARGUMENTS) & ~F.col("lemma").contains("_")
    proper = F.forall(tags, lambda t: t.isin(*ARGUMENT_TAGS)) & F.exists(tags, lambda t: t.isin("NNP", "NNPS"))
    return counts.where(clean & proper).groupBy("lemma").agg(F.sum("count").alias("count")).where(F.col("count") > bound)


def relation_lemmas(rel: Column) -> Column:
    """The words of a relation without prepositions, be and like, joined by blanks."""
    drop = F.array(*map(F.lit, (*(p for p in G.PREPOSITIONS if " " not in p), "be", "like")))
    return F.array_join(F.filter(F.split(rel, " "), lambda w: ~F.array_contains(drop, w)), " ")


def target_extractions(triples: DataFrame, arguments: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Triples (arg1, rel, arg2, count) with known, different arguments and no negation, once for each count, with lemmas.

    relations (relation, lemmas), if given, allows relations and names their lemmas; a relation without any listed has
    its own words. Where triples have the arguments' tags (arg1_pos, arg2_pos), one argument at least must be proper.
    """
    known = arguments.select("lemma").distinct()
    rows = triples.where((F.length("rel") < 64) & (F.col("arg1") != F.col("arg2")) & ~F.arrays_overlap(F.split("rel", " "), F.array(*map(F.lit, NEGATION))))
    if {"arg1_pos", "arg2_pos"} <= set(triples.columns):
        rows = rows.where(proper(F.split("arg1_pos", " ")) | proper(F.split("arg2_pos", " ")))
    rows = rows.join(known.withColumnRenamed("lemma", "arg1"), "arg1", "left_semi").join(known.withColumnRenamed("lemma", "arg2"), "arg2", "left_semi")
    if relations is not None:
        rows = rows.join(relations.select(F.col("relation").alias("rel"), F.nullif("lemmas", F.lit("")).alias("given")), "rel")
        rows = rows.withColumn("lemmas", F.coalesce("given", relation_lemmas(F.col("rel"))))
    else:
        rows = rows.withColumn("lemmas", relation_lemmas(F.col("rel")))
    all_lemmas = F.concat_ws(" ", "arg1", "lemmas", "arg2")
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("count").cast("int")))).select("rel", "arg1", "arg2", all_lemmas.alias("lemmas"))


def seeds(targets: DataFrame, least_seed: int = 1, least_rel: int = 15) -> DataFrame:
    """Distinct targets seen more than once, of relations with more than ``least_rel`` such rows, a word of which is in the lemmas."""
    worded = targets.where(F.exists(F.split("rel", " "), lambda w: F.col("lemmas").contains(w)))
    once = worded.groupBy("rel", "arg1", "arg2", "lemmas").agg(F.count("*").alias("n")).where(F.col("n") > least_seed)
    frequent = once.groupBy("rel").agg(F.sum("n").alias("m")).where(F.col("m") > least_rel).select("rel")
    return once.join(frequent, "rel", "left_semi").select("rel", "arg1", "arg2", "lemmas")


def build_patterns(rows: DataFrame, longest: int | None = None) -> DataFrame:
    """(rel, arg1, arg2, lemmas, text, deps) -> the same with a pattern, one row each.

    Graphs are read by column expressions; the facts of an Arrow batch are matched to their sentences and all paths between
    their words found together. Sentences without a verb, graphs that can't be read and rows with a null give nothing;
    repeated rows give their patterns each.
    """
    names = ["rel", "arg1", "arg2", "lemmas", "text", "deps"]
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    graph = rows.select(*names, parse_graph("deps").alias("graph")).where("graph IS NOT NULL AND rel IS NOT NULL AND arg1 IS NOT NULL AND arg2 IS NOT NULL AND lemmas IS NOT NULL")
    graph = graph.where(F.exists("graph.tokens", lambda t: F.upper(t["postag"]).startswith("VB")))
    others = F.array_except(words("lemmas"), F.concat(words("arg1"), words("arg2")))
    graph = graph.select(*names, F.col("graph.tokens").alias("tokens"), F.col("graph.deps").alias("edges"), words("rel").alias("rels"), others.alias("others"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                own = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
                facts = Facts(own("arg1").to_pylist(), own("arg2").to_pylist(), own("rels").to_pylist(), own("others").to_pylist())
                row, patterns = induce(Batch.of_arrow(own("tokens"), own("edges")), facts, longest)
                good = [i for i, p in enumerate(patterns) if p.valid]
                take = pa.array(row[good])
                yield pa.RecordBatch.from_arrays([*(own(n).take(take) for n in names), pa.array([str(patterns[i]) for i in good], pa.string())], [*names, "pattern"])

    found = graph.mapInArrow(run, "rel string, arg1 string, arg2 string, lemmas string, text string, deps string, pattern string")
    return found.select("rel", "arg1", "arg2", "lemmas", "pattern", "text", "deps")


def template_of(rel: Column) -> Column:
    """The template of a relation: its middle words become {rel}, a leading be and a final preposition stay."""
    words = "|".join(sorted((p for p in G.PREPOSITIONS if " " not in p), key=lambda p: (-len(p), p)))
    be, prep = rel.startswith("be "), F.regexp_extract(rel, rf" ({words})$", 1)
    return F.concat(F.when(be, "be ").otherwise(""), F.lit("{rel}"), F.when(prep != "", F.concat(F.lit(" "), prep)).otherwise(""))


def generalize_prepositions(histogram: DataFrame) -> DataFrame:
    """(template, pattern, count): a final preposition that the pattern's last prep edge has too becomes {prep}; counts are conserved."""
    prep = F.regexp_extract("template", r" (\w+)$", 1)
    edge = F.concat(F.lit(">prep_"), prep, F.lit(">"))
    at = F.col("pattern").contains(edge) & (prep != "")
    new_t = F.when(at, F.regexp_replace("template", r" \w+$", " {prep}")).otherwise(F.col("template"))
    head = F.expr("substring(pattern, 1, length(pattern) - length(_tail) - length(_edge))")
    rows = histogram.withColumn("_edge", edge).withColumn("_tail", F.expr("substring_index(pattern, _edge, -1)"))
    new_p = F.when(at, F.concat(head, F.lit(">{prep:regex=prep_(.*)}>"), F.col("_tail"))).otherwise(F.col("pattern"))
    return rows.select(new_t.alias("template"), new_p.alias("pattern"), "count").groupBy("template", "pattern").agg(F.sum("count").alias("count"))


def has_side_relation(pattern: Column) -> Column:
    """The relation stands at the left end of the pattern."""
    return pattern.rlike(r"^\{rel")


def prep_mismatch(template: Column, pattern: Column) -> Column:
    """The final preposition of the template isn't that of the pattern's last preposition edge (none equals none)."""
    words = "|".join(sorted((p.replace(" ", "_") for p in G.PREPOSITIONS), key=lambda p: (-len(p), p)))
    own = F.regexp_extract(template, rf" ({words}|\{{prep\}})$", 1)
    edge = F.regexp_replace(F.regexp_extract(pattern, r".*[<>](prep_\w+|\{prep:regex=prep_\(\.\*\)\})[<>]", 1), r"^\{prep.*", "prep_{prep}")
    return own != F.regexp_replace(edge, "^prep_", "")


def with_lemmas(pattern: Column, regex: Column, alias: str) -> Column:
    """The pattern whose nodes of an alias (a prefix) take only lemmas that match."""
    plain = F.regexp_replace(pattern, rf"\{{({alias}\d*)((?::postag=[^:{{}}]+)?)\}}", "{$1$2:regex=\u0001}")
    return F.replace(plain, F.lit("\u0001"), regex)


def generalize_relations(histogram: DataFrame, relations: DataFrame | None = None, semantics: bool = False, least: int = 5) -> DataFrame:
    """(rel, pattern, count) -> template, pattern, count: relations become templates, those listed in relations (rel,
    template) the given ones, and equal pairs are summed.

    ``semantics``: of a pattern with an nn or amod edge, with its relation at the end, or with another preposition than its
    template, only relations seen more than ``least`` times stay; their words become what its relation may be, and with an
    nn edge its arguments must be proper nouns.
    """
    rows = histogram.join(relations.select("rel", F.col("template").alias("given")), "rel", "left") if relations is not None else histogram.withColumn("given", F.lit(None).cast("string"))
    rows = rows.withColumn("template", F.coalesce("given", template_of(F.col("rel"))))
    if not semantics:
        return rows.groupBy("template", "pattern").agg(F.sum("count").alias("count"))
    nn = F.col("pattern").rlike("[<>]nn[<>]")
    narrow = nn | F.col("pattern").rlike("[<>]amod[<>]") | has_side_relation(F.col("pattern")) | prep_mismatch(F.col("template"), F.col("pattern"))
    words = F.when(F.col("count") > least, F.filter(F.split(relation_lemmas(F.col("rel")), " "), lambda w: w != ""))
    counted = rows.withColumn("narrow", narrow).withColumn("words", words)
    broad = counted.where("not narrow").select("template", "pattern", "count")
    kept = counted.where(F.col("narrow") & (F.size("words") > 0))
    lists = kept.select("template", "pattern", F.explode("words").alias("word")).distinct().groupBy("template", "pattern").agg(F.array_join(F.array_sort(F.collect_list("word")), "|").alias("regex"))
    sums = kept.groupBy("template", "pattern").agg(F.sum("count").alias("count")).join(lists, ["template", "pattern"])
    named = with_lemmas(F.col("pattern"), F.col("regex"), "rel")
    named = F.when(nn, F.regexp_replace(named, r"\{(arg[12])[^{}]*\}", "{$1:postag=NNP}")).otherwise(named)
    return broad.unionByName(sums.select("template", named.alias("pattern"), "count")).groupBy("template", "pattern").agg(F.sum("count").alias("count"))


def slot_bags(rows: DataFrame) -> DataFrame:
    """(rel, pattern, slots: array of words) -> rel, pattern, slots: a map from each word of letters to its count."""
    words = rows.select("rel", "pattern", F.explode("slots").alias("word")).where(F.col("word").rlike(r"^\p{L}+$"))
    counts = words.groupBy("rel", "pattern", "word").agg(F.count("*").alias("n"))
    return counts.groupBy("rel", "pattern").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "n")))).alias("slots"))


def template_histogram(patterned: DataFrame) -> DataFrame:
    """(rel, pattern[, slots]) rows -> rel, pattern, count and, where there are slots, the bag of their words."""
    counts = patterned.groupBy("rel", "pattern").agg(F.count("*").alias("count"))
    return counts if "slots" not in patterned.columns else counts.join(slot_bags(patterned), ["rel", "pattern"], "left")


def add_slot_words(rows: DataFrame, least: int = 5) -> DataFrame:
    """(template, pattern, count) and words (template, pattern, word, n in ``slots``, a map) -> the same with the words seen at
    least so often as what the pattern's slots may be; a pattern with slots but no such word goes."""
    good = F.array_sort(F.transform(F.filter(F.map_entries("slots"), lambda x: x["value"] >= least), lambda x: x["key"]))
    has = F.col("pattern").contains("{slot")
    out = rows.withColumn("regex", F.array_join(good, "|")).where(~has | (F.coalesce(F.col("regex"), F.lit("")) != ""))
    return out.withColumn("pattern", F.when(has, with_lemmas(F.col("pattern"), F.col("regex"), "slot")).otherwise(F.col("pattern"))).drop("regex")


def mirror_key(pattern: Column) -> Column:
    """Equal for a pattern and its mirror, whatever the argument places hold."""
    parts = F.regexp_extract_all(F.regexp_replace(pattern, r"\{arg[12][^}]*\}", "{arg}"), F.lit(r"\{[^{}]*\}|[<>](?:\{[^{}]*\}|[^<>]+)[<>]"), F.lit(0))
    turned = F.transform(F.reverse(parts), lambda x: F.when(x.startswith("<"), F.concat(F.lit(">"), x.substr(F.lit(2), F.length(x) - 2), F.lit(">"))).when(x.startswith(">"), F.concat(F.lit("<"), x.substr(F.lit(2), F.length(x) - 2), F.lit("<"))).otherwise(x))
    a, b = F.array_join(parts, " "), F.array_join(turned, " ")
    return F.concat_ws("~", F.least(a, b), F.greatest(a, b))


def dedup_templates(rows: DataFrame) -> DataFrame:
    """(template, pattern, count): of a template's patterns that mirror each other the most frequent stays; ties go by text."""
    keyed = rows.withColumn("_k", mirror_key(F.col("pattern")))
    return keyed.groupBy("template", "_k").agg(F.min(F.struct((-F.col("count")).alias("c"), "pattern")).alias("x")).select("template", "x.pattern", (-F.col("x.c")).alias("count"))


def build_templates(
    patterned: DataFrame, least: int = 5, no_nn: bool = False, no_amod: bool = False, no_side_rel: bool = False, no_mismatch: bool = False, relations: DataFrame | None = None,
    semantics: bool = False, slot_semantics: bool = False, from_histogram: bool = False, debug: str | None = None,
) -> DataFrame:
    """(rel, pattern[, slots]) rows, or their histogram (rel, pattern, count[, slots]) -> template, pattern, count: counted,
    filtered, generalised, bounded and without mirrors. ``debug``: a folder that gets every stage's rows."""
    rows = dump(patterned if from_histogram else template_histogram(patterned), debug, "histogram")
    mine = F.col("pattern")
    for flag, bad in ((no_nn, mine.rlike(r"[<>]nn[<>]")), (no_amod, mine.rlike(r"[<>]amod[<>]")), (no_side_rel, has_side_relation(mine)), (no_mismatch, prep_mismatch(template_of(F.col("rel")), mine))):
        if flag:
            rows = rows.where(~bad)
    if slot_semantics and "slots" in rows.columns:
        rows = dump(add_slot_words(rows, 5), debug, "slots")
    rows = dump(generalize_relations(rows.select("rel", "pattern", "count"), relations, semantics), debug, "relations")
    rows = dump(generalize_prepositions(rows), debug, "prepositions")
    one_rel = F.size(F.regexp_extract_all("template", F.lit(r"\{rel\}"), F.lit(0))) <= 1
    return dump(dedup_templates(rows.where((F.col("count") >= least) & one_rel)), debug, "templates")


def dump(df: DataFrame, folder: str | None, stage: str) -> DataFrame:
    """Writes a stage's rows to a folder of its own, if one is given, and returns them."""
    if folder is not None:
        df.write.mode("overwrite").json(f"{folder.rstrip('/')}/{stage}")
    return df


def generalize_classes(rows: DataFrame, categories: DataFrame, most: float = 0.75, least: float = 0.10, lemmas: int = 10, hits: int = 5) -> DataFrame:
    """(template, pattern, lemma) and (category, lemma) -> template, pattern, covered, categories: those that stand for the
    lemmas of a pattern, if they cover enough of them."""
    own = rows.select("template", "pattern", "lemma").distinct()
    n = own.groupBy("template", "pattern").agg(F.count("*").alias("n")).where(F.col("n") >= lemmas)
    found = own.join(categories.select("category", "lemma").distinct(), "lemma").groupBy("template", "pattern", "category").agg(F.count("*").alias("k")).where(F.col("k") >= hits)
    share = found.join(n, ["template", "pattern"]).withColumn("share", F.col("k") / F.col("n"))
    return share.groupBy("template", "pattern").agg(F.sum("share").alias("covered"), F.array_sort(F.collect_set(F.when(F.col("share") > least, F.col("category")))).alias("categories")).where(F.col("covered") > most)


def generalize_templates(model: DataFrame, categories: DataFrame, **bounds) -> DataFrame:
    """(template, pattern, count): lists of lemmas in a relation of common nouns, widened by all lemmas of the categories
    that stand for them (see generalize_classes); other patterns stay as they are."""
    tag, regex = lexical_restriction(F.col("pattern"))
    rows = model.withColumn("tag", tag).withColumn("regex", regex)
    listed = rows.where(F.col("tag").isin("NN", "NNS")).select("template", "pattern", F.explode(F.split("regex", r"\|")).alias("lemma"))
    chosen = generalize_classes(listed, categories, **bounds).select("template", "pattern", F.explode("categories").alias("category"))
    more = chosen.join(categories.select("category", "lemma").distinct(), "category").select("template", "pattern", "lemma")
    marked = listed.join(chosen.select("template", "pattern").distinct(), ["template", "pattern"], "left_semi")
    wide = marked.unionByName(more).distinct().groupBy("template", "pattern").agg(F.array_join(F.array_sort(F.collect_list("lemma")), "|").alias("wide"))
    out = rows.join(wide, ["template", "pattern"], "left")
    new = F.when(F.col("wide").isNotNull(), F.replace("pattern", F.concat(F.lit(":regex="), "regex", F.lit("}")), F.concat(F.lit(":regex="), "wide", F.lit("}")))).otherwise(F.col("pattern"))
    return out.select("template", new.alias("pattern"), "count")


def lexical_restriction(pattern: Column) -> tuple[Column, Column]:
    """(tag, lemma alternatives) of the relation of a pattern, empty where it isn't restricted."""
    at = lambda k: F.regexp_extract(pattern, r"\{rel\d*(?::postag=([^:{}]+))?:regex=([^{}]+)\}", k)
    return at(1), at(2)


def counts_to_confidence(rows: DataFrame, count: str = "count") -> DataFrame:
    """Adds confidence = count / largest count; the largest is one value, aggregated first and broadcast."""
    top = rows.agg(F.max(count).alias("_top"))
    return rows.join(F.broadcast(top)).withColumn("confidence", F.col(count) / F.col("_top")).drop("_top")


def voice_mirrors(model: DataFrame) -> DataFrame:
    """(template, pattern, ...) rows and, behind them, their other voice: with a subject the arguments change places and ``be``
    goes in front, if it isn't there; with a passive subject they change places and ``be`` goes, if it is."""
    p, t = F.col("pattern"), F.col("template")
    be = t.startswith("be ")
    active, passive = p.rlike("[<>]nsubj[<>]"), p.rlike("[<>]nsubjpass[<>]")
    swapped = F.replace(F.replace(F.replace(p, F.lit("{arg1"), F.lit("{\u0001")), F.lit("{arg2"), F.lit("{arg1")), F.lit("{\u0001"), F.lit("{arg2"))
    other = F.when(active & ~be, F.concat(F.lit("be "), t)).when(~active & passive & be, F.expr("substring(template, 4)"))
    rest = [c for c in model.columns if c not in ("template", "pattern")]
    both = F.array_compact(F.array(F.struct(t.alias("template"), p.alias("pattern")), F.when(other.isNotNull(), F.struct(other.alias("template"), swapped.alias("pattern")))))
    return model.select(*rest, F.explode(both).alias("both")).select("both.template", "both.pattern", *rest)


def best_by(df: DataFrame, group: list[str], value: str, tie: str) -> DataFrame:
    """The row of each group with the largest value, ties by the smaller tie."""
    w = Window.partitionBy(*group).orderBy(F.desc(value), F.asc(tie))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
