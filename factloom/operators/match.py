"""Pattern matching as joins: a model of patterns is one prefix tree, walked hop by hop over tables of edges and tokens."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import Pattern
from ..functions.store import keep

#: A side of a join is sent to all executors up to so many bytes, as counted; a larger one is shuffled.
SENT_BYTES = 32 << 20


@dataclass
class Tree:
    """Patterns as paths from state 0: a step is (depth, parent, up, want, regex, tag, state), an end (state, pattern).

    ``want`` is a label, or an expression where ``regex``; ``tag`` is what the node reached must have, if anything. Patterns
    that begin alike share their steps, so a prefix is walked once however many go on from it.
    """

    patterns: list[Pattern]
    tagged: bool
    steps: dict[tuple, int] = field(default_factory=dict)
    ends: list[tuple[int, int, Pattern]] = field(default_factory=list)

    def __post_init__(self) -> None:
        for p in dict.fromkeys(self.patterns):
            state = 0
            for depth, e in enumerate(p.edges):
                key = (depth, state, e.up, e.regex or e.label, e.regex is not None, p.nodes[depth + 1].postag if self.tagged else None)
                state = self.steps.setdefault(key, len(self.steps) + 1)
            self.ends.append((len(p.edges), state, p))

    @property
    def depth(self) -> int:
        return max((len(p.edges) for p in self.patterns), default=0)

    def wants(self) -> tuple[list[str], list[str]]:
        """(labels, expressions) that occur in the tree."""
        return tuple(sorted({k[3] for k in self.steps if k[4] is kind}) for kind in (False, True))


def _sent(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= SENT_BYTES else df


def dictionary(edges: DataFrame, labels: list[str], expressions: list[str]) -> DataFrame:
    """(label, want): every distinct label of the corpus with what it satisfies, itself or an expression.

    Expressions are tried once for each distinct label, in a projection; rows of the corpus meet them by equality only.
    """
    tried = F.filter(F.array(*map(F.lit, expressions)), lambda r: F.rlike("label", F.concat(F.lit("^(?:"), r, F.lit(")$")))) if expressions else F.array().cast("array<string>")
    plain = F.when(F.col("label").isin(labels), F.array("label")).otherwise(F.array().cast("array<string>")) if labels else F.array().cast("array<string>")
    own = F.concat(F.transform(plain, lambda x: F.struct(x.alias("want"), F.lit(False).alias("regex"))), F.transform(tried, lambda x: F.struct(x.alias("want"), F.lit(True).alias("regex"))))
    return edges.select("label").distinct().select("label", F.explode(own).alias("w")).select("label", "w.want", "w.regex")


def _transitions(edges: DataFrame, tree: Tree) -> tuple[DataFrame, int]:
    """(depth, parent, up, label, tag, state) for the labels of the corpus, stored, and its bytes."""
    spark = edges.sparkSession
    steps = spark.createDataFrame([(*key, state) for key, state in tree.steps.items()], "depth int, parent int, up boolean, want string, regex boolean, tag string, state int")
    known = dictionary(edges, *tree.wants()).join(steps, ["want", "regex"]).select("depth", "parent", "up", "label", "tag", "state")
    known = keep(known, "transitions")
    size = known.agg(F.sum(F.octet_length("label") + F.coalesce(F.octet_length("tag"), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    return known, size


def _automaton(known: DataFrame, size: int, tree: Tree) -> tuple[list[tuple[DataFrame, int]], list[DataFrame]]:
    """By depth: ((parent, up, label, other, tagged), bytes) and (set, members), stored.

    A path that several states of the tree want is in one set of them, not in each of them: from a set, a direction and a
    label lead to one set, ``tagged`` by the tag of the node reached where some pattern asks for that tag, else ``other``.
    Labels and tags that no pattern tells apart lead to the same set, so sets are few, and a path stays one row.
    """
    sets = known.sparkSession.createDataFrame([(0, [0])], "set long, members array<int>")
    steps, states = [], []
    each = size // max(known.rows, 1) + 64
    none = F.array().cast("array<struct<tag:string,members:array<int>>>")
    for depth in range(tree.depth):
        to = sets.select("set", F.explode("members").alias("parent")).join(known.where(F.col("depth") == depth).drop("depth"), "parent")
        tag = F.col("tag")
        to = to.groupBy("set", "up", "label").agg(F.collect_set(F.when(tag.isNull(), F.col("state"))).alias("free"), F.collect_set(F.when(tag.isNotNull(), F.struct("tag", "state"))).alias("asked"))
        own = lambda t: F.array_sort(F.array_union("free", F.transform(F.filter("asked", lambda x: x["tag"] == t), lambda x: x["state"])))
        by_tag = F.transform(F.array_distinct(F.transform("asked", lambda x: x["tag"])), lambda t: F.struct(t.alias("tag"), own(t).alias("members")))
        free = F.when(F.size("free") > 0, F.array(F.struct(F.lit(None).cast("string").alias("tag"), F.array_sort("free").alias("members")))).otherwise(none)
        to = keep(to.select(F.col("set").alias("parent"), "up", "label", F.explode(F.concat(by_tag, free)).alias("c")).select("parent", "up", "label", "c.*"), "steps")
        sets = keep(to.select("members").distinct().withColumn("set", F.monotonically_increasing_id()), "sets")
        led = to.join(sets, "members").groupBy("parent", "up", "label")
        led = led.agg(F.max(F.when(tag.isNull(), F.col("set"))).alias("other"), F.map_from_entries(F.collect_list(F.when(tag.isNotNull(), F.struct("tag", "set")))).alias("tagged"))
        steps.append((led, to.rows * each))
        states.append(sets)
    return steps, states


def _paths(edges: DataFrame, tree: Tree, tokens: DataFrame | None, distinct: bool, whole: bool) -> list[tuple[DataFrame, DataFrame, int, list[Pattern]]]:
    """For each length at which patterns end: paths (sent, set, nodes[, labels][, tokens]), the ends of their sets (set,
    pattern, tag0, x0, x1 ...), the bytes of these and the patterns. Labels are carried where ``whole``."""
    spark = edges.sparkSession
    known, size = _transitions(edges.select("label"), tree)
    steps, states = _automaton(known, size, tree)
    # numbers stand for direction and label: rows are stored, shuffled and sorted without their names
    codes = keep(known.select("up", "label").distinct().withColumn("code", F.monotonically_increasing_id()), "codes")
    pairs = codes.groupBy("label").agg(F.max(F.when(~F.col("up"), F.col("code"))).alias("down_code"), F.max(F.when(F.col("up"), F.col("code"))).alias("up_code"))
    name = ["label"] if whole else []
    used = edges.join(_sent(pairs, size), "label").where("sent IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL")
    if distinct:
        used = used.where("src <> dst")
    used = keep(used.select("sent", "src", "dst", "down_code", "up_code", *name), "used-edges")
    way = lambda a, b, code: F.when(F.col(code).isNotNull(), F.struct(F.col(a).alias("near"), F.col(b).alias("far"), F.col(code).alias("code")))
    half = used.select("sent", *name, F.explode(F.array_compact(F.array(way("src", "dst", "down_code"), way("dst", "src", "up_code")))).alias("e")).select("sent", *name, "e.*")

    patterns = [p for _, _, p in tree.ends]
    read = tokens is not None
    lemmas = {i for p in patterns for i, n in enumerate(p.nodes) if n.regex and read}
    first = read and (0 in lemmas or any(p.nodes[0].postag for p in patterns))
    checked = first or bool(lemmas)
    asked = {k[0] for k in tree.steps if k[5] is not None}
    looks = [depth for depth in range(tree.depth) if depth in asked or depth + 1 in lemmas]
    token = F.struct(F.col("postag").alias("tag"), (F.col("lemma") if lemmas else F.lit(None).cast("string")).alias("lemma")).alias("token") if read else None
    if read and len(looks) + first > 0:
        tokens = tokens.select("sent", "node", token)
        tokens = keep(tokens, "tokens") if len(looks) + first > 1 else tokens
    unknown = F.lit(None).cast("struct<tag:string,lemma:string>")

    def told(rows: DataFrame, end: str, wanted: bool) -> DataFrame:
        """rows with the token at one end of their edge, where it is asked for."""
        if not wanted:
            return rows.withColumn(f"{end}_token", unknown)
        return rows.join(tokens.select("sent", F.col("node").alias(end), F.col("token").alias(f"{end}_token")), ["sent", end], "left")

    def advanced(rows: DataFrame, depth: int) -> DataFrame:
        """rows with parent and code, led to their next sets; tokens are looked up for what some pattern wants only."""
        to, bytes_ = steps[depth]
        to = to.join(F.broadcast(codes) if size <= SENT_BYTES else codes, ["up", "label"]).drop("up", "label")
        rows = told(rows.join(_sent(to, bytes_), ["parent", "code"]), "far", depth in looks)
        by_tag = F.try_element_at("tagged", F.col("far_token.tag")) if depth in asked else F.lit(None).cast("long")
        return rows.withColumn("set", F.coalesce(by_tag, "other")).where("set IS NOT NULL")

    out = []
    extra = (["labels"] if whole else []) + (["tokens"] if checked else [])
    paths = advanced(told(half, "near", first).withColumn("parent", F.lit(0).cast("long")), 0)
    begun = [*([F.array("label").alias("labels")] if whole else []), *([F.array("near_token", "far_token").alias("tokens")] if checked else [])]
    # the last node is a column of its own: rows already lie by it where tokens were looked up
    paths = paths.select("sent", "set", F.col("far").alias("near"), F.array("near", "far").alias("nodes"), *begun)
    for depth in range(1, tree.depth + 1):
        ended = [(s, p) for d, s, p in tree.ends if d == depth]
        if depth < tree.depth and ended:  # read twice: some end here, others go on
            paths = keep(paths, "paths")
        if ended:
            rows = [(s, str(p), p.nodes[0].postag, *[n.regex for n in p.nodes]) for s, p in ended]
            table = spark.createDataFrame(rows, "state int, pattern string, tag0 string, " + ", ".join(f"x{i} string" for i in range(depth + 1)))
            ends = keep(states[depth - 1].select("set", F.explode("members").alias("state")).join(table, "state").drop("state"), "ends")
            most = max(sum(len(x) for x in r[1:] if x) for r in rows) + 64
            out.append((paths.select("sent", "set", "nodes", *extra), ends, ends.rows * most, [p for _, p in ended] if checked else []))
        if depth < tree.depth:
            going = paths.withColumnRenamed("set", "parent").join(half, ["sent", "near"])
            if distinct:
                going = going.where(~F.array_contains("nodes", F.col("far")))
            going = advanced(going, depth)
            more = {"labels": "label", "tokens": "far_token"}
            paths = going.select("sent", "set", F.col("far").alias("near"), F.array_append("nodes", F.col("far")).alias("nodes"), *[F.array_append(c, F.col(more[c])).alias(c) for c in extra])
    return out


def _fitting(rows: DataFrame, ends: DataFrame, size: int, patterns: list[Pattern]) -> DataFrame:
    """Rows of paths with the patterns that end in their set, and ``patterns``' tests of the first tag and of lemmas."""
    hits = rows.join(_sent(ends, size), "set")
    if not patterns:
        return hits
    said = lambda i: F.get("tokens", F.lit(i))
    fits: Column = F.col("tag0").isNull() | (F.col("tag0") == said(0)["tag"])
    for i in range(max(len(p.nodes) for p in patterns)):
        if any(p.nodes[i].regex for p in patterns):
            fits = fits & (F.col(f"x{i}").isNull() | F.rlike(said(i)["lemma"], F.concat(F.lit("^(?:"), f"x{i}", F.lit(")$"))))
    return hits.where(fits)


def match(edges: DataFrame, patterns: list[Pattern], tokens: DataFrame | None = None, distinct: bool = True) -> DataFrame:
    """edges (sent, src, dst, label), tokens (sent, node, postag, lemma) -> sent, pattern, nodes (array), labels (array).

    The patterns make one prefix tree, whose expressions are resolved against the distinct labels of the corpus. Paths
    advance together, a hop at a time: a path joins the edges at its last node on (sentence, node), and the edge's direction
    and label lead by an equi-join from the path's set of states to the next (see ``_automaton``). So a path is one row,
    however many patterns still want it, and meets them at its end. Edges that no state uses leave first; the others are
    stored once, and so is a hop at which some patterns end and others go on. The tree is broadcast up to SENT_BYTES and shuffled beyond.

    Tags and lemma expressions are checked where ``tokens`` is given: tags of reached nodes as the path grows, the rest at
    its end; tokens are looked up only at places where some pattern asks for them. Repeated patterns count once; a pattern
    without edges matches nothing; rows with a null sentence, node or label are on no path.
    """
    tree = Tree([p for p in patterns if p.edges], tokens is not None)
    if not tree.steps:
        kind = edges.schema["src"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"sent {edges.schema['sent'].dataType.simpleString()}, pattern string, nodes array<{kind}>, labels array<string>")
    found = [_fitting(*x).select("sent", "pattern", "nodes", "labels") for x in _paths(edges, tree, tokens, distinct, True)]
    return reduce(DataFrame.unionByName, found)


def match_counts(edges: DataFrame, patterns: list[Pattern], tokens: DataFrame | None = None, distinct: bool = True) -> DataFrame:
    """(pattern, n, first_sent): how often each pattern that occurs is found by ``match``, and its least sentence.

    Paths are counted by their set of states (and by what their patterns test of tokens) before they meet the patterns, so
    the cost is that of the paths, not of paths times patterns.
    """
    tree = Tree([p for p in patterns if p.edges], tokens is not None)
    if not tree.steps:
        return edges.sparkSession.createDataFrame([], f"pattern string, n long, first_sent {edges.schema['sent'].dataType.simpleString()}")
    found = []
    for paths, ends, size, tested in _paths(edges, tree, tokens, distinct, False):
        counted = paths.groupBy("set", *(["tokens"] if tested else [])).agg(F.count("*").alias("n"), F.min("sent").alias("first_sent"))
        found.append(_fitting(counted, ends, size, tested).select("pattern", "n", "first_sent"))
    return reduce(DataFrame.unionByName, found).groupBy("pattern").agg(F.sum("n").alias("n"), F.min("first_sent").alias("first_sent"))


#: Bits of a number that tell which wants a sentence has.
BITS = 60


def _possible(edges: DataFrame, tree: Tree, whole: bool) -> tuple[DataFrame | None, DataFrame]:
    """(sent, w0, w1 ...) stored if ``whole``, and (w0, w1 ..., n, pattern): the patterns of each distinct set of wants, which n sentences have.

    Labels are resolved by the dictionary; a sentence's wants are bits of numbers, put together without a row for each want.
    Sentences have few distinct sets, and only those meet the patterns: of each pattern's wants the one in fewest sentences
    is its anchor; a set meets the patterns of its anchors by equality, and the other wants are looked up in the set.
    """
    spark = edges.sparkSession
    labels, expressions = tree.wants()
    number = {(w, kind): i for i, (w, kind) in enumerate([*((x, False) for x in labels), *((x, True) for x in expressions)])}
    marks = [f"w{k}" for k in range((len(number) - 1) // BITS + 1)]
    ids = spark.createDataFrame([(*w, *(1 << i % BITS if i // BITS == k else 0 for k in range(len(marks)))) for w, i in number.items()], "want string, regex boolean, " + ", ".join(f"{m} long" for m in marks))
    both = lambda: [F.bit_or(m).alias(m) for m in marks]
    words = keep(dictionary(edges.select("label"), labels, expressions).join(ids, ["want", "regex"]).groupBy("label").agg(*both()), "label-wants")
    size = words.agg(F.sum(F.octet_length("label") + 8 * len(marks) + 64).alias("n")).first()["n"] or 0
    have = edges.select("sent", "label").join(_sent(words, size), "label").groupBy("sent").agg(*both())
    if whole:
        have = keep(have, "sentence-wants")
    bits = lambda k: F.filter(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.when(F.call_function("bit_get", F.col(marks[k]), i) == 1, i + BITS * k)), lambda i: i.isNotNull())
    sets = keep(have.groupBy(*marks).agg(F.count("*").alias("n")).withColumn("have", F.concat(*map(bits, range(len(marks))))), "sets-of-wants")
    often = {r["id"]: r["n"] for r in sets.select(F.explode("have").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("n")).collect()}  # a row a want
    rows = []
    for _, _, p in tree.ends:
        wants = sorted({number[e.regex or e.label, e.regex is not None] for e in p.edges}, key=lambda i: often.get(i, 0))
        rows.append((wants[0], str(p), wants[1:]))
    need = spark.createDataFrame(rows, "id int, pattern string, others array<int>")
    need = _sent(need, sum(len(r[1]) + 8 * len(r[2]) + 64 for r in rows))
    met = sets.withColumn("id", F.explode("have")).join(need, "id")
    return (have if whole else None), met.where(F.size(F.array_except("others", "have")) == 0).select(*marks, "n", "pattern")


def possible(edges: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """(sent, pattern): patterns all of whose labels occur in a sentence; a pre-check before matching.

    The patterns of a sentence are those of its set of wants (see ``_possible``), which are sent to all executors up to
    SENT_BYTES. Patterns without edges are possible nowhere.
    """
    tree = Tree([p for p in patterns if p.edges], False)
    if not tree.steps:
        return edges.sparkSession.createDataFrame([], f"sent {edges.schema['sent'].dataType.simpleString()}, pattern string")
    have, met = _possible(edges, tree, True)
    marks = have.columns[1:]
    met = keep(met.groupBy(*marks).agg(F.collect_list("pattern").alias("patterns")), "patterns-of-sets")
    size = met.agg(F.sum(F.aggregate("patterns", F.lit(64).cast("long"), lambda n, x: n + F.octet_length(x) + 16)).alias("n")).first()["n"] or 0
    return have.join(_sent(met, size), marks).select("sent", F.explode("patterns").alias("pattern"))


def possible_counts(edges: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """(pattern, n): in how many sentences each pattern is ``possible``; the cost is that of the edges and of the distinct
    sets of wants, not of sentences times patterns."""
    tree = Tree([p for p in patterns if p.edges], False)
    if not tree.steps:
        return edges.sparkSession.createDataFrame([], "pattern string, n long")
    return _possible(edges, tree, False)[1].groupBy("pattern").agg(F.sum("n").alias("n"))


def inferiors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (sent, start), edges (sent, src, dst) -> (sent, start, node, depth): all below, each once at its least depth.

    Sentences are partitioned once. Each level joins the last frontier alone, which is stored with its number of rows, so
    the cost is that of the rows found, not of the levels before; it ends with a level that adds nothing, however deep.
    Cycles end because known nodes aren't followed again.
    """
    links = keep(edges.select("sent", F.col("src").alias("node"), F.col("dst").alias("to")), "links")  # repeated ones meet in a level
    front = keep(starts.select("sent", "start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "front")
    levels = [front]
    known = front
    while front.rows:
        # grouped by what the join with known rows asks for, so both take one shuffle
        step = front.join(links, ["sent", "node"]).select("sent", "start", F.col("to").alias("node"), (F.col("depth") + 1).alias("depth")).groupBy("sent", "start", "node").agg(F.min("depth").alias("depth"))
        front = keep(step.join(known, ["sent", "start", "node"], "left_anti"), "front")
        levels.append(front)
        if len(levels) % 16 == 0:  # one table instead of many, for short plans
            levels = [keep(reduce(DataFrame.unionByName, levels), "levels")]
        known = reduce(DataFrame.unionByName, levels)
    return known
