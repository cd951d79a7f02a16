"""The extraction engine on small parsed sentences: codec, patterns, extractors, voice, induction, features, sinks."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import distance as D
from factloom.functions import extraction as X
from factloom.functions import graph as G
from factloom.functions.batch import Batch, Pairs
from factloom.functions import induction as I
from factloom.functions.features import _bad, confidence, features
from factloom.functions.native import parse_graph
from factloom.functions.patterns import find, parse_pattern
from factloom.functions.voice import switched
from factloom.operators import evaluate as V
from factloom.operators import extract as E
from factloom.operators import learn as L
from factloom.operators import match as M
from factloom.plans import engine as Q
from factloom.plans.queries import SENTENCES
from factloom.sources import readers as R
from factloom.sources import writers as W

from . import plain_induction, plain_voice

SPLIT = "(into_IN_8_0), (,_,_2_0), amod(year_NN_1_0, Last_JJ_0_0); tmod(split_VBN_7_0, year_NN_1_0); det(authority_NN_5_0, the_DT_3_0); nn(authority_NN_5_0, Harbour_NNP_4_0); nsubjpass(split_VBN_7_0, authority_NN_5_0); auxpass(split_VBN_7_0, was_VBD_6_0); num(offices_NNS_11_0, three_CD_9_0); amod(offices_NNS_11_0, regional_JJ_10_0); prep_into(split_VBN_7_0, offices_NNS_11_0)"
CAPTAIN = "(,_,_2_0), (of_IN_4_0), (,_,_8_0), (._._11_0), nn(Rask_NNP_1_0, Ida_NNP_0_0); appos(Rask_NNP_1_0, captain_NN_3_0); prep_of(captain_NN_3_0, team_NN_7_0); det(team_NN_7_0, the_DT_5_0); amod(team_NN_7_0, blue_JJ_6_0); nsubj(scored_VBD_9_0, Rask_NNP_1_0); advmod(scored_VBD_9_0, twice_RB_10_0)"
CORK = "(,_,_1_0), (in_IN_6_0), (,_,_8_0), appos(Cork_NNP_0_0, bark_NN_4_0); det(bark_NN_4_0, a_DT_2_0); amod(bark_NN_4_0, light_JJ_3_0); partmod(bark_NN_4_0, grown_VBN_5_0); prep_in(grown_VBN_5_0, Portugal_NNP_7_0); nsubj(floats_VBZ_9_0, Cork_NNP_0_0)"
HOPES = "(,_,_3_0), (against_IN_4_0), (,_,_7_0), (to_TO_13_0), (._._16_0), det(council_NN_1_0, The_DT_0_0); nsubj(hopes_VBZ_2_0, council_NN_1_0); prep_against(hopes_VBZ_2_0, advice_NN_6_0); det(advice_NN_6_0, all_DT_5_0); xcomp(hopes_VBZ_2_0, sell_VB_9_0); aux(sell_VB_9_0, to_TO_8_0); poss(theatre_NN_12_0, its_PRP$_10_0); amod(theatre_NN_12_0, oldest_JJS_11_0); dobj(sell_VB_9_0, theatre_NN_12_0); det(bank_NN_15_0, a_DT_14_0); prep_to(sell_VB_9_0, bank_NN_15_0)"
MUSEUM = SENTENCES[1][1]
PAIR = "nsubj(planted_VBD_3_0, Omar_NNP_0_0); conj_and(Omar_NNP_0_0, Lena_NNP_2_0); dobj(planted_VBD_3_0, tree_NN_5_0); det(tree_NN_5_0, a_DT_4_0); rcmod(tree_NN_5_0, blooms_VBZ_7_0); nsubj(blooms_VBZ_7_0, that_WDT_6_0)"
#: The places and offsets that the voice switch must give.
HIT = "nsubj(hit_VBD_1_8, Michael_NNP_0_0); dobj(hit_VBD_1_8, ball_NN_3_16); punct(hit_VBD_1_8, ._._4_20); det(ball_NN_3_16, the_DT_2_12)"
HIT_PASSIVE = "det(ball_NN_1_4, the_DT_0_0); auxpass(hit_VBD_2_13, was_VBD_1_9); nsubjpass(hit_VBD_2_13, ball_NN_1_4); prep(hit_VBD_2_13, by_IN_3_17); punct(hit_VBD_2_13, ._._6_28); pobj(by_IN_3_17, Michael_NNP_4_20)"
WAS_HIT = "det(ball_NN_1_4, The_DT_0_0); nsubjpass(hit_VBN_3_13, ball_NN_1_4); auxpass(hit_VBN_3_13, was_VBD_2_9); prep(hit_VBN_3_13, by_IN_4_17); punct(hit_VBN_3_13, ._._6_27); pobj(by_IN_4_17, Michael_NNP_5_20)"
HIT_ACTIVE = "nsubj(hit_VBN_1_8, Michael_NNP_0_0); dobj(hit_VBN_1_8, ball_NN_3_16); punct(hit_VBN_1_8, ._._4_21); det(ball_NN_3_16, The_DT_2_12)"


def facts(graph, pattern, kind="general", **how):
    """Raw facts of one graph; templates are filled in by columns."""
    return X.facts(Batch.of([G.parse(graph)]), [X.Extractor(kind, parse_pattern(pattern), **how)], restrict=False)[0]


def texts(graph, pattern, **how):
    return [f"({f['arg1']['text']}; {f['rel']['text']}; {f['arg2']['text']})" for f in facts(graph, pattern, **how)]


def filled(spark, graph, template, pattern):
    out = E.extract(spark.createDataFrame([(graph,)], "graph string"), ["template", f"{template}\t{pattern}\t1.0"])
    return [r.fact for r in out.select(E.fact_text().alias("fact")).collect()]


@pytest.mark.parametrize("raw", [SPLIT, CAPTAIN, CORK, HOPES, MUSEUM, HIT, WAS_HIT, "det(a_DT_1_0, ,_,_0_0); punct(a_DT_1_0, _,_3_0)"])
def test_graph_codec(raw):
    g = G.parse(raw)
    assert str(G.parse(str(g))) == str(g) and len(g.edges) == raw.count("; ") + 1


@pytest.mark.parametrize("raw", ["", "no graph", "nsubj(a_NN_0_0)", "(((", "nsubj(a_NN_0_0, b_NN_1_0) rest"])
def test_bad_graphs(raw):
    with pytest.raises(ValueError):
        G.parse(raw)


def test_extractors(spark):
    assert texts(CAPTAIN, "{arg1} >appos> {rel} >prep_of> {arg2}", kind="specific", relation="be the captain of", lemmas=("captain",)) == ["(Ida Rask; be the captain of; the blue team)"]
    assert texts(CAPTAIN, "{arg1} >appos> {rel} >prep_of> {arg2}", kind="specific", relation="be the captain of", lemmas=("keeper",)) == []
    assert filled(spark, SPLIT, "be {rel} into", "{arg1} <nsubjpass< {rel} >prep_into> {arg2}") == ["(the Harbour authority; was split into; three regional offices)"]
    assert filled(spark, CORK, "be {rel} in", "{arg1} >appos> {rel1} >partmod> {rel2} >prep_in> {arg2}") == ["(Cork; be a light bark grown in; Portugal)"]
    assert filled(spark, HOPES, "{rel}", "{arg1} <nsubj< {rel1} >xcomp> {rel2} >dobj> {arg2}") == ["(The council; hopes to sell; its oldest theatre)"]
    assert filled(spark, MUSEUM, "{rel} of", "{arg1} <nsubj< {rel1} >dobj> {rel2} >prep_of> {arg2}") == ["(the museum 's new wing; holds a large collection of; Baltic amber)"]
    assert texts(SENTENCES[2][1], "{arg1} <nsubj< {rel} >prep_over> {arg2}") == ["(hungry gulls; circled; the flooded harbour)"]
    assert texts(SENTENCES[2][1], "{arg1} <nsubj< {rel:postag=XX} >prep_over> {arg2}") == []
    assert texts(PAIR, "{arg1} <nsubj< {rel} >dobj> {arg2}") == ["(Omar Lena; planted; a tree that blooms)"]
    with pytest.raises(ValueError, match="arg1, arg2 and rel"):
        facts(MUSEUM, "{arg1} <nsubj< {slot0} >dobj> {arg2}")


def test_be_goes_behind_a_modal(spark):
    modal = "nsubjpass(seen_VBN_3_0, Mars_NNP_0_0); aux(seen_VBN_3_0, can_MD_1_0); prep_in(seen_VBN_3_0, May_NNP_5_0)"
    assert filled(spark, modal, "be {rel} in", "{arg1} <nsubjpass< {rel} >prep_in> {arg2}") == ["(Mars; can be seen in; May)"]
    bare = "nsubjpass(seen_VBN_1_0, Mars_NNP_0_0); prep_in(seen_VBN_1_0, May_NNP_3_0)"
    assert filled(spark, bare, "be {rel} {where}", "{arg1} <nsubjpass< {rel} >{where:regex=prep_(.*)}> {arg2}") == ["(Mars; be seen in; May)"]


def test_walks_of_a_batch():
    """Blocked walks, islands, subtrees and stretches of many queries at once."""
    g = "(x_X_3_0), det(d_NN_4_0, a_DT_0_0); amod(d_NN_4_0, b_JJ_1_0); amod(d_NN_4_0, c_JJ_2_0); amod(d_NN_4_0, e_JJ_5_0); amod(d_NN_4_0, f_JJ_7_0)"
    b = Batch.of([G.parse(MUSEUM), G.parse(g)])
    shift = int(b.begin[1])
    node = np.array([shift + 4, shift + 4])
    until = Pairs(np.array([b.tokens + shift + 1]), b.tokens)
    got = b.widened(node, until, ("det", "amod")).lists(2)
    assert [[t - shift for t in x] for x in got] == [[0, 1, 2, 3, 4, 5, 6], [2, 3, 4, 5, 6]]
    island = b.touching(node, until, ("det", "amod")).lists(2)
    assert [[t - shift for t in x] for x in island] == [[4, 5], [4, 5]]
    row, below = b.subtrees(node[:1], b.labelled(("amod",)))
    assert [[t - shift for t in x] for x in below.lists(len(row))] == [[1], [2], [5], [6]]
    assert b.reach(b.one(np.array([7])), b.down()).lists(1) == [[*range(1, 11), 12, 13]]
    cycle = Batch.of([G.parse("x(a_NN_0_0, b_NN_1_0); y(b_NN_1_0, a_NN_0_0)")])
    assert cycle.reach(cycle.one(np.array([0])), cycle.down()).lists(1) == [[0, 1]]
    empty = Batch.of([])
    assert X.facts(empty, X.read_model(X.SEED_MODEL)) == []


@pytest.mark.parametrize(("raw", "symmetric"), [("{arg1} <nsubj< {rel:postag=VBZ} >dobj> {arg2}", False), ("{arg1} <nsubj< {rel:postag=VBD} >nsubj> {arg2}", True), ("{arg1} <prep_of< {rel:postag=NN} >prep_of> {arg2}", True), ("{rel:postag=NN} <nn< {arg1} >nn> {arg2}", False)])
def test_patterns(raw, symmetric):
    p = parse_pattern(raw)
    assert str(p) == raw and p.symmetric == symmetric and p.reflection.reflection == p


@pytest.mark.parametrize("raw", ["", "{arg1}  {arg2}", "{foo} >x> {arg1}", "{arg1} <x> {arg2}"])
def test_bad_patterns(raw):
    with pytest.raises(ValueError):
        parse_pattern(raw)


def test_validity():
    assert not parse_pattern("{arg1} <dep< {rel} >dobj> {arg2}").valid
    assert not parse_pattern("{arg1} <prep_of< {rel} >prep_in> {arg2}").valid
    assert not parse_pattern("{slot0} <nsubj< {rel} >dobj> {arg2}").valid


def test_voice():
    assert turned([HIT, WAS_HIT, CORK]) == [(0, HIT_PASSIVE), (1, HIT_ACTIVE)]


def turned(graphs):
    row, out = switched(Batch.of([G.parse(g) for g in graphs]))
    return sorted(zip(row.tolist(), out.to_pylist(), strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_batches_turn_what_sentences_do(seed):
    """Random clauses in both voices, several verbs, loose trees and shared nodes: equal to the plain version, clause by clause."""
    rng = random.Random(seed)
    graphs = []
    for _ in range(400):
        n = rng.randint(4, 11)
        verbs = rng.sample(range(n), rng.randint(1, 2))
        word = lambda i, verbs=verbs: rng.choice(["by", "ship", "Ann", "a", "was"]) + f"_{'VBD' if i in verbs else rng.choice(['NN', 'DT', 'IN', 'VBZ'])}_{i}_{rng.randint(0, 50)}"
        nodes = [word(i) for i in range(n)]
        edges = {}
        for v in verbs:
            rest = [i for i in range(n) if i != v]
            rng.shuffle(rest)
            if rng.random() < 0.5:
                edges[v, rest[0]], edges[v, rest[1]] = "nsubj", "dobj"
            else:
                nodes[rest[2]] = f"by_IN_{rest[2]}_0"
                edges[v, rest[0]], edges[v, rest[1]], edges[v, rest[2]] = "nsubjpass", "auxpass", "prep"
                if len(rest) > 3:
                    edges[rest[2], rest[3]] = "pobj"
        for _ in range(rng.randint(0, 4)):
            a, b = rng.sample(range(n), 2)
            edges.setdefault((a, b), rng.choice(["det", "amod", "prep", "nsubj", "pobj"]))
        graphs.append("; ".join(f"{x}({nodes[a]}, {nodes[b]})" for (a, b), x in edges.items()))
    assert turned(graphs) == sorted((i, str(t)) for i, g in enumerate(graphs) for t in plain_voice.switch_voice(G.parse(g)))


@pytest.mark.parametrize(("graph", "fact", "longest", "want"), [
    (SPLIT, ("be split into", "harbour authority", "regional office", "harbour authority split regional office"), None, ["{arg1} <nsubjpass< {rel:postag=VBN} >prep_into> {arg2}"]),
    (HOPES, ("sell", "council", "theatre", "council hope sell theatre"), None, ["{arg1} <nsubj< {slot0:postag=VBZ} >xcomp> {rel:postag=VB} >dobj> {arg2}"]),
    (MUSEUM, ("hold collection of", "wing", "amber", "wing hold collection amber"), None, ["{arg1} <nsubj< {rel0:postag=VBZ} >dobj> {rel1:postag=NN} >prep_of> {arg2}"]),
    (MUSEUM, ("hold collection of", "wing", "amber", "wing hold collection amber"), 3, []),
])
def test_induction(graph, fact, longest, want):
    assert [p for _, p in induced([graph], [fact], longest)] == want


def induced(graphs, facts, longest=None):
    """(number of the graph, pattern) for facts (rel, arg1, arg2, lemmas)."""
    others = [[w for w in dict.fromkeys(lemmas.split()) if w not in {*a.split(), *b.split()}] for _, a, b, lemmas in facts]
    row, patterns = I.induce(Batch.of([G.parse(g) for g in graphs]), I.Facts([f[1] for f in facts], [f[2] for f in facts], [f[0].split() for f in facts], others), longest)
    return sorted((int(i), str(p)) for i, p in zip(row, patterns, strict=True))


def random_facts(seed, n=700):
    """Graphs with cycles, several governors, names and noun groups, and facts of their words."""
    rng = random.Random(seed)
    words, tags = ["ship", "order", "port", "big", "bigship", "anna", "bell", "of", "key"], ["NN", "NNP", "VB", "JJ", "NNS", "IN"]
    labels = ["nsubj", "dobj", "prep_of", "prep", "pobj", "nn", "nn", "amod", "punct", "dep", "conj_and"]
    graphs, facts = [], []
    while len(graphs) < n:
        size = rng.randint(3, 9)
        nodes = [f"{rng.choice(words)}_{rng.choice(tags)}_{i}_0" for i in range(size)]
        edges = {}
        for i in range(1, size):
            j = rng.randrange(i) if rng.random() < 0.5 else rng.randrange(size)
            if i != j:
                edges[nodes[j], nodes[i]] = rng.choice(labels)
        for _ in range(rng.randint(0, 3)):
            edges[tuple(rng.sample(nodes, 2))] = rng.choice(labels)
        for i in range(size - 1):
            if rng.random() < 0.25:
                edges[nodes[i + 1], nodes[i]] = "nn"
        if not edges:
            continue
        used = {x for pair in edges for x in pair}
        graph = "".join(f"({x}), " for x in nodes if x not in used) + "; ".join(f"{x}({a}, {b})" for (a, b), x in edges.items())
        own = [x.text for x in plain_induction.prepare(G.parse(graph)).vertices] or ["x"]
        pick = lambda own=own: rng.choice(own) if rng.random() < 0.85 else " ".join(rng.choice(words) for _ in range(2))
        a, b, rel = pick(), pick(), " ".join(pick() for _ in range(rng.choice([1, 1, 2])))
        graphs.append(graph)
        facts.append((rel, a, b, f"{a} {rel} {b}" if rng.random() < 0.7 else f"{a} {rel}"))
    return graphs, facts


@pytest.mark.parametrize("longest", [None, 3, 4])
def test_batches_induce_what_sentences_do(longest):
    graphs, facts = random_facts(1)
    want = sorted((i, str(p)) for i, (g, f) in enumerate(zip(graphs, facts, strict=True)) for p in plain_induction.induce(plain_induction.prepare(G.parse(g)), *f, longest))
    assert induced(graphs, facts, longest) == want and len(want) > 20
    assert induced([], []) == []


def test_patterns_of_a_table_of_facts(spark):
    graphs, facts = random_facts(2, 300)
    odd = [("r", None, "b", "r b", "t", graphs[0]), ("r", "a", "b", "a r b", "t", "no graph"), ("r", "a", "b", "a r b", None, None)]
    rows = [(*f, str(i), g) for i, (f, g) in enumerate(zip(facts, graphs, strict=True))]
    table = spark.createDataFrame([*rows, *rows[:50], *odd], "rel string, arg1 string, arg2 string, lemmas string, text string, deps string")
    got = sorted((r.text, r.pattern) for r in L.build_patterns(table).collect())
    want = [(str(i), str(p)) for i, (g, f) in enumerate(zip(graphs, facts, strict=True)) if "_VB_" in g for p in plain_induction.induce(plain_induction.prepare(G.parse(g)), *f) if p.valid]
    assert got == sorted(want + [x for x in want if int(x[0]) < 50]) and got


def test_extract(spark):
    rows = [*SENTENCES, (8, None), (9, "not a graph")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "sent long, graph string, pattern string, tokens_read int")
    out = E.with_confidence(E.extract(df)).withColumn("fact", E.fact_text()).withColumn("text", F.lit("t"))
    found = {(r.sent, r.fact) for r in out.collect()}
    assert found == {
        (1, "(the brown river; floods; two low meadows)"), (2, "(the museum 's new wing; holds; a large collection of Baltic amber)"), (2, "(the museum 's new wing; holds a large collection of Baltic amber since; March)"),
        *((3, f"(hungry gulls; circled {x})") for x in ("after; the storm", "for; hours", "over; the flooded harbour")), (4, "(the tower; is the symbol of; the town)[attrib=Local guides claim]"), (5, "(Peter; paints; the fence)[enabler=if the weather holds]"),
    }
    assert all(0 < r.confidence < 1 for r in out.collect())
    assert out.select(*[c.alias(f"f{i}") for i, c in enumerate(features().values())]).count() == len(found)
    for name, form in W.FORMATS.items():
        assert all(r.line for r in form(out).collect()), name
    assert len(W.TABBED_COLUMNS) == 9 and all(len(r.line.split("\t")) == 9 for r in W.tabbed(out).collect())
    assert all(len(r.line.split("\t")) == 7 for r in W.tabbed_single(out).collect())
    with pytest.raises(Exception, match="dependency graph"):
        E.extract(spark.createDataFrame([(9, "not a graph")], "sent long, graph string"), config=E.Configuration(ignore_errors=False)).collect()


def test_sentences_without_extractions_say_so(spark):
    df = spark.createDataFrame([(1, "first", SENTENCES[0][1]), (2, "second", "det(a_DT_0_0, b_NN_1_0)"), (3, "third", None)], "n int, text string, graph string")
    out = E.extract(df, keep_empty=True).withColumn("confidence", F.lit(0.5))
    assert [r.line for r in W.dialogue(out, "text", ["n"]).orderBy("n").collect()] == ["first\n0.5: (the brown river; floods; two low meadows)", "second\nNo extractions found.", "third\nNo extractions found."]
    assert [r.line for r in W.dialogue(out, "text", ["n"], threshold=0.9).orderBy("n").collect()][0] == "first"


def test_parsers(spark, tmp_path):
    df = spark.createDataFrame([("Marta repairs an old printer .",), (SENTENCES[1][1],), ("nothing here",)], "graph string")
    got = {r.fact for r in E.extract(df, parser=R.PARSERS["sniff"]).select(E.fact_text().alias("fact")).collect()}
    assert any(x.startswith("(Marta; repairs; ") for x in got) and any(x.startswith("(the museum 's new wing; holds; ") for x in got)
    (tmp_path / "in.txt").write_bytes("caf\xe9 one\r\n\r\ntwo".encode("latin-1"))
    assert sorted(r.sentence for r in R.lines(spark, str(tmp_path / "in.txt"), "ISO-8859-1").collect()) == ["caf\xe9 one", "two"]
    assert [r.sentence for r in R.stdin_lines(spark, ["a b\n", "\n", "c"]).collect()] == ["a b", "c"]
    (tmp_path / "p.txt").write_text("One two.\nThree four. Five\n\n\nSix\n")
    assert [r.sentence for r in R.paragraphs(spark, str(tmp_path / "p.txt")).orderBy("paragraph", "position").collect()] == ["One two.", "Three four.", "Five", "Six"]
    (tmp_path / "w.txt").write_text("# list\nSay\n\ntell\n")
    assert R.word_list(spark, str(tmp_path / "w.txt")) == ["say", "tell"]
    (tmp_path / "s.txt").write_text(f"x\t{MUSEUM}\nx\tbad\n")
    assert R.sniffed(spark, str(tmp_path / "s.txt")).count() == 1
    (tmp_path / "many").mkdir()
    for i in range(4):
        (tmp_path / "many" / f"{i}.txt").write_text("\n".join("\t".join(["x"] * i + [graph] + ["y"] * (i % 2)) for _, graph in SENTENCES) + "\nx\tbad\n")
    got = [(r.file[-5:], r.graph) for r in R.sniffed(spark, str(tmp_path / "many")).collect()]
    assert sorted(got) == sorted((f"{i}.txt", graph) for i in range(4) for _, graph in SENTENCES)
    (tmp_path / "many" / "5.txt").write_text("no graph\n")
    with pytest.raises(Exception, match="no field of the first line"):
        R.sniffed(spark, str(tmp_path / "many")).collect()


@pytest.mark.parametrize("encoding", ["utf-16", "utf-16-le", "utf-16-be", "utf-32", "utf-32-le", "utf-32-be", "utf-16-be marked"])
def test_wide_encodings_in_ranges(spark, tmp_path, encoding):
    """Files in many ranges give the lines of their twin in UTF-8, whatever bytes 10 stand inside characters."""
    rng = random.Random(encoding)
    letters = ["a", "é", "\u0a0a", "\u0a00", "\u000b", "\u010a", "\u0a10", "\U0001f60a", "\U00010a0a", "日", " ", "\r"]
    texts = ["\n".join("".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(n)) + rng.choice(["", "\n"]) for n in (1, 40, 300)]
    for i, text in enumerate(texts):
        raw = b"\xfe\xff" + text.encode("utf-16-be") if "marked" in encoding else text.encode(encoding)
        (tmp_path / f"{i}.txt").write_bytes(raw)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1001b")
    try:
        name = encoding.split()[0] if "marked" not in encoding else "UTF-16"
        got = sorted((r.file[-5:], r.sentence) for r in R.lines(spark, str(tmp_path), name).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    strip = lambda x: x[:-1] if x.endswith("\r") else x
    assert got == sorted((f"{i}.txt", strip(x)) for i, text in enumerate(texts) for x in text.split("\n") if strip(x))


def test_pieces_of_wide_lines_are_few_rows(spark, tmp_path, monkeypatch):
    """A range with thousands of bytes 10 is stored in rows of many pieces, and lines across these rows are whole."""
    text = "\n".join(f"{i}: \u0a0a \u0b0a \u0a00é" for i in range(4000))
    kept = []
    monkeypatch.setattr(R, "keep", lambda df, name, *by, keep=R.keep: kept.append(keep(df, name, *by)) or kept[-1])
    for name in ("utf-16-le", "utf-16-be", "utf-16"):
        (tmp_path / name).write_bytes(text.encode(name))
        assert sorted(r.sentence for r in R.lines(spark, str(tmp_path / name), name).collect()) == sorted(text.split("\n"))
    assert kept and all(x.rows < 100 for x in kept)


def test_known_facts_of_repeated_orders(spark, tmp_path):
    """An order that stands twice gives its pattern twice; its sentence meets no other row, and the work is dealt to all cores."""
    from factloom.plans.engine import known_patterns

    spark.createDataFrame([(10, 7), (10, 7), (21, 8)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = known_patterns(spark, str(tmp_path), 3)
    assert sorted(r.o_orderkey for r in got.collect()) == [10, 10, 21]
    assert "Join" not in got._jdf.queryExecution().toString() and got.rdd.getNumPartitions() > 4


def test_failed_write_leaves_nothing(spark, tmp_path):
    good = spark.range(20).select(F.format_string("line %d", "id").alias("line"))
    W.write_lines(good, str(tmp_path / "good"), "HEAD")
    parts = sorted(x for x in (tmp_path / "good").iterdir() if x.name.startswith("part-"))
    assert "".join(x.read_text() for x in parts).startswith("HEAD\nline 0\n") and sum(x.read_text().count("\n") for x in parts) == 21
    bad = good.repartition(4).select(F.when(F.col("line") == "line 13", F.raise_error(F.lit("broken"))).otherwise(F.col("line")).alias("line"))
    with pytest.raises(Exception, match="broken"):
        W.write_lines(bad, str(tmp_path / "bad"), "HEAD")
    assert not [x for x in (tmp_path / "bad").rglob("part-*")]


def test_console_goes_on_from_its_checkpoint(spark, tmp_path):
    """Lines that come while the stream runs, and after it was stopped and started again, are answered once each."""
    import queue

    from factloom.streaming.stream import console

    answer = lambda batch: batch.select("number", F.concat(F.lit("heard "), "sentence").alias("line"))

    def talk(lines):
        said, box = [], queue.Queue()
        query = console(spark, answer, iter(box.get, None), said.append, str(tmp_path / "spool"), str(tmp_path / "checkpoint"), prompt=">")
        for line in lines:
            box.put(line + "\n")
            for _ in range(300):
                if f"heard {line}" in said or not line:
                    break
                query.awaitTermination(0.1)
        box.put(None)
        query.feeder.join(60)
        assert not query.isActive and said[0] == ">" == said[-1]
        return [x for x in said if x != ">"]

    assert talk(["one", "two", "", "three"]) == ["heard one", "heard two", "heard three"]
    assert talk(["four", "two"]) == ["heard four", "heard two"]


def test_instances_and_training(spark, tmp_path):
    raw = E.extract(spark.createDataFrame(SENTENCES, "sent long, graph string"), config=E.Configuration(simplify_tags=False))  # as the graphs are written
    out = E.with_confidence(raw).withColumn("text", F.lit("t")).withColumn("score", F.col("sent") % 2 == 0)
    W.labelled(out).select("line").write.text(str(tmp_path / "labelled"))
    back = R.instances(spark, str(tmp_path / "labelled"))
    one = lambda d: {(r["arg1"]["text"], r["rel"]["text"], r["arg2"]["text"], r["score"], r["enabler"], r["attrib_arg"], r["pattern_confidence"]) for r in d.collect()}
    assert one(back) == one(out)
    known = features()
    values = lambda d: sorted(tuple(r) for r in d.select(*[known[n].alias(n) for n in known]).collect())
    assert values(back) == values(out)
    weights = V.train_from_instances(back, ["arg1 is proper", "rel contains verb"])
    assert set(weights) == {"Intercept", "arg1 is proper", "rel contains verb"}
    W.weight_lines(spark, weights).write.text(str(tmp_path / "weights"))
    assert R.weights(spark, str(tmp_path / "weights")) == pytest.approx(weights)
    report = W.feature_report(out).collect()
    assert [r["yield"] for r in sorted(report, key=lambda r: r["yield"])] == list(range(1, len(report) + 1)) and len(W.weight_row()) == len(report[0])
    with pytest.raises(Exception, match="bad score"):
        R.parse_instances(spark.createDataFrame([("\t".join(["2", *["x"] * 12]),)], "line string")).select("score").collect()


def test_closure_and_induction_have_no_depth_limit(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(100)] + [(1, 100, 0)], "sent int, src int, dst int")
    got = {(r.node, r.depth) for r in M.inferiors(edges, spark.createDataFrame([(1, 0)], "sent int, start int")).collect()}
    assert got == {(i, i) for i in range(101)}
    chain = "; ".join([f"nsubj(v{0}_VB_1_0, a_NN_0_0)"] + [f"xcomp(v{i}_VB_{i + 1}_0, v{i + 1}_VB_{i + 2}_0)" for i in range(5)] + ["dobj(v5_VB_6_0, b_NN_7_0)"])
    found = induced([chain], [("v0 v1 v2 v3 v4 v5", "a", "b", "a v0 v5 b")])
    assert [len(parse_pattern(p).edges) for _, p in found] == [7]


def test_resampled_scores(spark):
    rows = spark.createDataFrame([(i, s, i % 3 != 0 if s == "a" else i % 2 == 0, float(i)) for i in range(60) for s in "ab"], "sentence long, system string, correct boolean, conf double")
    out = V.resampled_auc(rows, "conf", ["sentence"], 20)
    assert out.count() == 40 and out.where("auc > 0").count() == 40
    assert 0 <= V.significance(rows, "a", "b", 200).first().p_value < 0.2


def test_if_before_argument(spark):
    row = E.extract(spark.createDataFrame(SENTENCES[:1], "sent long, graph string")).drop("arg1", "tokens")
    tokens = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(w).alias("text"), F.lit(t).alias("postag"), F.lit(w).alias("lemma"), F.lit(0).alias("offset")) for i, (w, t) in enumerate([("If", "IN"), ("he", "PRP"), ("wins", "VBZ"), ("it", "PRP"), (".", ".")])])
    row = row.withColumn("tokens", tokens).withColumn("arg1", F.struct(F.lit("he").alias("text"), F.lit(1).alias("s"), F.lit(2).alias("e"), F.array(F.lit(1)).alias("idx")))
    got = row.select(features()["if right before arg1"].alias("x"), features()["arg1 contains pronoun"].alias("y")).first()
    assert (got.x, got.y) == (1.0, 1.0)
    assert row.select(confidence({"Intercept": 0.0}).alias("c")).first().c == 0.5


def test_joins_find_what_the_matcher_finds(spark):
    patterns = [parse_pattern(p) for p in ("{arg1} <nsubj< {rel} >dobj> {arg2}", "{arg1} <nsubj< {rel:postag=NN} >{prep:regex=prep_(.*)}> {arg2}", "{arg1} <nsubj< {rel1} >dobj> {rel2} >prep_for> {arg2}")]
    graphs = {s: G.parse(raw) for s, raw in [*SENTENCES, (6, SPLIT), (7, HOPES)]}
    edges = spark.createDataFrame([(s, e.src.start, e.dst.start, e.label) for s, g in graphs.items() for e in g.edges], "sent long, src int, dst int, label string")
    tokens = spark.createDataFrame([(s, n.start, n.postag, n.lemma) for s, g in graphs.items() for n in g.nodes], "sent long, node int, postag string, lemma string")
    got = sorted((r.sent, r.pattern, tuple(r.nodes)) for r in M.match(edges, patterns, tokens).collect())
    want = sorted((s, str(p), tuple(m.nodes[n.alias].start for n in p.nodes)) for s, g in graphs.items() for p in patterns for m in find(p, g))
    assert got == want and len(got) >= 3


def random_corpus(spark, seed=3, sentences=25):
    """Graphs of few labels in which nodes have several governors, and their tables."""
    rng = random.Random(seed)
    labels, tags, words = ["nsubj", "dobj", "prep_of", "prep_in", "amod"], ["NN", "VB", "JJ"], ["ship", "order", "port", "big"]
    graphs = {}
    for s in range(sentences):
        nodes = [f"{rng.choice(words)}_{rng.choice(tags)}_{i}_0" for i in range(rng.randint(2, 7))]
        links = {(a, b): rng.choice(labels) for a in nodes for b in nodes if a != b and rng.random() < 0.3}
        if links:
            graphs[s] = G.parse("; ".join(f"{x}({a}, {b})" for (a, b), x in links.items()))
    edges = spark.createDataFrame([(s, e.src.start, e.dst.start, e.label) for s, g in graphs.items() for e in g.edges], "sent long, src int, dst int, label string")
    tokens = spark.createDataFrame([(s, n.start, n.postag, n.lemma) for s, g in graphs.items() for n in g.nodes], "sent long, node int, postag string, lemma string")
    return graphs, edges, tokens


def random_patterns(seed=4, n=120):
    rng = random.Random(seed)
    node = lambda alias: "{" + alias + rng.choice(["", "", ":postag=NN", ":postag=VB", ":regex=ship|port", ":postag=NN:regex=or.*"]) + "}"
    edge = lambda: rng.choice([">{}>", "<{}<"]).format(rng.choice(["nsubj", "dobj", "amod", "{x:regex=prep_(.*)}", "{y:regex=.*ob.*}", "{z:regex=nothing}", "absent"]))
    out = []
    for _ in range(n):
        parts = [node("arg1")]
        for alias in rng.choice([["rel", "arg2"], ["rel", "slot0", "arg2"], ["arg2"]]):
            parts += [edge(), node(alias)]
        out.append(parse_pattern(" ".join(parts)))
    return list(dict.fromkeys(out))


def found_by_walking(graphs, patterns, distinct=True):
    """Places of every match; captures aren't told apart, nor are parallel ways over the same nodes and labels."""
    return sorted({(s, str(p), tuple(m.nodes[n.alias].start for n in p.nodes), tuple(e.label for e in m.path)) for s, g in graphs.items() for p in patterns for m in find(p, g, distinct=distinct)})


@pytest.mark.parametrize("distinct", [True, False])
def test_the_tree_finds_what_walking_finds(spark, distinct):
    graphs, edges, tokens = random_corpus(spark)
    patterns = random_patterns()
    got = [(r.sent, r.pattern, tuple(r.nodes), tuple(r.labels)) for r in M.match(edges, [*patterns, *patterns[:5]], tokens, distinct).collect()]
    assert sorted(got) == found_by_walking(graphs, patterns, distinct) and len({x[1] for x in got}) > 20
    plain = [parse_pattern(str(p)) for p in patterns if all(n.postag is None and n.regex is None for n in p.nodes)]
    got = sorted((r.sent, r.pattern, tuple(r.nodes), tuple(r.labels)) for r in M.match(edges, plain, None, distinct).collect())
    assert got == found_by_walking(graphs, plain, distinct)


@pytest.mark.parametrize("distinct", [True, False])
def test_counted_matches(spark, monkeypatch, distinct):
    """Counts and least sentences are those of the matches, with and without tokens, by broadcast and by shuffles."""
    graphs, edges, tokens = random_corpus(spark)
    plain = [p for p in random_patterns() if all(n.postag is None and n.regex is None for n in p.nodes)]
    tagged = [p for p in random_patterns() if all(n.regex is None for n in p.nodes)]
    for patterns, known in ((random_patterns(), tokens), (tagged, tokens), (plain, None)):
        sents = {}
        for sent, pattern, *_ in found_by_walking(graphs, patterns, distinct):
            sents.setdefault(pattern, []).append(sent)
        got = {r.pattern: (r.n, r.first_sent) for r in M.match_counts(edges, [*patterns, *patterns[:5]], known, distinct).collect()}
        assert got == {p: (len(x), min(x)) for p, x in sents.items()} and got
        monkeypatch.setattr(M, "SENT_BYTES", 0)
    assert M.match_counts(edges, [], tokens).collect() == []


def test_a_path_is_one_row_however_many_patterns_want_it(spark):
    """Patterns that differ in tags, and in expressions for the same labels, share the rows of their paths."""
    edges = spark.createDataFrame([(1, "a", "b", "prep_of"), (1, "b", "c", "prep_in"), (None, "a", "b", "prep_of"), (2, None, "b", "prep_of")], "sent long, src string, dst string, label string")
    tokens = spark.createDataFrame([(1, n, "NN", n) for n in "abc"], "sent long, node string, postag string, lemma string")
    wants = ["prep_of", "prep_in", "{x:regex=prep_.*}", "{y:regex=.*_(of|in)}"]
    patterns = [parse_pattern(f"{{arg1}} >{a}> {{rel{tag}}} >{b}> {{arg2}}") for a in wants for b in wants for tag in ("", ":postag=NN", ":postag=VB")]
    [(paths, *_)] = M._paths(edges, M.Tree(patterns, True), tokens, True, True)
    assert paths.count() == 1 and M.match(edges, patterns, tokens).count() == 18


def test_tree_shuffled_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(M, "SENT_BYTES", 0)
    graphs, edges, tokens = random_corpus(spark, 8, 12)
    patterns = random_patterns(9, 60)
    got = sorted((r.sent, r.pattern, tuple(r.nodes), tuple(r.labels)) for r in M.match(edges, patterns, tokens).collect())
    assert got == found_by_walking(graphs, patterns)


def test_possible_patterns(spark):
    graphs, edges, _ = random_corpus(spark, 5)
    patterns = random_patterns(6)
    got = sorted((r.sent, r.pattern) for r in M.possible(edges, patterns).collect())
    assert got == sorted((s, str(p)) for s, g in graphs.items() for p in patterns if p.can_match({e.label for e in g.edges})) and got


def test_no_nested_loops_and_shared_prefixes(spark):
    _, edges, tokens = random_corpus(spark)
    patterns = random_patterns()
    for df in (M.match(edges, patterns, tokens), M.possible(edges, patterns), M.match(edges, [], tokens), M.possible(edges, [])):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    tree = M.Tree([parse_pattern(f"{{arg1}} <nsubj< {{rel}} >{x}> {{arg2}}") for x in ("dobj", "iobj", "prep_of")], True)
    assert len(tree.steps) == 4 and tree.depth == 2


def test_suggestions_by_stretches(spark):
    """Equal to all pairs, from far fewer candidates than all pairs of similar length."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzäöü "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))

    def changed(s):
        s = list(s)
        for _ in range(rng.randint(0, len(s) // 2)):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
        return "".join(s)

    own = [word(rng.randint(0, 24)) for _ in range(250)]
    gold = [word(rng.randint(0, 24)) for _ in range(250)] + [changed(s) for s in own if s for _ in range(2)]
    extractions = spark.createDataFrame([(s,) for s in [*own, *own[:9], None]], "extraction string")
    table = spark.createDataFrame([(s, True) for s in [*gold, None]], "extraction string, correct boolean")
    got = sorted(tuple(r) for r in V.suggest(extractions, table).collect())
    want = sorted((a, b, d) for a in set(own) for b in set(gold) if abs(len(a) - len(b)) < len(a) // 2 and (d := distance(a, b)) < len(a) // 2)
    assert got == want and len(want) > 250
    band = sum(abs(len(a) - len(b)) < len(a) // 2 for a in set(own) for b in set(gold))
    assert V.candidates(extractions, table).count() < band / 4
    # where all stretches are common, pairs of similar length are compared once each
    names = spark.createDataFrame([(f"Supplier#{i:09d}",) for i in range(60)], "extraction string")
    assert V.candidates(names, names).count() == 3600
    assert V.suggest(names.where("false"), table).count() == 0


def test_suggestions_of_common_stretches_take_many_tasks(spark, monkeypatch):
    """All pairs of names that share their stretches: each once, by many tasks, however few bytes the names have."""
    monkeypatch.setattr(V, "SIDE", 50, raising=False)
    names = spark.createDataFrame([(f"Supplier#{i:09d}",) for i in range(300)], "extraction string")
    found = V.suggest(names, names)
    assert found.count() == found.distinct().count() == 90_000  # three places differ at most
    assert found.select(F.spark_partition_id().alias("task")).distinct().count() > 8


def test_facts_of_one_row_group_take_many_tasks(spark, tmp_path):
    """Orders in one file of one row group are dealt to all cores before they are read as sentences."""
    spark.range(50).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    facts = Q.extracted(spark, str(tmp_path))
    assert facts.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert facts.select("o_orderkey").distinct().count() == 50


def test_bad_characters_without_lower_case(spark):
    """Capitals, vowels and digits of odd texts are counted as in lower case."""
    texts = ["", "a", "A", "aE", "x1", "12", "\u0130b", "\u0130\u0130", "\u0130", "ABCDEF", "ABCDE ae", "AaBbCcDdEeFf", "ab\nAcBCDEF", "x\ni\ny", "\u212b\u212a", "ÄÖÜäöü", "BCD\nFG\nHe1", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    old = (F.length(F.regexp_replace("t", "[^A-Z]", "")) > 5) | (F.length(F.regexp_replace(F.lower("t"), "[^aeiouy0-9]", "")) < 2)
    got = rows.select("t", old.alias("want"), _bad(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got] and {r.want for r in got} == {True, False, None}


def test_distances_of_blocks():
    """Equal to the table of each pair, for strings in any order, of any letters, and in more parts than one."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    for n in range(40):
        own, others = (["".join(rng.choice("ab \U0001d4b3é\0") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 25))] for _ in range(2))
        if n % 2:
            own, others = sorted(own), sorted(others)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(D, "CELLS", 1 << (24 if n % 3 else 6))
            assert D.distances(own, others).tolist() == [[distance(a, b) for b in others] for a in own]
    # what the beginnings share is computed once: a cell for each pair of distinct beginnings, not of letters of all pairs
    names = [f"Customer#{i:09d}" for i in range(1000)]
    assert len(D.Tree(names)) == 1 + 15 + 10 + 100 + 1000


def test_suggestions_of_common_stretches_of_any_length(spark, monkeypatch):
    """Long strings are compared one by one beside blocks of short ones; gold strings give probes in many tasks."""
    monkeypatch.setattr(V, "SIDE", 7)
    monkeypatch.setattr(V, "LONG", 20)
    texts = [f"{'é' * k}{i:03d}" for k in (3, 9, 15, 17, 18, 30) for i in range(12)]
    names = spark.createDataFrame([(t,) for t in texts], "extraction string")
    want = names.crossJoin(names.withColumnRenamed("extraction", "suggestion")).withColumn("distance", F.levenshtein("extraction", "suggestion")).where("distance < floor(length(extraction) / 2)")
    found = V.suggest(names, names)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > len(texts)
    assert any(len(r.extraction) > 20 for r in found.collect())
    kept = []
    monkeypatch.setattr(V, "keep", lambda df, name, f=V.keep: kept.append((name, df.rdd.getNumPartitions())) or f(df, name))
    V.suggest(names, names)
    assert dict(kept)["probes"] > 8  # one task before


def test_possible_patterns_are_counted_by_sets_of_labels(spark):
    """Counted without a row for each sentence and pattern; more wants than a number has bits."""
    rng = random.Random(5)
    rows = [(i % 40, f"a{rng.randrange(9)}", f"b{rng.randrange(9)}", f"l{rng.randrange(80)}") for i in range(600)]
    edges = spark.createDataFrame([*rows, (None, "a", "b", "l1"), (1, "a", "b", None)], "sent long, src string, dst string, label string")
    model = [parse_pattern(f"{{arg1}} <l{i}< {{rel}} >{x}> {{arg2}}") for i in range(80) for x in (f"l{(i * 7) % 80}", "{x:regex=l.*3}")]
    labels = {}
    for s, _, _, name in [*rows, (None, 0, 0, "l1")]:
        labels.setdefault(s, set()).add(name)
    has = lambda have, e: any(x == e.label if e.regex is None else x.endswith("3") for x in have)
    want = sorted(((s, str(p)) for s, have in labels.items() for p in model if all(has(have, e) for e in p.edges)), key=str)
    assert sorted((tuple(r) for r in M.possible(edges, model).collect()), key=str) == want and len(want) > 100
    counts = {}
    for _, p in want:
        counts[p] = counts.get(p, 0) + 1
    assert {r["pattern"]: r["n"] for r in M.possible_counts(edges, model).collect()} == counts


def test_pattern_components_read_their_rows_once(spark):
    """Labels and tags come from one pass over the patterns, which are dear to make."""
    from factloom.operators import collections as C

    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("{arg1} <nsubj< {rel:postag=VBZ} >dobj> {arg2}",)] * 3 + [("{arg1} >appos> {rel:postag=NN} >prep_of> {arg2}",), (None,)], "pattern string").mapInArrow(run, "pattern string")
    got = sorted(tuple(r) for r in C.pattern_components(rows).collect())
    assert got == [("edge", "appos", 1), ("edge", "dobj", 3), ("edge", "nsubj", 3), ("edge", "prep_of", 1), ("tag", "NN", 1), ("tag", "VBZ", 3)]
    assert seen.value == 5


def test_score_is_computed_once(spark):
    """The threshold's filter doesn't repeat the score below the columns."""
    rows = E.extract(spark.createDataFrame([(SENTENCES[0][1],)], "graph string"))
    scored = E.with_confidence(rows, threshold=0.1)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EXP(") == 1 and scored.count() == 1
    assert E.with_confidence(rows, threshold=0.9999).count() == 0
    # no threshold: the score is computed where it is read, and rows that have none leave
    unread = E.with_confidence(rows).select("pattern")
    assert "EXP(" not in unread._jdf.queryExecution().optimizedPlan().toString() and unread.count() == 1
    empty = E.extract(spark.createDataFrame([(SENTENCES[0][1],), (None,)], "graph string"), keep_empty=True)
    assert empty.count() == 2 and E.with_confidence(empty).count() == 1


def test_voice_switch_reads_graphs_once(spark):
    """Nulls and what can't be read give nothing, without a filter that reads every graph again."""
    good = "nsubj(ships_VBZ_1_0, Ann_NNP_0_0); dobj(ships_VBZ_1_0, crates_NNS_2_0)"
    out = E.switch_voices(spark.createDataFrame([(1, good), (2, None), (3, "no graph"), (4, good), (5, "")], "i int, graph string"))
    assert sorted(r["i"] for r in out.collect()) == [1, 4]
    assert "Filter" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_native_graph_codec(spark):
    df = spark.createDataFrame([(1, SPLIT), (2, "no graph")], "i int, g string").select("i", parse_graph("g").alias("p"))
    rows = {r.i: r.p for r in df.collect()}
    g = G.parse(SPLIT)
    assert rows[2] is None
    assert [(d.label, d.src, d.dst) for d in rows[1].deps] == sorted((e.label, e.src.start, e.dst.start) for e in g.edges)
    assert [(t.idx, t.text, t.postag) for t in rows[1].tokens] == [(n.start, n.text, n.postag) for n in g.nodes]


def test_templates(spark):
    rows = [("be elect president of", "{arg1} <nsubjpass< {rel} >prep_of> {arg2}")] * 6 + [("sit on", "{arg1} <nsubj< {rel} >prep_on> {arg2}")] * 5 + [("rare in", "{arg1} <nsubj< {rel} >prep_in> {arg2}")]
    out = {(r.template, r.pattern, r["count"]) for r in L.build_templates(spark.createDataFrame(rows, "rel string, pattern string")).collect()}
    assert out == {("be {rel} {prep}", "{arg1} <nsubjpass< {rel} >{prep:regex=prep_(.*)}> {arg2}", 6), ("{rel} {prep}", "{arg1} <nsubj< {rel} >{prep:regex=prep_(.*)}> {arg2}", 6)}
    built = L.build_patterns(spark.createDataFrame([("hold collection of", "wing", "amber", "wing hold collection amber", "t", MUSEUM), ("a", "b", "c", "d", "t", "no graph")], "rel string, arg1 string, arg2 string, lemmas string, text string, deps string"))
    assert [r.pattern for r in built.collect()] == ["{arg1} <nsubj< {rel0:postag=VBZ} >dobj> {rel1:postag=NN} >prep_of> {arg2}"]
    model = spark.createDataFrame([("{rel}", "{arg1} <nsubj< {rel:postag=VBD} >dobj> {arg2}"), ("be {rel} of", "{arg1} <nsubjpass< {rel} >prep_of> {arg2}"), ("be {rel}", "{arg1} <appos< {rel}")], "template string, pattern string")
    assert sorted((r.template, r.pattern) for r in L.voice_mirrors(model).collect()) == sorted([
        ("{rel}", "{arg1} <nsubj< {rel:postag=VBD} >dobj> {arg2}"), ("be {rel}", "{arg2} <nsubj< {rel:postag=VBD} >dobj> {arg1}"),
        ("be {rel} of", "{arg1} <nsubjpass< {rel} >prep_of> {arg2}"), ("{rel} of", "{arg2} <nsubjpass< {rel} >prep_of> {arg1}"), ("be {rel}", "{arg1} <appos< {rel}"),
    ])


def test_tables_and_dot(spark, tmp_path):
    (tmp_path / "scored.txt").write_text("1\t0.9\t(a; b; c)\tx\ty\n\t0.5\t(d; e; f)\nshort\n")
    rows = R.table(spark, str(tmp_path / "scored.txt"), "scored").collect()
    assert [(r.score, r.confidence, r.extra) for r in rows] == [(True, 0.9, ["x", "y"]), (None, 0.5, [])]
    (tmp_path / "model.txt").write_text("\n".join(X.SEED_MODEL))
    assert R.model_lines(spark, str(tmp_path / "model.txt")) == X.SEED_MODEL
    assert '"collection / NN", style=filled' in W.to_dot(G.parse(MUSEUM), {10}) and R.sniff_column(f"a\tb\t{MUSEUM}") == 2
    for bad in (["specific", "x"], ["what"], ["template"], []):
        with pytest.raises((ValueError, NotImplementedError)):
            X.read_model(bad)


def test_stream(spark, tmp_path):
    from factloom.streaming.stream import extract_stream

    spark.createDataFrame(SENTENCES, "sent long, graph string").write.parquet(f"{tmp_path}/in")
    stream = extract_stream(spark.readStream.schema("sent long, graph string").parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("facts").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("facts").count() == E.extract(spark.createDataFrame(SENTENCES, "sent long, graph string")).count() > 0


def test_command_line(spark, tmp_path):
    from factloom.__main__ import parser, run, validate

    (tmp_path / "in.txt").write_text("\n".join(f"{s}\t{raw}" for s, raw in SENTENCES) + "\nno graph\n")
    said = run(spark, parser().parse_args(["extract", str(tmp_path / "in.txt"), "--output", str(tmp_path / "out")]))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert said.startswith(f"{len(lines) - 1} extractions from 5 sentences") and W.TABBED_HEADER in lines
    (tmp_path / "scored.txt").write_text("1\t0.9\t(a; b; c)\tp\ts1\n0\t0.8\t(d; e; f)\tp\ts2\n1\t0.7\t(g; h; i)\tq\ts3\n")
    run(spark, parser().parse_args(["curve", str(tmp_path / "scored.txt"), "--output", str(tmp_path / "curve")]))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "curve")).collect()) == ["0.7\t2\t0.6666666666666666", "0.9\t1\t1.0"]
    run(spark, parser().parse_args(["rank", str(tmp_path / "scored.txt"), "--output", str(tmp_path / "rank")]))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "rank")).collect()) == ["p\t0.5\t2", "q\t1.0\t1"]
    assert validate(["{arg1} <nsubj< {rel} >dobj> {arg2}", "nonsense"]) == ["valid: {arg1} <nsubj< {rel} >dobj> {arg2}", "invalid: nonsense"]


def test_columns(spark):
    from factloom.functions import columns as K

    row = spark.sql("select named_struct('s', 1, 'e', 3) a, named_struct('s', 3, 'e', 5) b, array('the', 'Bible') w, array('DT', 'NNP') t")
    a, b = F.col("a"), F.col("b")
    got = row.select(K.borders(a, b).alias("x"), K.intersects(a, b).alias("y"), K.superset(K.union(a, b), b).alias("z"), K.distance(a, b).alias("d"), K.clean_argument(F.col("w"), F.col("t")).alias("c"), K.proper(F.col("t")).alias("p")).first()
    assert tuple(got) == (True, False, True, 0, "Bible", True)


def test_voices_and_feature_matrix(spark):
    df = spark.createDataFrame([(1, HIT), (2, WAS_HIT), (3, "no graph"), (4, None), (5, CORK)], "sent long, graph string")
    assert {(r.sent, r.graph) for r in E.switch_voices(df).collect()} == {(1, HIT_PASSIVE), (2, HIT_ACTIVE)}
    facts = E.with_confidence(E.extract(spark.createDataFrame(SENTENCES, "sent long, graph string")))
    matrix = E.feature_matrix(facts)
    assert matrix.count() == facts.count() and {"arg1 is proper", "confidence", "fact"} <= set(matrix.columns)


def test_learned_lemmas(spark):
    """Rules learned from half of the words give the teacher's lemmas for most of the others; arrays and joins agree."""
    from factloom.functions import lemmas as Z

    rng = random.Random(1)
    stems = ["".join(rng.choice(["b", "tr", "l", "sk", "m", "n", "p"]) + rng.choice("aeiou") for _ in range(rng.randint(2, 3))) + rng.choice("tkmnd") for _ in range(700)]
    forms = sorted({s + e for s in stems for e in ("", "s", "ed", "ing", "ies", "ches")} | {"was", "were", "men", "é", "x"})
    rng.shuffle(forms)
    taught, rest = forms[::2], forms[1::2]
    pairs = [(w, G.lemma(w)) for w in taught] + [(None, "x"), ("two words", "two word"), ("", "")]
    rules = Z.learn(spark.createDataFrame([*pairs, *pairs[:40]], "form string, lemma string"))
    table = [(r.suffix, r.strip, r.put) for r in rules.collect()]
    of = Z.Lemmas(table)
    assert of([w.upper() for w in taught]) == [G.lemma(w) for w in taught]
    right = sum(a == G.lemma(w) for a, w in zip(of(rest), rest, strict=True)) / len(rest)
    assert right > 0.97, right
    asked = [*forms, "Zzz", "unseen"]
    got = {r.word: r.lemma for r in Z.lemmatize(spark.createDataFrame([(w,) for w in [*asked, None]], "word string"), rules).collect()}
    assert got.pop(None) is None and got == dict(zip(asked, of(asked), strict=True)) and of([]) == []
    assert Z.learn(spark.createDataFrame([], "form string, lemma string")).collect() == []
    plain = E.extract(spark.createDataFrame(SENTENCES, "sent long, graph string"), lemmas=[("^floods", 1, "!")]).where("sent = 1").first()
    assert [t.lemma for t in plain.tokens if t.text in ("floods", "meadows")] == ["flood!", "meadows"]


def test_feature_values_are_read_once_by_all_cores(spark, tmp_path):
    """Words are found once in a text, on more tasks than its file has row groups; texts of twelve words and more count."""
    from factloom.plans.engine import feature_values

    twelve = "Ab3 ? c d e f g h i j k l"
    texts = [None, "", "b c d e f g h i j k l", twelve, "\n¡é-- " + twelve + " --é", "é".join("abcdefghijkl"), "x" * 5000 + "..", "é" * 5000, "a-b\n" * 6, "a-b\n" * 5 + "a-"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = feature_values(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {k for k, t in enumerate(texts) if len(re.findall(r"[A-Za-z0-9?]+", t or "")) >= 12}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_features_of_counted_and_other_tokens(spark):
    """What is read at a known place is what a look at all tokens finds, also where places are missing, repeated or out of range."""
    from factloom.functions.features import counted, further_features, shared

    rng = random.Random(2)
    words, marks = ["can", "Could", "be ", "If", "of", "xyz", "?", "can would"], ["VB", "VBZ", ",", "NNP", "IN", "TO", "PRP", ".", "W\n,\nVB"]
    part = lambda: (" ".join(rng.choices(words, k=rng.randrange(4))), rng.choice([None, *range(-1, 9)]), rng.choice([None, *range(9)]), [rng.randrange(9) for _ in range(rng.randrange(4))])
    places = lambda n: rng.choice([range(n), range(n), sorted(rng.sample(range(n + 3), n)), sorted(rng.choices(range(n + 1), k=n))])
    rows = [(k, part(), part(), part(), [(i, rng.choice(words), rng.choice(marks)) for i in places(rng.randrange(9))]) for k in range(300)]
    kind = "struct<text:string,s:int,e:int,idx:array<int>>"
    df = spark.createDataFrame(rows, f"k int, arg1 {kind}, rel {kind}, arg2 {kind}, tokens array<struct<idx:int,text:string,postag:string>>")
    df = df.selectExpr("*", "0.5D pattern_confidence", "array('nn') pattern_labels", "true semantic", "false prep_mismatch", "array(named_struct('label', 'appos', 'src', 1, 'dst', 4)) deps")
    assert 0 < df.where(counted()).count() < len(rows)
    values = lambda known: {r[0]: tuple(r)[1:] for r in df.select("k", *[c.alias(f"f{i}") for i, c in enumerate((features(known) | further_features()).values())]).collect()}
    got, names = values(None), list(features() | further_features())
    assert got == values(shared(F.lit(False)))
    for k, a1, r, a2, tokens in rows:  # some in plain Python
        own, pairs = dict(zip(names, got[k], strict=True)), list(zip([",", *[t[2] for t in tokens]], [t[2] for t in tokens], strict=False))
        left, behind = [t for t in tokens if a1[1] is not None and t[0] < a1[1]], [t for t in tokens if a2[2] is not None and t[0] >= a2[2]]
        assert own["prep right before arg1"] == (bool(left) and left[-1][2] in ("IN", "TO")) and own["prep right after arg2"] == (bool(behind) and behind[0][2] in ("IN", "TO"))
        assert own["sentence ends with arg2"] == all(t[2] in (".", "?") for t in behind)
        assert not tokens or own["sentence is imperative"] == any(p == "," and t.startswith("VB") for p, t in pairs)
        assert own["hyp words in rel"] == bool(({t[1].lower() for t in tokens} & {"can", "would", "could", "might"}) - set(r[0].lower().split(" ")))
