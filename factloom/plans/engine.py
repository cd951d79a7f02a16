"""Queries of the extraction engine over sentences made from the orders, and their SQL.

Every order gives a parsed sentence of one of ten forms, with its own names in it, so all sentences differ:

0. ``Cust7 ships a big order12 .``                    (subject, verb, object)
1. ``order12 was sent by Cust7``                      (passive with agent)
2. ``Clerk3 says that order12 is the gift of Cust7``  (predicate noun, attributed)
3. ``Cust7 travels with Clerk3 to Port5``             (two prepositions)
4. ``If Port5 opens early , Cust7 and Clerk3 load three heavy crates .``  (condition, joined subjects, plural)
5. ``Clerk3 sent Cust7 crates that leak``             (indirect object, relative clause)
6. ``Clerk3 can repair two old cranes of Port5 with Cust7``  (modal, prepositions as tokens)
7. ``order12 rarely seen in Port5``                   (participle without an auxiliary)
8. ``order12 can soon be taken by Cust7``             (passive behind a modal)
9. ``Cust7 , owner of a ship built in Port5 , wants to sell order12 .``  (apposition, participle clause, open complement)
"""

from __future__ import annotations

import re
from string import ascii_letters, digits

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import graph as G
from ..functions import native as N
from ..functions.columns import connections
from ..functions.features import DEFAULT_WEIGHTS, VACUOUS, features, further_features, measured
from ..functions.store import scratch_path
from ..operators import collections as C
from ..operators import extract as E
from ..operators import learn as L
from ..sources import readers as R
from ..sources import writers as W
from .queries import query, read

#: The forms: %c customer, %o order, %k clerk, %p priority.
FORMS = (
    "(._._5_0), nsubj(ships_VBZ_1_0, Cust%c_NNP_0_0); dobj(ships_VBZ_1_0, order%o_NN_4_0); det(order%o_NN_4_0, a_DT_2_0); amod(order%o_NN_4_0, big_JJ_3_0)",
    "(by_IN_3_0), nsubjpass(sent_VBN_2_0, order%o_NN_0_0); auxpass(sent_VBN_2_0, was_VBD_1_0); agent(sent_VBN_2_0, Cust%c_NNP_4_0)",
    "(that_IN_2_0), (of_IN_7_0), nsubj(says_VBZ_1_0, Clerk%k_NNP_0_0); ccomp(says_VBZ_1_0, gift_NN_6_0); nsubj(gift_NN_6_0, order%o_NN_3_0); cop(gift_NN_6_0, is_VBZ_4_0); det(gift_NN_6_0, the_DT_5_0); prep_of(gift_NN_6_0, Cust%c_NNP_8_0)",
    "(with_IN_2_0), (to_TO_4_0), nsubj(travels_VBZ_1_0, Cust%c_NNP_0_0); prep_with(travels_VBZ_1_0, Clerk%k_NNP_3_0); prep_to(travels_VBZ_1_0, Port%p_NNP_5_0)",
    "(,_,_4_0), (._._12_0), advcl(load_VBP_8_0, opens_VBZ_2_0); mark(opens_VBZ_2_0, If_IN_0_0); nsubj(opens_VBZ_2_0, Port%p_NNP_1_0); advmod(opens_VBZ_2_0, early_RB_3_0); nsubj(load_VBP_8_0, Cust%c_NNP_5_0); cc(Cust%c_NNP_5_0, and_CC_6_0); conj_and(Cust%c_NNP_5_0, Clerk%k_NNP_7_0); dobj(load_VBP_8_0, crates_NNS_11_0); num(crates_NNS_11_0, three_CD_9_0); amod(crates_NNS_11_0, heavy_JJ_10_0)",
    "nsubj(sent_VBD_1_0, Clerk%k_NNP_0_0); iobj(sent_VBD_1_0, Cust%c_NNP_2_0); dobj(sent_VBD_1_0, crates_NNS_3_0); rcmod(crates_NNS_3_0, leak_VBP_5_0); nsubj(leak_VBP_5_0, that_WDT_4_0)",
    "nsubj(repair_VB_2_0, Clerk%k_NNP_0_0); aux(repair_VB_2_0, can_MD_1_0); dobj(repair_VB_2_0, cranes_NNS_5_0); num(cranes_NNS_5_0, two_CD_3_0); amod(cranes_NNS_5_0, old_JJ_4_0); prep(cranes_NNS_5_0, of_IN_6_0); pobj(of_IN_6_0, Port%p_NNP_7_0); prep(repair_VB_2_0, with_IN_8_0); pobj(with_IN_8_0, Cust%c_NNP_9_0)",
    "(in_IN_3_0), nsubjpass(seen_VBN_2_0, order%o_NN_0_0); advmod(seen_VBN_2_0, rarely_RB_1_0); prep_in(seen_VBN_2_0, Port%p_NNP_4_0)",
    "(by_IN_5_0), nsubjpass(taken_VBN_4_0, order%o_NN_0_0); aux(taken_VBN_4_0, can_MD_1_0); advmod(taken_VBN_4_0, soon_RB_2_0); auxpass(taken_VBN_4_0, be_VB_3_0); agent(taken_VBN_4_0, Cust%c_NNP_6_0)",
    "(,_,_1_0), (of_IN_3_0), (in_IN_7_0), (,_,_9_0), (._._14_0), appos(Cust%c_NNP_0_0, owner_NN_2_0); prep_of(owner_NN_2_0, ship_NN_5_0); det(ship_NN_5_0, a_DT_4_0); partmod(ship_NN_5_0, built_VBN_6_0); prep_in(built_VBN_6_0, Port%p_NNP_8_0); nsubj(wants_VBZ_10_0, Cust%c_NNP_0_0); xcomp(wants_VBZ_10_0, sell_VB_12_0); aux(sell_VB_12_0, to_TO_11_0); dobj(sell_VB_12_0, order%o_NN_13_0)",
)
N_FORMS = len(FORMS)
NAMES = {"%c": "o_custkey", "%o": "o_orderkey", "%k": "o_orderkey % 97", "%p": "o_custkey % 7"}


def sentences(spark: SparkSession, sf_dir: str, *more: str, spread: bool = False) -> DataFrame:
    """o_orderkey, form, graph and further columns of the orders. ``spread``: dealt evenly to all cores while rows are still
    short, for long work on each; a scan has no more tasks than its files have row groups."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if spread:
        rows = rows.repartition(3 * spark.sparkContext.defaultParallelism, "o_orderkey")
    rows = rows.withColumn("form", F.pmod("o_orderkey", F.lit(N_FORMS)).cast("int"))
    graph = F.get(F.array(*map(F.lit, FORMS)), "form")
    for mark, value in NAMES.items():
        graph = F.replace(graph, F.lit(mark), F.expr(f"cast({value} as string)"))
    return rows.select("o_orderkey", "form", graph.alias("graph"), *more)


def sql_form(texts: tuple[str, ...]) -> str:
    """The texts by form, with names filled in."""
    whole = f"CASE o_orderkey % {N_FORMS} " + " ".join(f"WHEN {i} THEN '" + t.replace("'", "''") + "'" for i, t in enumerate(texts)) + " END"
    for mark, value in NAMES.items():
        whole = f"replace({whole}, '{mark}', ({value})::VARCHAR)"
    return whole


TEXTS = ("Cust%c ships a big order%o .", "order%o was sent by Cust%c", "Clerk%k says that order%o is the gift of Cust%c", "Cust%c travels with Clerk%k to Port%p",
         "If Port%p opens early , Cust%c and Clerk%k load three heavy crates .", "Clerk%k sent Cust%c crates that leak", "Clerk%k can repair two old cranes of Port%p with Cust%c", "order%o rarely seen in Port%p",
         "order%o can soon be taken by Cust%c", "Cust%c , owner of a ship built in Port%p , wants to sell order%o .")
#: What the seed model finds: (form, arg1, rel, arg2, notes, confidence of the pattern, pattern, template).
FOUND = (
    (0, "Cust%c", "ships", "a big order%o", "", 1.0, "{arg1} <nsubj< {rel:postag=VBZ} >dobj> {arg2}", "{rel}"),
    (1, "order%o", "was sent by", "Cust%c", "", 0.8, "{arg1} <nsubjpass< {rel:postag=VBN} >agent> {arg2}", "be {rel} by"),
    (2, "order%o", "is the gift of", "Cust%c", "[attrib=Clerk%k says]", 0.75, "{arg1} <nsubj< {rel:postag=NN} >{prep:regex=prep_(.*)}> {arg2}", "be {rel} {prep}"),
    (3, "Cust%c", "travels with", "Clerk%k", "", 0.83, "{arg1} <nsubj< {rel:postag=VBZ} >{prep:regex=prep_(.*)}> {arg2}", "{rel} {prep}"),
    (3, "Cust%c", "travels to", "Port%p", "", 0.83, "{arg1} <nsubj< {rel:postag=VBZ} >{prep:regex=prep_(.*)}> {arg2}", "{rel} {prep}"),
    (4, "Cust%c and Clerk%k", "load", "three heavy crates", "[enabler=If Port%p opens early]", 0.98, "{arg1} <nsubj< {rel:postag=VBP} >dobj> {arg2}", "{rel}"),
    (5, "Clerk%k", "sent Cust%c", "crates that leak", "", 1.0, "{arg1} <nsubj< {rel:postag=VBD} >dobj> {arg2}", "{rel}"),
    (6, "Clerk%k", "can repair", "two old cranes of Port%p", "", 0.9, "{arg1} <nsubj< {rel:postag=VB} >dobj> {arg2}", "{rel}"),
    (7, "order%o", "be rarely seen in", "Port%p", "", 0.8, "{arg1} <nsubjpass< {rel:postag=VBN} >{prep:regex=prep_(.*)}> {arg2}", "be {rel} {prep}"),
    (8, "order%o", "can soon be taken by", "Cust%c", "", 0.8, "{arg1} <nsubjpass< {rel:postag=VBN} >agent> {arg2}", "be {rel} by"),
    (9, "Cust%c", "be owner of", "a ship built in Port%p", "", 0.7, "{arg1} >appos> {rel:postag=NN} >{prep:regex=prep_(.*)}> {arg2}", "be {rel} {prep}"),
    (9, "Cust%c", "wants to sell", "order%o", "", 0.6, "{arg1} <nsubj< {rel1} >xcomp> {rel2} >dobj> {arg2}", "{rel}"),
)


def _named(text: str) -> str:
    out = "'" + text.replace("'", "''") + "'"
    for mark, value in NAMES.items():
        if mark in text:
            out = f"replace({out}, '{mark}', ({value})::VARCHAR)"
    return out


FOUND_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey, {_named(a)} AS a1, {_named(r)} AS r, {_named(b)} AS a2, {_named(note)} AS note, {conf}::DOUBLE AS pattern_confidence, '{p}' AS pattern, '{t}' AS template, {_named(TEXTS[form])} AS text, {_named(FORMS[form])} AS graph FROM orders WHERE o_orderkey % {N_FORMS} = {form}"
    for form, a, r, b, note, conf, p, t in FOUND
)
FACTS_SQL = f"f AS ({FOUND_SQL})"
#: The sum of weights of the features that each found fact has, by form; the text of an order's fact has one form.
CONFIDENCE_SQL = "CASE " + " ".join(
    f"WHEN o_orderkey % {N_FORMS} = {form} AND r LIKE '{re.sub("%[ckop]", "%", r)}' THEN {{{i}}}" for i, (form, _, r, *_) in enumerate(FOUND)
) + " END"
TRUE_FEATURES = (
    ("rel is contiguous", "rel contains verb", "arg1 is proper", "sentence starts with extraction", "sentence begins with arg1", "sentence ends with arg2", "rel bad characters", "prep mismatch in pattern"),
    ("rel is contiguous", "rel contains verb", "arg2 is proper", "sentence starts with extraction", "sentence begins with arg1", "sentence ends with arg2"),
    ("rel is contiguous", "rel contains verb", "arg2 is proper", "sentence ends with arg2", "prep right before arg1", "rel ends with of"),
    ("rel is contiguous", "rel contains verb", "arg1 is proper", "arg2 is proper", "sentence starts with extraction", "sentence begins with arg1", "prep right after arg2"),
    ("rel contains verb", "arg1 is proper", "arg2 is proper", "sentence starts with extraction", "sentence begins with arg1", "sentence ends with arg2"),
    ("rel is contiguous", "rel contains verb", "sentence ends with arg2", "prep mismatch in pattern"),
    ("rel is contiguous", "rel contains verb", "arg1 is proper", "sentence starts with extraction", "sentence begins with arg1", "sentence ends with arg2", "prep mismatch in pattern"),
    ("rel is contiguous", "rel contains verb", "arg1 is proper", "sentence starts with extraction", "sentence begins with arg1", "prep right after arg2", "prep in arg2", "prep mismatch in pattern"),
    ("rel contains verb", "arg2 is proper", "sentence starts with extraction", "sentence begins with arg1", "sentence ends with arg2"),
    ("rel is contiguous", "rel contains verb", "arg2 is proper", "sentence starts with extraction", "sentence begins with arg1", "sentence ends with arg2"),
    ("arg1 is proper", "sentence starts with extraction", "sentence begins with arg1", "rel ends with of", "arg1 borders appositive", "prep in arg2", "noun-verb-noun in arg2", "sentence is imperative"),
    ("rel is contiguous", "rel contains verb", "arg1 is proper", "sentence starts with extraction", "sentence begins with arg1", "sentence ends with arg2", "arg1 borders appositive", "sentence is imperative", "prep mismatch in pattern"),
)


def _log_odds(i: int) -> float:
    w = DEFAULT_WEIGHTS
    return w["Intercept"] + w["pattern confidence"] * FOUND[i][5] + sum(w[n] for n in TRUE_FEATURES[i])


_ODDS_SQL = CONFIDENCE_SQL.format(*[repr(_log_odds(i)) for i in range(len(FOUND))])


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored facts of all sentences, dealt to all cores, with the sentence's text; it is made of the tokens that the engine has read."""
    found = E.with_confidence(E.extract(sentences(spark, sf_dir, spread=True)))
    return found.withColumn("text", F.array_join(F.transform("tokens", lambda t: t["text"]), " "))


#: The labels of each form, in order.
LABELS = (
    "amod det dobj nsubj", "agent auxpass nsubjpass", "ccomp cop det nsubj nsubj prep_of", "nsubj prep_to prep_with", "advcl advmod amod cc conj_and dobj mark nsubj nsubj num", "dobj iobj nsubj nsubj rcmod",
    "amod aux dobj nsubj num pobj pobj prep prep", "advmod nsubjpass prep_in", "advmod agent aux auxpass nsubjpass", "appos aux det dobj nsubj partmod prep_in prep_of xcomp",
)


@query("graph_parse", f"""SELECT o_orderkey, {sql_form(TEXTS)} AS text,
 CASE o_orderkey % {N_FORMS} {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LABELS))} END AS labels FROM orders""")
def graph_parse(spark, sf_dir):
    """Graph strings read natively: the text of their tokens in order, and their labels."""
    p = sentences(spark, sf_dir).withColumn("g", N.parse_graph("graph"))
    words = lambda c, f: F.array_join(F.array_sort(F.transform(c, lambda x: x["label"])) if f else F.transform(c, lambda x: x["text"]), " ")
    return p.select("o_orderkey", words(F.col("g.tokens"), False).alias("text"), words(F.col("g.deps"), True).alias("labels"))


def _dots() -> tuple[str, ...]:
    """The DOT text of each form, from the plain version; the argument of its names stands open."""
    return tuple(W.to_dot(G.parse(form), {1}) for form in FORMS)


@query("graph_dot", f"SELECT o_orderkey, {sql_form(_dots())} AS dot FROM orders")
def graph_dot(spark, sf_dir):
    """Graphs as DOT text, the second token filled."""
    p = sentences(spark, sf_dir).withColumn("g", N.parse_graph("graph"))
    return p.select("o_orderkey", W.dot(F.col("g.tokens"), F.col("g.deps"), F.array(F.lit(1))).alias("dot"))


@query("extract_sentences", f"WITH {FACTS_SQL} SELECT o_orderkey, '(' || a1 || '; ' || r || '; ' || a2 || ')' || note AS fact, pattern_confidence, pattern FROM f")
def extract_sentences(spark, sf_dir):
    """The engine end to end: graphs, normal forms, matching, expansion, templates, attribution, duplicates."""
    return extracted(spark, sf_dir).select("o_orderkey", E.fact_text().alias("fact"), "pattern_confidence", "pattern")


@query("fact_confidence", f"WITH {FACTS_SQL} SELECT o_orderkey, r AS rel, round(1 / (1 + exp(-({_ODDS_SQL}))), 9) AS confidence FROM f")
def fact_confidence(spark, sf_dir):
    return extracted(spark, sf_dir).select("o_orderkey", F.col("rel.text").alias("rel"), F.round("confidence", 9).alias("confidence"))


_NUMBER_SQL = f"regexp_replace(regexp_replace(printf('%.3f', 1 / (1 + exp(-({_ODDS_SQL})))), '0+$', ''), '\\.$', '')"
_WHEN_SQL = "CASE WHEN note LIKE '[enabler=%' THEN 'Some(' || note[10:-2] || ')' ELSE 'None' END"
_SAID_SQL = "CASE WHEN note LIKE '[attrib=%' THEN 'Some(' || note[9:-2] || ')' ELSE 'None' END"
_FACT_SQL = "'(' || a1 || '; ' || r || '; ' || a2 || ')' || note"


def _format_sql(*fields: str) -> str:
    return f"WITH {FACTS_SQL} SELECT o_orderkey, " + " || chr(9) || ".join(fields) + " AS line FROM f"


@query("output_tabbed", _format_sql(_NUMBER_SQL, "a1", "r", "a2", _WHEN_SQL, _SAID_SQL, "text", "pattern", "graph"))
def output_tabbed(spark, sf_dir):
    return _lines(extracted(spark, sf_dir), W.tabbed)


@query("output_tabbed_single", _format_sql(_NUMBER_SQL, _FACT_SQL, _WHEN_SQL, _SAID_SQL, "text", "pattern", "graph"))
def output_tabbed_single(spark, sf_dir):
    return _lines(extracted(spark, sf_dir), W.tabbed_single)


@query("output_patterns", _format_sql("printf('%.6f', pattern_confidence)", _FACT_SQL, "pattern", "text", "graph"))
def output_patterns(spark, sf_dir):
    return _lines(extracted(spark, sf_dir), W.pattern_lines)


@query("output_interactive", f"""WITH {FACTS_SQL}, l AS (SELECT o_orderkey, {_NUMBER_SQL} || ': ' || {_FACT_SQL} AS line, {_ODDS_SQL} AS c, text FROM f)
 SELECT o_orderkey, text || chr(10) || string_agg(line, chr(10) ORDER BY c DESC, line) AS line FROM l GROUP BY o_orderkey, text""")
def output_interactive(spark, sf_dir):
    return W.dialogue(extracted(spark, sf_dir), "text", ["o_orderkey"])


@query("fact_order", f"WITH {FACTS_SQL} SELECT o_orderkey, r AS rel, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY {_ODDS_SQL} DESC, {_FACT_SQL}) AS INTEGER) AS place FROM f")
def fact_order(spark, sf_dir):
    return E.in_order(extracted(spark, sf_dir), ["o_orderkey"]).select("o_orderkey", F.col("rel.text").alias("rel"), "place")


@query("fact_hooks", f"WITH {FACTS_SQL} SELECT o_orderkey, upper(r) AS rel FROM f WHERE a1 LIKE 'Cust%'")
def fact_hooks(spark, sf_dir):
    """A function that changes facts and one that tells which stay."""
    found = E.extract(sentences(spark, sf_dir), build=lambda f: f.withField("rel.text", F.upper(f["rel"]["text"])), valid=lambda f: f["arg1"]["text"].startswith("Cust"))
    return found.select("o_orderkey", F.col("rel.text").alias("rel"))


@query("part_connections", "SELECT o_orderkey, unnest(CASE o_orderkey % 10 WHEN 0 THEN ['dobj'] WHEN 1 THEN ['agent'] WHEN 2 THEN ['prep_of'] WHEN 3 THEN ['prep_with', 'prep_to'] WHEN 7 THEN ['prep_in'] WHEN 8 THEN ['agent'] WHEN 9 THEN ['prep_of', 'dobj'] ELSE ['dobj'] END) AS label FROM orders")
def part_connections(spark, sf_dir):
    """The edges between the relation and the second argument."""
    found = E.extract(sentences(spark, sf_dir))
    return found.select("o_orderkey", F.explode(connections(F.col("deps"), F.col("rel.idx"), F.col("arg2.idx"))).alias("d")).select("o_orderkey", "d.label")


def _lines(df: DataFrame, form) -> DataFrame:
    """The lines of a format beside the order they come from: the key rides through as a field of its own line."""
    marked = form(df.withColumn("graph", F.concat("graph", F.lit("\x02"), F.col("o_orderkey").cast("string"))))
    parts = F.split("line", "\x02", -1)
    return marked.select(F.get(parts, F.lit(1)).cast("long").alias("o_orderkey"), F.get(parts, F.lit(0)).alias("line"))


@query("labelled_round_trip", f"""WITH {FACTS_SQL} SELECT graph, o_orderkey % 3 = 0 AS score, a1, r, a2, template, pattern, round(pattern_confidence, 5) AS conf,
 CASE WHEN note LIKE '[attrib=%' THEN note[9:-2] END AS said, CASE WHEN note LIKE '[enabler=%' THEN note[10:-2] END AS enabler FROM f""")
def labelled_round_trip(spark, sf_dir):
    """Labelled instances written as lines and read back."""
    rows = W.labelled(extracted(spark, sf_dir).withColumn("score", F.col("o_orderkey") % 3 == 0))
    back = R.parse_instances(rows)
    said = F.when(F.col("attrib_arg").isNotNull(), F.concat_ws(" ", "attrib_arg", "attrib_rel"))
    return back.select("graph", "score", F.col("arg1.text").alias("a1"), F.col("rel.text").alias("r"), F.col("arg2.text").alias("a2"), "template", "pattern", F.col("pattern_confidence").alias("conf"), said.alias("said"), "enabler")


@query("voice_switch", f"""SELECT o_orderkey, 'det(order' || o_orderkey || '_NN_1_2, a_DT_0_0); auxpass(ships_VBZ_2_' || (7 + l + 4) || ', was_VBD_1_' || (7 + l + 0) || '); nsubjpass(ships_VBZ_2_' || (7 + l + 4) || ', order' || o_orderkey || '_NN_1_2); prep(ships_VBZ_2_' || (7 + l + 4) || ', by_IN_3_' || (7 + l + 10) || '); pobj(by_IN_3_' || (7 + l + 10) || ', Cust' || o_custkey || '_NNP_4_' || (7 + l + 13) || ')' AS graph
 FROM (SELECT o_orderkey, o_custkey, len(o_orderkey::VARCHAR) + 1 AS l FROM orders)""")
def voice_switch(spark, sf_dir):
    """Clauses turned into the passive, places and offsets renewed."""
    c, o = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    graph = F.concat(F.lit("nsubj(ships_VBZ_1_0, Cust"), c, F.lit("_NNP_0_0); dobj(ships_VBZ_1_0, order"), o, F.lit("_NN_3_0); det(order"), o, F.lit("_NN_3_0, a_DT_2_0)"))
    return E.switch_voices(read(spark, sf_dir, "orders").select("o_orderkey", graph.alias("graph")))


@query("voice_switch_active", """SELECT o_orderkey, 'nsubj(sent_VBN_1_' || x || ', Cust' || c || '_NNP_0_0); dobj(sent_VBN_1_' || x || ', order' || o_orderkey || '_NN_3_' || (x + 9) || '); det(order' || o_orderkey || '_NN_3_' || (x + 9) || ', the_DT_2_' || (x + 5) || ')' AS graph
 FROM (SELECT o_orderkey, o_custkey AS c, len(o_custkey::VARCHAR) + 5 AS x FROM orders)""")
def voice_switch_active(spark, sf_dir):
    """Clauses turned into the active: the auxiliary and ``by`` go, the agent comes to the front."""
    c, o = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    graph = F.concat(F.lit("det(order"), o, F.lit("_NN_1_4, the_DT_0_0); nsubjpass(sent_VBN_3_20, order"), o, F.lit("_NN_1_4); auxpass(sent_VBN_3_20, was_VBD_2_16); prep(sent_VBN_3_20, by_IN_4_25); pobj(by_IN_4_25, Cust"), c, F.lit("_NNP_5_28)"))
    return E.switch_voices(read(spark, sf_dir, "orders").select("o_orderkey", graph.alias("graph")))


#: Facts known of a form: relation, arguments, all lemmas, and the pattern that expresses them.
KNOWN = (
    (0, "ship", "cust%c", "order%o", "cust%c ship order%o", "{arg1} <nsubj< {rel:postag=VBZ} >dobj> {arg2}"),
    (1, "send", "order%o", "cust%c", "order%o send cust%c", "{arg1} <nsubjpass< {rel:postag=VBN} >agent> {arg2}"),
    (2, "be gift of", "order%o", "cust%c", "order%o gift cust%c", "{arg1} <nsubj< {rel:postag=NN} >prep_of> {arg2}"),
    (3, "travel", "cust%c", "clerk%k", "cust%c travel clerk%k", "{arg1} <nsubj< {rel:postag=VBZ} >prep_with> {arg2}"),
    (4, "load", "clerk%k", "crate", "clerk%k cust%c load crate", "{arg1} <conj_and< {slot0:postag=NNP} <nsubj< {rel:postag=VBP} >dobj> {arg2}"),
    (6, "repair crane of", "clerk%k", "port%p", "clerk%k repair crane port%p", "{arg1} <nsubj< {rel0:postag=VB} >dobj> {rel1:postag=NN} >prep_of> {arg2}"),
    (8, "take", "order%o", "cust%c", "order%o take cust%c", "{arg1} <nsubjpass< {rel:postag=VBN} >agent> {arg2}"),
    (9, "sell", "cust%c", "order%o", "cust%c want sell order%o", "{arg1} <nsubj< {slot0:postag=VBZ} >xcomp> {rel:postag=VB} >dobj> {arg2}"),
)


@query("induce_patterns", " UNION ALL ".join(f"SELECT o_orderkey, '{k[5]}' AS pattern FROM orders WHERE o_orderkey % {N_FORMS} = {k[0]}" for k in KNOWN if not k[5].startswith("{arg1} <conj")))
def induce_patterns(spark, sf_dir):
    """From sentences that hold a known fact to the paths that express it; a path over a conjunction isn't valid."""
    return known_patterns(spark, sf_dir)


def known_patterns(spark: SparkSession, sf_dir: str, longest: int | None = None) -> DataFrame:
    """o_orderkey, pattern: of the facts that are known."""
    rows = sentences(spark, sf_dir, "o_custkey", spread=True)

    def named(i: int) -> Column:
        text = F.create_map(*[F.lit(x) for k in KNOWN for x in (k[0], k[i])])[F.col("form")]
        for mark, value in NAMES.items():
            text = F.replace(text, F.lit(mark), F.expr(f"cast({value} as string)"))
        return text

    facts = rows.where(F.col("form").isin([k[0] for k in KNOWN]))
    built = L.build_patterns(facts.select(*[named(i).alias(c) for i, c in enumerate(("rel", "arg1", "arg2", "lemmas"), 1)], F.col("o_orderkey").cast("string").alias("text"), F.col("graph").alias("deps")), longest)
    return built.select(F.col("text").cast("long").alias("o_orderkey"), "pattern")


#: Graphs with names to join and compound nouns: what an argument's words stand for, and the pattern.
NAMED_GRAPHS = (
    ("(of_IN_1_0), nsubj(built_VBD_3_0, Bank_NNP_0_0); prep_of(Bank_NNP_0_0, Port%p_NNP_2_0); dobj(built_VBD_3_0, yard_NN_5_0); nn(yard_NN_5_0, ship%o_NN_4_0)", "bank of port%p", "ship%o yard", "build", "{arg1} <nsubj< {rel:postag=VBD} >dobj> {arg2}"),
    ("nn(Cust%c_NNP_1_0, Captain_NNP_0_0); nsubj(owner_NN_4_0, Cust%c_NNP_1_0); cop(owner_NN_4_0, is_VBZ_2_0); amod(owner_NN_4_0, sole_JJ_3_0); prep(owner_NN_4_0, of_IN_5_0); pobj(of_IN_5_0, order%o_NNS_6_0)", "captain cust%c", "order%o", "owner", "{arg1} <nsubj< {rel:postag=NN} >prep_of> {arg2}"),
)


@query("induce_names", " UNION ALL ".join(f"SELECT o_orderkey, '{x[4]}' AS pattern FROM orders WHERE o_orderkey % 2 = {i}" for i, x in enumerate(NAMED_GRAPHS)))
def induce_names(spark, sf_dir):
    """Induction where an argument is several tokens made one: names joined by of, compound nouns, prepositions as tokens."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.get(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("deps", "arg1", "arg2", "rel"), x, strict=False)]) for x in NAMED_GRAPHS]), (F.col("o_orderkey") % 2).cast("int")).alias("x")).select("o_orderkey", "o_custkey", "x.*")
    for mark, value in NAMES.items():
        rows = rows.withColumns({c: F.replace(c, F.lit(mark), F.expr(f"cast({value} as string)")) for c in ("deps", "arg1", "arg2")})
    built = L.build_patterns(rows.select("rel", "arg1", "arg2", F.concat_ws(" ", "arg1", "rel", "arg2").alias("lemmas"), F.col("o_orderkey").cast("string").alias("text"), "deps"))
    return built.select(F.col("text").cast("long").alias("o_orderkey"), "pattern")


#: Tokens of a document get a tag by this list, from the length and the first letter of the word.
TAGS = ("NN", "VBZ", "IN", "NNP", "DT", "JJ", "PRP", "VBG", "TO", "CD", ",", "NNS", "MD", "VB", "?", "RB", "NNPS")

#: The characters of words, listed: Java finds listed ones in a table, but tries ranges one by one.
_WORD = ascii_letters + digits + "?"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the form of extractions: the words of each whole document as tokens; arguments and relation are stretches
    of them whose places depend on the document's number and length. Documents of twelve words and more."""
    # twelve words are looked for at the start of a text: a filter on the words would be moved below and find them all twice
    d = read(spark, sf_dir, "documents").where(F.col("text").rlike(f"^[^{_WORD}]*+(?:[{_WORD}]++[^{_WORD}]++){{11}}[{_WORD}]"))
    # a scan has no more tasks than its files have row groups
    d = d.select("doc_id", "text").repartition(3 * spark.sparkContext.defaultParallelism, "doc_id").select("doc_id", F.regexp_extract_all("text", F.lit(f"[{_WORD}]+"), F.lit(0)).alias("w"))
    tag = lambda w: F.get(F.array(*map(F.lit, TAGS)), ((F.length(w) * 7 + F.ascii(w)) % len(TAGS)).cast("int"))
    tokens = F.arrays_zip(F.sequence(F.lit(0), F.size("w") - 1).alias("idx"), F.col("w").alias("text"), F.transform("w", tag).alias("postag"))
    n = F.size("w")

    def part(s, e):
        words = F.slice("w", s + 1, e - s)
        return F.struct(F.array_join(words, " ").alias("text"), s.alias("s"), e.alias("e"), F.sequence(s, e - 1).alias("idx"))

    k = (F.col("doc_id") % 3).cast("int")
    a1 = part(k, k + 2)
    r = part(k + 2, k + 4)
    a2 = part(F.when(F.col("doc_id") % 5 == 0, n - 2).otherwise(k + 4).cast("int"), F.when(F.col("doc_id") % 5 == 0, n).otherwise(k + 6).cast("int"))
    deps = F.array(F.struct(F.when(F.col("doc_id") % 4 == 0, "appos").otherwise("nn").alias("label"), k.alias("src"), (k + 5).alias("dst")))
    rows = d.select(
        "doc_id", a1.alias("arg1"), r.alias("rel"), a2.alias("arg2"), (F.col("doc_id") % 150 / 100).alias("pattern_confidence"), F.lit("p").alias("pattern"),
        F.when(F.col("doc_id") % 6 == 0, F.array(F.lit("nn"))).otherwise(F.array(F.lit("nsubj"))).alias("pattern_labels"), (F.col("doc_id") % 7 == 0).alias("semantic"), (F.col("doc_id") % 8 == 0).alias("prep_mismatch"),
        tokens.alias("tokens"), deps.alias("deps"),
    )
    return rows


_T = "[" + ", ".join(f"'{t}'" for t in TAGS) + "]"
_BAD = "len(regexp_replace({x}, '[^A-Z]', '', 'g')) > 5 OR len(regexp_replace(lower({x}), '[^aeiouy0-9]', '', 'g')) < 2"
_NVN = "regexp_matches(list_aggregate(list_transform({t}, lambda x: CASE WHEN x LIKE 'NN%' THEN 'N' WHEN x LIKE 'VB%' THEN 'V' ELSE 'x' END), 'string_agg', ''), 'N.*V.*N')"
_PREP = "('IN', 'TO', 'WP')"
#: Each feature in DuckDB, over w (words), t (their tags), a1, r, a2 (texts), t1, tr, t2 (their tags), k and s2, e2 (places).
FEATURE_SQL = {
    "sentence has question mark": "contains(a1 || ' ' || r || ' ' || a2, '?')",
    "sentence is imperative": "t[1] LIKE 'VB%' OR len(list_filter(range(2, n + 1), lambda i: t[i] LIKE 'VB%' AND t[i - 1] = ',')) > 0",
    "arg2 contains infinitive": "t2[1] = 'TO' AND t2[2] LIKE 'VB%'",
    "rel is contiguous": "contains(s, r)",
    "prep right before arg1": f"k > 0 AND t[k] IN {_PREP}",
    "rel starts with be": "false",
    "prep right after arg2": f"coalesce(t[e2 + 1] IN {_PREP}, false)",
    "arg1 is proper": "t1[1] LIKE 'NNP%' AND t1[2] LIKE 'NNP%'",
    "arg2 is proper": "t2[1] LIKE 'NNP%' AND t2[2] LIKE 'NNP%'",
    "sentence starts with extraction": "least(k, s2) = 0",
    "sentence begins with arg1": "k = 0",
    "sentence ends with arg2": "len(list_filter(t[e2 + 1:], lambda x: x NOT IN ('.', '?'))) = 0",
    "pattern confidence": "least(1.0, doc_id % 150 / 100)",
    "arg2 before arg1": "e2 <= k",
    "arg2 before rel": "e2 <= k + 2",
    "args start and end with noun": "t1[1] IN ('PR', 'NN', 'DT', 'CD', 'JJ') AND t2[1] IN ('PR', 'NN', 'DT', 'CD', 'JJ') AND t1[2] IN ('NN', 'CD', 'JJ') AND t2[2] IN ('NN', 'CD', 'JJ')",
    "if right before arg1": "k > 0 AND lower(w[k]) = 'if'",
    "arg1 contains pronoun": "t1[1] LIKE 'PRP%' OR t1[2] LIKE 'PRP%'",
    "arg2 contains pronoun": "t2[1] LIKE 'PRP%' OR t2[2] LIKE 'PRP%'",
    "rel ends with of": "lower(w[k + 4]) = 'of'",
    "rel contains verb": "tr[1] LIKE 'VB%' OR tr[2] LIKE 'VB%'",
    "rel contains gerund": "tr[1] = 'VBG' OR tr[2] = 'VBG'",
    "arg1 bad characters": _BAD.format(x="a1"), "rel bad characters": _BAD.format(x="r"), "arg2 bad characters": _BAD.format(x="a2"),
    "long relation": "false",
    "hyp words in rel": "len(list_filter(['can', 'would', 'could', 'might'], lambda h: contains(' ' || lower(s) || ' ', ' ' || h || ' ') AND NOT contains(' ' || lower(r) || ' ', ' ' || h || ' '))) > 0",
    "vacuous extraction": " OR ".join(f"(starts_with(w[k + 4], '{x}') AND (lower(w[s2 + 1]) = '{y}' OR lower(w[s2 + 2]) = '{y}'))" for x, y in VACUOUS),
    "prep in arg2": f"t2[1] IN {_PREP} OR t2[2] IN {_PREP}",
    "noun-verb-noun in arg1": _NVN.format(t="t1"), "noun-verb-noun in arg2": _NVN.format(t="t2"),
    "arg1 borders appositive": "doc_id % 4 = 0",
    "arg2 borders appositive": "doc_id % 4 = 0 AND (k IN (s2, e2 - 1) OR k + 5 IN (s2, e2 - 1))",
    "gap of 10 in rel": "s2 - (k + 3) > 10",
    "non-contiguous rel": r"NOT contains(s, regexp_replace(regexp_replace(r, '^be ', ''), ' \w+$', ''))",
    "extraction spans sentence": "k = 0 AND greatest(k + 4, e2) = n",
    "sentence ends with extraction": "greatest(k + 4, e2) = n",
    "nn edges in pattern": "doc_id % 6 = 0", "semantic constraints in pattern": "doc_id % 7 = 0", "prep mismatch in pattern": "doc_id % 8 = 0",
}
_FEATURES_FROM = f"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9?]+') AS w FROM documents),
b AS (SELECT doc_id, w, len(w) AS n, doc_id % 3 AS k, list_transform(w, lambda x: ({_T})[(len(x) * 7 + ascii(x)) % {len(TAGS)} + 1]) AS t FROM a WHERE len(w) >= 12),
c AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN n - 2 ELSE k + 4 END AS s2, CASE WHEN doc_id % 5 = 0 THEN n ELSE k + 6 END AS e2, list_aggregate(w, 'string_agg', ' ') AS s FROM b),
x AS (SELECT *, w[k + 1] || ' ' || w[k + 2] AS a1, w[k + 3] || ' ' || w[k + 4] AS r, w[s2 + 1] || ' ' || w[s2 + 2] AS a2, t[k + 1:k + 2] AS t1, t[k + 3:k + 4] AS tr, t[s2 + 1:s2 + 2] AS t2 FROM c)"""


@query("feature_values", _FEATURES_FROM + " SELECT doc_id, " + ", ".join(f'CAST({x} AS DOUBLE) AS "{n}"' for n, x in FEATURE_SQL.items()) + " FROM x")
def feature_values(spark, sf_dir):
    """Confidence features over the words of every whole document."""
    rows = measured(_tagged(spark, sf_dir), lambda known: features(known) | further_features())
    return rows.select("doc_id", *[F.col(f"`{n}`") for n in FEATURE_SQL])


# Options of the engine, and files that it reads ------------------------------------------------------------------------


@query("voice_flags", f"""WITH {FACTS_SQL} SELECT o_orderkey, r AS rel, contains(pattern, 'nsubjpass') OR r LIKE '% by' AS passive,
 (contains(pattern, 'nsubj<') OR contains(pattern, '>nsubj')) AND (contains(pattern, 'nsubj<') OR NOT contains(pattern, 'nsubjpass')) AS active FROM f""")
def voice_flags(spark, sf_dir):
    return extracted(spark, sf_dir).select("o_orderkey", F.col("rel.text").alias("rel"), "passive", "active")


@query("sure_patterns", f"WITH {FACTS_SQL} SELECT o_orderkey, r AS rel, pattern FROM f WHERE pattern_confidence >= 0.8")
def sure_patterns(spark, sf_dir):
    """Only patterns of some confidence are matched."""
    return E.extract(sentences(spark, sf_dir), config=E.Configuration(threshold=0.8)).select("o_orderkey", F.col("rel.text").alias("rel"), "pattern")


@query("sure_facts", f"WITH {FACTS_SQL} SELECT o_orderkey, r AS rel FROM f WHERE 1 / (1 + exp(-({_ODDS_SQL}))) >= 0.75")
def sure_facts(spark, sf_dir):
    """Only facts of some confidence are kept."""
    return E.with_confidence(E.extract(sentences(spark, sf_dir)), threshold=0.75).select("o_orderkey", F.col("rel.text").alias("rel"))


_GENERAL = ["general", "{arg1} <nsubjpass< {rel:postag=VBN} >agent> {arg2}\t0.9", "{arg1} <nsubj< {rel:postag=VBD} >dobj> {arg2}"]


@query("general_model", " UNION ALL ".join(f"SELECT o_orderkey, {_named(a)} || ' / ' || {_named(r)} || ' / ' || {_named(b)} AS fact, {c}::DOUBLE AS pattern_confidence, NULL::VARCHAR AS template FROM orders WHERE o_orderkey % {N_FORMS} = {form}"
        for form, a, r, b, c in ((1, "order%o", "was sent", "Cust%c", 0.9), (5, "Clerk%k", "sent Cust%c", "crates that leak", 1.0), (8, "order%o", "can soon be taken", "Cust%c", 0.9))))
def general_model(spark, sf_dir):
    """A model without templates: a relation is what the match and its expansion say."""
    return E.extract(sentences(spark, sf_dir), _GENERAL).select("o_orderkey", F.concat_ws(" / ", "arg1.text", "rel.text", "arg2.text").alias("fact"), "pattern_confidence", "template")


@query("without_expansion", f"WITH {FACTS_SQL} SELECT o_orderkey, CASE o_orderkey % {N_FORMS} WHEN 4 THEN 'Cust' || o_custkey ELSE 'Clerk' || (o_orderkey % 97) END AS arg1, CASE o_orderkey % {N_FORMS} WHEN 4 THEN 'load' WHEN 5 THEN 'sent' ELSE 'repair' END AS rel, CASE o_orderkey % {N_FORMS} WHEN 6 THEN 'cranes' ELSE 'crates' END AS arg2 FROM f JOIN orders USING (o_orderkey) WHERE o_orderkey % {N_FORMS} IN (4, 5, 6)")
def without_expansion(spark, sf_dir):
    """The bare words of a match."""
    found = E.extract(sentences(spark, sf_dir).where("form IN (4, 5, 6)"), config=E.Configuration(expand=False))
    return found.select("o_orderkey", F.col("arg1.text").alias("arg1"), F.col("rel.text").alias("rel"), F.col("arg2.text").alias("arg2"))


@query("skipped_errors", f"WITH {FACTS_SQL} SELECT o_orderkey, r AS rel FROM f WHERE o_orderkey % 7 > 1")
def skipped_errors(spark, sf_dir):
    """Graphs that are cut off or missing give nothing, the others are as ever."""
    broken = F.when(F.col("o_orderkey") % 7 == 0, F.concat("graph", F.lit(" nsubj("))).when(F.col("o_orderkey") % 7 > 1, F.col("graph"))
    return E.extract(sentences(spark, sf_dir).withColumn("graph", broken)).select("o_orderkey", F.col("rel.text").alias("rel"))


@query("sniffed_columns", f"SELECT o_orderkey, CASE o_orderkey % {N_FORMS} {' '.join(f'WHEN {i} THEN {_named(x)}' for i, x in enumerate(FORMS))} END AS graph FROM orders")
def sniffed_columns(spark, sf_dir):
    """Files whose graphs stand in different fields, read together."""
    path, s = scratch_path(spark, "sniffed"), sentences(spark, sf_dir)
    key = F.col("o_orderkey").cast("string")
    s.where("o_orderkey % 2 = 0").select(F.concat_ws("\t", key, "graph", F.lit("x")).alias("line")).write.text(f"{path}/even")
    s.where("o_orderkey % 2 <> 0").select(F.concat_ws("\t", key, F.lit("y"), F.lit("z"), "graph").alias("line")).write.text(f"{path}/odd")
    return R.sniffed(spark, [f"{path}/even", f"{path}/odd"]).select(F.get(F.split("line", "\t"), F.lit(0)).cast("long").alias("o_orderkey"), "graph")


@query("wide_lines", "SELECT o_orderkey || ': ' || chr(2570) || ' é ' || o_comment AS sentence FROM (SELECT o_orderkey, 'order of ' || o_custkey || chr(2826) AS o_comment FROM orders)")
def wide_lines(spark, sf_dir):
    """Lines written in units of 16 bits, with characters that hold a byte 10, and read in ranges."""
    path, o = scratch_path(spark, "wide"), read(spark, sf_dir, "orders")
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(": ਊ é order of "), F.col("o_custkey").cast("string"), F.lit("ଊ"))
    o.select(line.alias("line")).write.option("encoding", "UTF-16LE").option("quote", "").option("escape", "").option("sep", "\x01").option("lineSep", "\n").csv(path)
    return R.lines(spark, path, "UTF-16LE").select("sentence")


@query("table_round_trip", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false END AS score, o_totalprice / 1000000 AS confidence, '(' || o_custkey || '; ' || o_orderstatus || ')' AS extraction, o_orderpriority || ',' || o_orderkey AS extra FROM orders")
def table_round_trip(spark, sf_dir):
    """A scored table written as lines and read back, with flags, numbers and further columns."""
    path, o = scratch_path(spark, "scored"), read(spark, sf_dir, "orders")
    flag = F.when(F.col("o_orderkey") % 3 == 0, "1").when(F.col("o_orderkey") % 3 == 1, "0").otherwise("")
    line = F.concat_ws("\t", flag, (F.col("o_totalprice") / 1000000).cast("string"), F.concat(F.lit("("), F.col("o_custkey").cast("string"), F.lit("; "), "o_orderstatus", F.lit(")")), "o_orderpriority", F.col("o_orderkey").cast("string"))
    o.select(line.alias("line")).write.text(path)
    return R.table(spark, path, "scored").select("score", "confidence", "extraction", F.array_join("extra", ",").alias("extra"))


@query("template_lines", """SELECT p_brand || chr(9) || '{arg1} <nsubj< {rel:postag=NN} >prep_of> {arg2}' || chr(9) || count(*) || chr(9) || string_agg(w || ' -> ' || n, chr(9) ORDER BY w) AS line
 FROM (SELECT p_brand, lower(split_part(p_type, ' ', 1)) AS w, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand""")
def template_lines(spark, sf_dir):
    """Templates with the words of their slots, as lines."""
    words = read(spark, sf_dir, "part").groupBy("p_brand", F.lower(F.get(F.split("p_type", " "), F.lit(0))).alias("w")).agg(F.count("*").alias("n"))
    rows = words.groupBy(F.col("p_brand").alias("template")).agg(F.count("*").alias("count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("w", "n")))).alias("slots"))
    return W.template_lines(rows.withColumn("pattern", F.lit("{arg1} <nsubj< {rel:postag=NN} >prep_of> {arg2}")), True)


@query("pattern_components", f"""WITH {FACTS_SQL}, c AS (SELECT 'edge' AS kind, unnest(regexp_extract_all(pattern, '[<>]([a-z_]+)[<>]', 1)) AS component FROM f UNION ALL SELECT 'tag', unnest(regexp_extract_all(pattern, 'postag=([A-Z]+)', 1)) FROM f)
 SELECT kind, component, count(*) AS n FROM c GROUP BY ALL""")
def pattern_components(spark, sf_dir):
    """Labels and tags of the patterns that found something."""
    return C.pattern_components(extracted(spark, sf_dir))


@query("short_patterns", " UNION ALL ".join(f"SELECT o_orderkey, '{k[5]}' AS pattern FROM orders WHERE o_orderkey % {N_FORMS} = {k[0]}" for k in KNOWN if k[5].count("{") <= 3))
def short_patterns(spark, sf_dir):
    """Induced patterns of at most three nodes."""
    return known_patterns(spark, sf_dir, 3)
