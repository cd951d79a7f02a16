"""Induction sentence by sentence and over all simple paths, for small graphs: what the batches must find."""

from __future__ import annotations

import re
from dataclasses import replace
from itertools import product

from factloom.functions.graph import Edge, Graph, Node, lemma, simplify_tag
from factloom.functions.induction import VALID_TAGS
from factloom.functions.patterns import EdgeMatcher, NodeMatcher, Pattern


def collapse(g: Graph) -> Graph:
    """prep and pobj edges over a preposition become one edge prep_X; the preposition stays as a token."""
    edges, gone = list(g.edges), set()
    for e in g.edges:
        if e.label == "prep":
            objects = [x for x in g.down(e.dst) if x.label == "pobj"]
            rest = [x for x in g.down(e.dst) if x.label != "pobj"]
            if objects and not rest:
                gone |= {e, *objects}
                edges += [Edge(e.src, x.dst, f"prep_{e.dst.text.lower()}") for x in objects]
    return Graph(g.nodes, [e for e in edges if e not in gone])


def simplify(g: Graph, edges: bool = True, tags: bool = True, verbs: bool = False) -> Graph:
    """The form that patterns are matched on; each step can be left out."""
    g = collapse(g) if edges else g
    return g.map(lambda n: replace(n, postag=simplify_tag(n.postag, verbs))) if tags or verbs else g


def merge_nouns(g: Graph) -> Graph:
    """Neighbouring tokens joined by nn edges under one head become a node with the head's tag and the tokens' text."""
    for head in list(g.vertices):
        group = sorted({head, *(e.dst for e in g.down(head) if e.label == "nn")})
        if len(group) < 2:
            continue
        at = group.index(head)
        first = at
        while first > 0 and group[first - 1].end == group[first].start:
            first -= 1
        run = group[first : at + 1]
        if len(run) < 2:
            continue
        new = Node(run[0].start, run[-1].end, " ".join(n.text for n in run), head.postag, run[0].offset, " ".join(n.lemma or lemma(n.text) for n in run))
        inside = set(run)
        edges = [Edge(new if e.src in inside else e.src, new if e.dst in inside else e.dst, e.label) for e in g.edges if not (e.src in inside and e.dst in inside)]
        return merge_nouns(Graph([new if n == head else n for n in g.nodes if n not in inside or n == head], edges))
    return g


def merge_names(g: Graph) -> Graph:
    """A proper noun with ``of`` and a proper noun below it becomes one node, texts and all tokens between them."""
    for e in g.edges:
        if e.label == "prep_of" and e.src.proper and e.dst.proper and e.src.start < e.dst.start:
            inside = [n for n in g.nodes if e.src.start <= n.start and n.end <= e.dst.end]
            if any(x.dst in inside and x.src not in inside and x.dst not in (e.src, e.dst) for x in g.edges):
                continue
            new = Node(e.src.start, e.dst.end, " ".join(n.text for n in inside), e.src.postag, e.src.offset, " ".join(n.lemma or lemma(n.text) for n in inside))
            of = lambda n: new if n in inside else n  # noqa: E731, B023
            edges = {Edge(of(x.src), of(x.dst), x.label) for x in g.edges}
            return merge_names(Graph([of(n) for n in g.nodes], [x for x in edges if x.src != x.dst]))
    return g


def prepare(g: Graph) -> Graph:
    """Lemmas as texts, merged noun groups and names joined by ``of``, simple noun tags."""
    return simplify(merge_names(merge_nouns(g.map(lambda n: replace(n, text=lemma(n.text), lemma=lemma(n.text))))), edges=True, tags=True)


def paths_through(g: Graph, wanted: set[Node], longest: int) -> list[list[tuple[Edge, bool]]]:
    """Simple undirected paths that visit all wanted nodes and end in two of them, in one direction each: (edge, climbs)."""
    out, seen = [], set()

    def walk(at: Node, taken: list[Node], path: list[tuple[Edge, bool]]) -> None:
        if wanted <= set(taken) and at in wanted and len(taken) > 1:
            key = frozenset(e for e, _ in path)
            if key not in seen:
                seen.add(key)
                out.append(list(path))
            return
        if len(path) == longest:
            return
        for e, up in [(e, True) for e in g.up(at)] + [(e, False) for e in g.down(at)]:
            to = e.src if up else e.dst
            if to not in taken:
                walk(to, [*taken, to], [*path, (e, up)])

    for n in sorted(wanted):
        walk(n, [n], [])
    return out


def well_formed(path: list[tuple[Edge, bool]]) -> bool:
    """Climbs first, then descends, over labels that are words and neither punct nor dep."""
    return bool(path) and re.fullmatch("U*D*", "".join("U" if up else "D" for _, up in path)) is not None and all(e.label not in ("punct", "dep") and re.fullmatch(r"\w+", e.label) for e, _ in path)


def nodes_for(g: Graph, word: str) -> list[Node]:
    """Nodes of that text, else the one node whose text contains it."""
    same = [n for n in g.vertices if n.text == word]
    if same:
        return same
    holding = [n for n in g.vertices if word in n.text]
    return holding if len(holding) == 1 else []


def argument_node(path_nodes: list[Node], words: str) -> Node | None:
    for test in (lambda n: n.text == words, lambda n: words in n.text, lambda n: n.text in words.split()):
        hit = [n for n in path_nodes if test(n) and n.postag in VALID_TAGS]
        if hit:
            return hit[0]
    return None


def induce(g: Graph, rel: str, arg1: str, arg2: str, lemmas: str, longest: int | None = None) -> list[Pattern]:
    """Patterns of all paths over the lemmas of a fact. ``longest`` bounds the node matchers of a pattern.

    The graph must be prepared. On the path, arguments become {arg1} and {arg2}, words of the relation {rel} (or {rel0},
    {rel1} ...) with their tags, and what is left {slotN}; a path that doesn't start at arg1 is turned round.
    """
    words = list(dict.fromkeys(lemmas.split()))
    args = set(arg1.split()) | set(arg2.split())
    choices = []
    for group in [arg1, arg2, *[w for w in words if w not in args]]:
        found = nodes_for(g, group) or next((x for w in reversed(group.split()) if (x := nodes_for(g, w))), [])
        if found:
            choices.append(found)
        elif group in (arg1, arg2):
            return []
    out: dict[str, Pattern] = {}
    for combo in product(*choices):
        wanted = set(combo)
        if len({n.text for n in wanted}) != len(wanted):
            continue
        for path in paths_through(g, wanted, len(g.vertices) if longest is None else longest - 1):
            turned = [(e, not up) for e, up in reversed(path)]
            for way in (path, turned):
                if not well_formed(way):
                    continue
                first = way[0][0].dst if way[0][1] else way[0][0].src
                nodes = [first]
                for e, up in way:
                    nodes.append(e.src if up else e.dst)
                one, two = argument_node(nodes, arg1), argument_node(nodes, arg2)
                if one is None or two is None or one == two or nodes[0] != one:
                    continue
                inner = [n for n in nodes if n not in (one, two)]
                rels = [n for n in inner if n.text in rel.split()]
                names = {one: NodeMatcher("arg1"), two: NodeMatcher("arg2")}
                names |= {n: NodeMatcher("rel" if len(rels) == 1 else f"rel{i}", n.postag) for i, n in enumerate(rels)}
                names |= {n: NodeMatcher(f"slot{i}", n.postag) for i, n in enumerate(x for x in inner if x not in rels)}
                if not rels:
                    continue
                p = Pattern(tuple(names[n] for n in nodes), tuple(EdgeMatcher(up, e.label) for e, up in way))
                if longest is None or len(p.nodes) <= longest:
                    out[str(p)] = p
                break
    return list(out.values())
