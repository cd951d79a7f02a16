"""The voice of single graphs: what the batches must give."""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from factloom.functions.graph import Edge, Graph, Node


def character_offsets(words: list[str]) -> list[int]:
    """Where each word begins when they are joined by blanks."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    return (np.cumsum(sizes) - sizes).tolist()


def _rebuilt(tokens: list[Node], places: np.ndarray, edges: list[tuple[int, int, str]]) -> Graph:
    """The tokens at their new places, with offsets in the new text; those without an edge go."""
    used = sorted({i for a, b, _ in edges for i in (a, b)}, key=lambda i: (places[i], tokens[i].text))
    at = dict(zip(used, character_offsets([tokens[i].text for i in used]), strict=True))
    new = {i: replace(tokens[i], start=int(places[i]), end=int(places[i]) + 1, offset=at[i]) for i in used}
    return Graph([], [Edge(new[a], new[b], label) for a, b, label in edges])


def _exchanged(places: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """Two stretches change sides, each moved as a whole: the last place of the left one and the first of the right one
    are exchanged. Fixed rule of the graphs that trained models were made from. None if they overlap or stand the other
    way round."""
    last, first = places[left].max(), places[right].min()
    if last >= first:
        return None
    moved = places.copy()
    moved[left] += first - last
    moved[right] += last - first
    return moved


def _clause(g: Graph, verb: Node, *labels: str) -> list[Edge] | None:
    """The first edge of each label below a verb; None if one is missing."""
    first = {e.label: e for e in reversed(g.down(verb))}
    return [first[x] for x in labels] if all(x in first for x in labels) else None


def passive_voice(g: Graph) -> list[Graph]:
    """A graph for each verb with subject and direct object.

    ``was`` is put in before the verb and ``by`` before the object; tokens from there on move up by one for each. Then
    subject and object change sides.
    """
    out = []
    for verb in g.vertices:
        clause = _clause(g, verb, "nsubj", "dobj") if verb.postag.startswith("VB") else None
        if clause is None:
            continue
        subject, thing = (e.dst for e in clause)
        number = {n: i for i, n in enumerate(g.vertices)}
        sides = [np.array([number[n] for n in g.inferiors(x)]) for x in (subject, thing)]
        places = np.array([n.start for n in g.vertices])
        put = np.array([verb.start, places[sides[1]].min()])  # before the verb: was; before the object: by
        places = np.concatenate([places + (places[:, None] >= put).sum(1), put + [int(put[1] <= put[0]), int(put[0] <= put[1])]])
        was, by = len(number), len(number) + 1
        edges = [(number[e.src], number[e.dst], e.label) for e in g.edges if e not in clause]
        edges += [(number[verb], by, "prep"), (by, number[subject], "pobj"), (number[verb], was, "auxpass"), (number[verb], number[thing], "nsubjpass")]
        moved = _exchanged(places, *sides)
        if moved is not None:
            out.append(_rebuilt([*g.vertices, Node(0, 1, "was", "VBD"), Node(0, 1, "by", "IN")], moved, edges))
    return out


def active_voice(g: Graph) -> list[Graph]:
    """A graph for each verb with passive subject, auxiliary and an agent behind ``by``; places are numbered anew without gaps."""
    out = []
    for verb in g.vertices:
        clause = _clause(g, verb, "nsubjpass", "auxpass")
        by = [(e, x) for e in g.down(verb) if e.label == "prep" and e.dst.text == "by" for x in g.down(e.dst) if x.label == "pobj"]
        if clause is None or not by:
            continue
        gone = {*clause, *by[0]}
        subject, agent = clause[0].dst, by[0][1].dst
        number = {n: i for i, n in enumerate(g.vertices)}
        sides = [np.array([number[n] for n in g.inferiors(x)]) for x in (subject, agent)]
        places = _exchanged(np.array([n.start for n in g.vertices]), *sides)
        if places is None:
            continue
        edges = [(number[e.src], number[e.dst], e.label) for e in g.edges if e not in gone]
        edges += [(number[verb], number[agent], "nsubj"), (number[verb], number[subject], "dobj")]
        used = np.array(sorted({i for a, b, _ in edges for i in (a, b)}, key=lambda i: (places[i], g.vertices[i])))
        places[used] = np.arange(len(used))
        out.append(_rebuilt(g.vertices, places, edges))
    return out


def switch_voice(g: Graph) -> list[Graph]:
    return passive_voice(g) + active_voice(g)
