"""Dependency-path patterns: codec, predicates, mirror and matching on one graph."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

from .graph import Edge, Graph, Node


@dataclass(frozen=True)
class NodeMatcher:
    """``{alias:postag=X:regex=R}``; the lemma must match the regex in full."""

    alias: str
    postag: str | None = None
    regex: str | None = None

    @property
    def kind(self) -> str:
        kinds = {"arg": "argument", "rel": "relation", "slo": "slot"}
        if self.alias[:3] not in kinds:
            raise ValueError(f"unknown alias in a pattern: {self.alias}")
        return kinds[self.alias[:3]]

    def matches_lemma(self, lemma: str) -> bool:
        return self.regex is None or re.fullmatch(self.regex, lemma) is not None

    def matches(self, n: Node) -> bool:
        return (self.postag is None or n.postag == self.postag) and self.matches_lemma(n.lemma)

    def __str__(self) -> str:
        return "{" + self.alias + (f":postag={self.postag}" if self.postag else "") + (f":regex={self.regex}" if self.regex else "") + "}"


@dataclass(frozen=True)
class EdgeMatcher:
    """``<label<`` climbs to the governor, ``>label>`` descends; ``{alias:regex=R}`` as label captures."""

    up: bool
    label: str
    regex: str | None = None

    def capture(self, label: str) -> str | None:
        """What a label gives: itself or the first group; None if it doesn't match."""
        if self.regex is None:
            return label if label == self.label else None
        m = re.fullmatch(self.regex, label)
        return None if m is None else (m[1] if m.re.groups else label)

    @property
    def flipped(self) -> EdgeMatcher:
        return replace(self, up=not self.up)

    def __str__(self) -> str:
        mark = "<" if self.up else ">"
        return mark + (f"{{{self.label}:regex={self.regex}}}" if self.regex else self.label) + mark


_PART = re.compile(r"\{(\w+)((?::(?:postag|regex)=(?:[^{}]|\{[^{}]*\})*?)*)\}|([<>])(?:\{(\w+):regex=([^{}]+)\}|([\w:]+))([<>])")


@dataclass(frozen=True)
class Pattern:
    nodes: tuple[NodeMatcher, ...]
    edges: tuple[EdgeMatcher, ...]

    def __str__(self) -> str:
        return " ".join(str(x) for pair in zip(self.nodes, self.edges, strict=False) for x in pair) + (" " if self.edges else "") + str(self.nodes[-1])

    @property
    def shape(self) -> str:
        return "".join("U" if e.up else "D" for e in self.edges)

    @property
    def reflection(self) -> Pattern:
        return Pattern(self.nodes[::-1], tuple(e.flipped for e in self.edges[::-1]))

    @property
    def relation(self) -> NodeMatcher | None:
        return next((n for n in self.nodes if n.kind == "relation"), None)

    @property
    def semantic(self) -> bool:
        return any(n.kind == "relation" and n.regex for n in self.nodes)

    @property
    def symmetric(self) -> bool:
        """Its mirror is itself, whatever stands in the argument places."""
        plain = lambda p: ([None if n.kind == "argument" else n for n in p.nodes], p.edges)
        return plain(self) == plain(self.reflection)

    @property
    def valid(self) -> bool:
        """No dep or conj edge, no two edges with several prepositions, no slot at an end."""
        labels = [e.label if e.regex is None else e.regex for e in self.edges]
        if any(x == "dep" or x.startswith("conj") for x in labels):
            return False
        if len(labels) == 2 and sum(x.startswith("prep") for x in labels) > 1:
            return False
        return "slot" not in (self.nodes[0].kind, self.nodes[-1].kind)

    def switch_args(self) -> Pattern:
        swap = {"arg1": "arg2", "arg2": "arg1"}
        return Pattern(tuple(replace(n, alias=swap.get(n.alias, n.alias)) for n in self.nodes), self.edges)

    def can_match(self, labels: set[str]) -> bool:
        return all(any(e.capture(x) is not None for x in labels) for e in self.edges)


def parse_pattern(raw: str) -> Pattern:
    nodes, edges, at = [], [], 0
    raw = raw.strip()
    for m in _PART.finditer(raw):
        if raw[at : m.start()].strip():
            raise ValueError(f"not a pattern: {raw!r}")
        at = m.end()
        if m[1]:
            options = dict(x.split("=", 1) for x in re.split(r":(?=(?:postag|regex)=)", m[2])[1:])
            nodes.append(NodeMatcher(m[1], options.get("postag"), options.get("regex")))
            nodes[-1].kind  # noqa: B018  raises on an unknown family
        else:
            if m[3] != m[7]:
                raise ValueError(f"an edge of a pattern points both ways: {m[0]}")
            edges.append(EdgeMatcher(m[3] == "<", m[4] or m[6], m[5]))
        if not 0 <= len(nodes) - len(edges) <= 1:
            raise ValueError(f"nodes and edges of a pattern must alternate: {raw!r}")
    if raw[at:].strip() or len(nodes) != len(edges) + 1:
        raise ValueError(f"not a pattern: {raw!r}")
    return Pattern(tuple(nodes), tuple(edges))


@dataclass(frozen=True)
class Match:
    nodes: dict[str, Node]
    captures: dict[str, str]
    path: tuple[Edge, ...]


def find(p: Pattern, g: Graph, first: Node | None = None, distinct: bool = True) -> Iterator[Match]:
    """All paths that the pattern matches, or those from one node. ``distinct``: no node twice on a path."""

    def walk(k: int, at: Node, taken: tuple[Node, ...], path: tuple[Edge, ...], caught: tuple[tuple[str, str], ...]) -> Iterator[Match]:
        if k == len(p.edges):
            captures = {n.alias: x.text for n, x in zip(p.nodes, taken, strict=True)} | dict(caught)
            yield Match({n.alias: x for n, x in zip(p.nodes, taken, strict=True)}, captures, path)
            return
        e = p.edges[k]
        for x in g.up(at) if e.up else g.down(at):
            to = x.src if e.up else x.dst
            got = e.capture(x.label)
            if got is not None and not (distinct and to in taken) and p.nodes[k + 1].matches(to):
                yield from walk(k + 1, to, (*taken, to), (*path, x), (*caught, (e.label, got)) if e.regex else caught)

    for n in [first] if first is not None else g.vertices:
        if p.nodes[0].matches(n):
            yield from walk(0, n, (n,), (), ())
