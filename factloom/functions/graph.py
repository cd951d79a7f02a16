"""Dependency graphs of single sentences: codec, normal forms, expansion, voice.

A graph is small and belongs to one sentence, so these functions run inside Arrow batches, sentence by sentence;
whatever crosses sentences is a DataFrame operator. Assumptions about behaviour that isn't written down anywhere are
stated in the docstrings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

import numpy as np


@dataclass(frozen=True, order=True)
class Node:
    """A token, or several merged into one. Ordered by place, then text."""

    start: int
    end: int
    text: str
    postag: str
    offset: int = -1
    lemma: str = field(default="", compare=False)

    @property
    def proper(self) -> bool:
        return self.postag in ("NNP", "NNPS")

    def __str__(self) -> str:
        place = str(self.start) if self.end == self.start + 1 else f"{self.start}-{self.end - 1}"
        return f"{self.text}_{self.postag}_{place}_{self.offset}"


@dataclass(frozen=True)
class Edge:
    src: Node
    dst: Node
    label: str


class Graph:
    """``nodes`` are all tokens, also those that edges have absorbed; ``edges`` connect the vertices."""

    def __init__(self, nodes: Iterable[Node], edges: Iterable[Edge]):
        self.edges = sorted(set(edges), key=lambda e: (e.src.start, e.dst.start, e.label, e.src, e.dst))
        self.vertices = sorted({n for e in self.edges for n in (e.src, e.dst)})
        self.nodes = sorted({*nodes, *self.vertices})
        self._down: dict[Node, list[Edge]] = {}
        self._up: dict[Node, list[Edge]] = {}
        for e in self.edges:
            self._down.setdefault(e.src, []).append(e)
            self._up.setdefault(e.dst, []).append(e)

    def down(self, n: Node) -> list[Edge]:
        return self._down.get(n, [])

    def up(self, n: Node) -> list[Edge]:
        return self._up.get(n, [])

    def inferiors(self, n: Node, keep: Callable[[Edge], bool] = lambda e: True) -> set[Node]:
        """n and all below it by kept edges. Graphs may have cycles."""
        seen, todo = {n}, [n]
        while todo:
            for e in self.down(todo.pop()):
                if keep(e) and e.dst not in seen:
                    seen.add(e.dst)
                    todo.append(e.dst)
        return seen

    def map(self, change: Callable[[Node], Node]) -> Graph:
        new = {n: change(n) for n in self.nodes}
        return Graph(new.values(), (Edge(new[e.src], new[e.dst], e.label) for e in self.edges))

    @property
    def text(self) -> str:
        return " ".join(n.text for n in self.nodes)

    def __str__(self) -> str:
        alone = [n for n in self.nodes if n not in set(self.vertices)]
        body = "; ".join(f"{e.label}({e.src}, {e.dst})" for e in self.edges)
        return "".join(f"({n}), " for n in alone) + body


_NODE = r".*?_[^_\s]+?_\d+(?:-\d+)?_-?\d+"
_EDGE = re.compile(rf"([\w:]+)\(({_NODE}), ({_NODE})\)(?:; |$)")
_ALONE = re.compile(r"(?:^|, )\((\S*_\S+_\d+(?:-\d+)?_-?\d+)\)")


def parse_node(raw: str) -> Node:
    """From the right: text may be empty or hold underscores. A range ``a-b`` of places stands for a merged node."""
    text, postag, place, offset = raw.rsplit("_", 3)
    first, _, last = place.partition("-")
    return Node(int(first), int(last or first) + 1, text, postag, int(offset), lemma(text))


def parse(raw: str) -> Graph:
    """Raises ValueError on a string that isn't a graph."""
    match = _EDGE.search(raw)
    head, body = (raw[: match.start()], raw[match.start() :]) if match else (raw, "")
    edges, at = [], 0
    for m in _EDGE.finditer(body):
        if m.start() != at:
            break
        edges.append(Edge(parse_node(m[2]), parse_node(m[3]), m[1]))
        at = m.end()
    alone = [parse_node(x) for x in _ALONE.findall(head.rstrip(", "))] if head else []
    if at != len(body) or not (edges or alone):
        raise ValueError(f"not a dependency graph: {raw[:80]!r}")
    return Graph(alone, edges)


#: Irregular forms; the rules below do the rest.
IRREGULAR = {
    "is": "be", "are": "be", "was": "be", "were": "be", "am": "be", "been": "be", "being": "be", "'s": "be", "'re": "be", "'m": "be", "has": "have",
    "had": "have", "having": "have", "does": "do", "did": "do", "done": "do", "went": "go", "gone": "go", "goes": "go", "said": "say", "says": "say",
    "made": "make", "took": "take", "taken": "take", "came": "come", "got": "get", "gave": "give", "given": "give", "found": "find", "thought": "think",
    "told": "tell", "became": "become", "left": "leave", "felt": "feel", "brought": "bring", "began": "begin", "kept": "keep", "held": "hold",
    "wrote": "write", "written": "write", "stood": "stand", "heard": "hear", "met": "meet", "ran": "run", "paid": "pay", "sat": "sit", "spoke": "speak",
    "spoken": "speak", "led": "lead", "grew": "grow", "grown": "grow", "lost": "lose", "fell": "fall", "sent": "send", "built": "build", "understood": "understand",
    "born": "bear", "bore": "bear", "won": "win", "knew": "know", "known": "know", "saw": "see", "seen": "see", "bought": "buy", "taught": "teach",
    "men": "man", "women": "woman", "children": "child", "people": "people", "feet": "foot", "teeth": "tooth", "mice": "mouse", "hit": "hit", "united": "unite", "married": "marry",
}


def lemma(word: str) -> str:
    """Inflectional lemma in lower case, word by word: a table of irregular forms, then suffix rules."""
    w = word.lower()
    if " " in w:
        return " ".join(lemma(x) for x in w.split(" "))
    if w in IRREGULAR:
        return IRREGULAR[w]
    vowel = re.search(r"[aeiouy]", w[:-3] or "")
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if len(w) > 4 and re.search(r"(?:ss|sh|ch|x|z|o)es$", w):
        return w[:-2]
    if len(w) > 3 and w.endswith("s") and not re.search(r"(?:ss|us|is)$", w):
        return w[:-1]
    if len(w) > 4 and w.endswith("ied"):
        return w[:-3] + "y"
    for end in ("ing", "ed"):
        if len(w) >= len(end) + 2 and w.endswith(end) and vowel:
            stem = w[: -len(end)]
            if re.search(r"([bdfgklmnprtvz])\1$", stem) and not stem.endswith(("ll", "ss")):
                return stem[:-1]
            if re.search(r"(?:at|iv|iz|uc|ut|ag|ar|as|os|us|ur|id|in[cg]|rs|nc|bl|pl|tl|ov|ok|ak|ik)$", stem) and re.search(r"[aeiouy].*[aeiouy]|^[^aeiou]*[aeiou][kvs]$", stem):
                return stem + "e"
            return stem
    return w


#: Prepositions, of one and of several words.
PREPOSITIONS = (
    "about", "above", "across", "after", "against", "along", "among", "around", "as", "at", "before", "behind", "below", "beneath", "beside", "between",
    "beyond", "by", "despite", "down", "during", "except", "for", "from", "in", "inside", "into", "like", "near", "of", "off", "on", "onto", "out", "outside", "over",
    "past", "per", "since", "through", "throughout", "to", "toward", "towards", "under", "until", "up", "upon", "via", "with", "within", "without",
    "according to", "ahead of", "because of", "close to", "due to", "in front of", "instead of", "next to", "out of", "prior to", "such as", "as well as",
)


def simplify_tag(tag: str, verbs: bool = False) -> str:
    """Plural noun tags become singular; with ``verbs`` all VB* become VB."""
    tag = {"NNS": "NN", "NNPS": "NNP", "PRPS": "PRP"}.get(tag, tag)
    return "VB" if verbs and tag.startswith("VB") else tag
