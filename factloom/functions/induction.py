"""Pattern induction: from sentences that hold known facts to the path patterns that express them, a batch at a time.

A well-formed path climbs from one word of the fact to a common governor of both its ends and descends to the other. So
all climbs from the words of all facts of a batch advance together, a hop at a time, and two climbs that end in the same
node make a path; nothing else of the graph is walked.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from .batch import Batch, Links, member, ranges
from .graph import simplify_tag
from .patterns import EdgeMatcher, NodeMatcher, Pattern

#: Tags a node may have to stand for an argument.
VALID_TAGS = ("NN", "NNS", "NNP", "NNPS", "PRP", "CD", "JJ")


def codes(strings: list[str], among: dict[str, int]) -> np.ndarray:
    """Numbers of strings, given out as they come."""
    return np.fromiter((among.setdefault(s, len(among)) for s in strings), np.int64, len(strings))


@dataclass
class Nodes:
    """Prepared graphs of a batch: nodes in order of sentence and place, edges between them, each once."""

    sentence: np.ndarray
    text: np.ndarray
    tag: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    label: np.ndarray
    names: list[str]


def _root(parent: np.ndarray) -> np.ndarray:
    """What every token has been merged into, by pointer jumping."""
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _merged_nouns(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, start, end) of each token once every noun has taken in the nn nodes that touch it on its left, and theirs."""
    root, start, end = np.arange(b.tokens), b.place.copy(), b.end.copy()
    edges = np.flatnonzero(b.labelled(("nn",)))
    while len(edges):
        head, part = root[b.src[edges]], root[b.dst[edges]]
        touch = (head != part) & (end[part] == start[head])
        if not touch.any():
            break
        root[part[touch]] = head[touch]
        root = _root(root)
        np.minimum.at(start, root, b.place)
    return root, start, end


def _merge_names(b: Batch, root: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """root once a proper noun with ``of`` and a proper noun behind it is one node with all tokens between them, unless an
    edge from outside leads to one of these. One pair of a sentence at a time, the first in order, until none is left."""
    root, end = root.copy(), end.copy()
    of = np.flatnonzero(b.labelled(("prep_of",)))
    edge_sentence = b.sentence[b.src]
    first_edge = np.searchsorted(edge_sentence, np.arange(b.sentences + 1))
    while len(of):
        head, part = root[b.src[of]], root[b.dst[of]]
        pairs = np.flatnonzero((head != part) & b.proper[head] & b.proper[part] & (start[head] < start[part]))
        if not len(pairs):
            break
        pairs = pairs[np.lexsort((start[part[pairs]], start[head[pairs]], b.sentence[head[pairs]]))]
        a, z = head[pairs], part[pairs]
        row, edge = ranges(first_edge[b.sentence[a]], first_edge[b.sentence[a] + 1] - 1)
        low, high = start[a][row], end[z][row]
        inside = lambda n: (start[n] >= low) & (end[n] <= high)
        x, y = root[b.src[edge]], root[b.dst[edge]]
        held = inside(y) & ~inside(x) & (y != a[row]) & (y != z[row])
        good = np.flatnonzero(np.bincount(row, held, len(a)) == 0)
        if not len(good):
            break
        good = good[np.unique(b.sentence[a[good]], return_index=True)[1]]
        row, token = ranges(b.begin[b.sentence[a[good]]], b.begin[b.sentence[a[good]] + 1] - 1)
        taken = (start[root[token]] >= start[a[good]][row]) & (end[root[token]] <= end[z[good]][row])
        root[token[taken]] = a[good][row[taken]]
        end[a[good]] = end[z[good]]
    return root


def prepare(b: Batch) -> Nodes:
    """Lemmas as texts, merged noun groups and names joined by ``of``, prepositions as edges, simple noun tags."""
    root = _merge_names(b, *_merged_nouns(b))
    heads, node = np.unique(root, return_inverse=True)
    # nodes in order of their first token, which is also their place
    first = np.full(len(heads), b.tokens)
    np.minimum.at(first, node, np.arange(b.tokens))
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(heads), np.int64)
    rank[order] = np.arange(len(heads))
    node, heads = rank[node], heads[order]
    size = np.bincount(node, minlength=len(heads))
    text = [b.lemma[t] for t in heads.tolist()]
    several = np.flatnonzero(size > 1)
    if len(several):
        by_node = np.lexsort((np.arange(b.tokens), node))
        edges = np.searchsorted(node[by_node], np.stack([several, several + 1]))
        for n, at, to in zip(several.tolist(), *edges.tolist(), strict=True):
            text[n] = " ".join(b.lemma[t] for t in by_node[at:to].tolist())
    src, dst, label, names = node[b.src], node[b.dst], b.code, list(b.names)
    keep = src != dst
    src, dst, label = _distinct(src[keep], dst[keep], label[keep])
    src, dst, label, names = _collapsed(src, dst, label, names, text)
    simple = {x: simplify_tag(x) for x in set(b.tag)}
    return Nodes(b.sentence[heads], np.array(text, dtype=str) if text else np.zeros(0, "U1"), np.array([simple[b.tag[t]] for t in heads.tolist()], dtype=str), src, dst, label, names)


def _distinct(src: np.ndarray, dst: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = np.unique(np.stack([src, dst, label], 1), axis=0) if len(src) else np.zeros((0, 3), np.int64)
    return one[:, 0], one[:, 1], one[:, 2]


def _collapsed(src, dst, label, names: list[str], text: list[str]):
    """prep and pobj edges over a preposition become one edge prep_X, where nothing else hangs below it."""
    number = {x: i for i, x in enumerate(names)}
    if "prep" not in number or "pobj" not in number:
        return src, dst, label, names
    n = len(text)
    down, objects = np.bincount(src, minlength=n), np.bincount(src[label == number["pobj"]], minlength=n)
    joint = (label == number["prep"]) & (objects[dst] > 0) & (objects[dst] == down[dst])
    over = np.unique(dst[joint])
    gone = joint | ((label == number["pobj"]) & member(src, over))
    below = np.flatnonzero((label == number["pobj"]) & member(src, over))
    below = below[np.argsort(src[below], kind="stable")]
    row, at = ranges(np.searchsorted(src[below], dst[joint]), np.searchsorted(src[below], dst[joint], "right") - 1)
    new = [f"prep_{text[p].lower()}" for p in dst[joint][row].tolist()]
    names = [*names, *dict.fromkeys(x for x in new if x not in number)]
    number = {x: i for i, x in enumerate(names)}
    made = np.array([number[x] for x in new], np.int64)
    return *_distinct(np.concatenate([src[~gone], src[joint][row]]), np.concatenate([dst[~gone], dst[below[at]]]), np.concatenate([label[~gone], made])), names


@dataclass
class Facts:
    """What is known of each sentence: the texts of both arguments, the words of the relation and all other words."""

    arg1: list[str]
    arg2: list[str]
    rel: list[list[str]]
    others: list[list[str]]


class _Words:
    """Texts of nodes and words of facts by number, with the vertices of every sentence."""

    def __init__(self, g: Nodes, sentences: int):
        self.g, self.number = g, {}
        self.code = codes(g.text.tolist(), self.number)
        used = np.zeros(len(g.text), bool)
        used[g.src] = used[g.dst] = True
        self.vertex = np.flatnonzero(used)
        self.first = np.searchsorted(g.sentence[self.vertex], np.arange(sentences + 1))

    def holding(self, sentence: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, node): the nodes of each sentence with its word as their text; else the one node whose text contains it."""
        row, at = ranges(self.first[sentence], self.first[sentence + 1] - 1)
        node = self.vertex[at]
        same = self.code[node] == codes(words, self.number)[row]
        found = np.zeros(len(words), bool)
        found[row[same]] = True
        rest = np.flatnonzero(~found[row])
        inside = rest[contains(self.g.text[node[rest]], words, row[rest])]
        once = np.bincount(row[inside], minlength=len(words)) == 1
        take = np.concatenate([np.flatnonzero(same), inside[once[row[inside]]]])
        take = take[np.lexsort((node[take], row[take]))]
        return row[take], node[take]


def contains(texts: np.ndarray, words: list[str], row: np.ndarray) -> np.ndarray:
    """Whether each text contains the word of its row."""
    return np.char.find(texts, np.array(words, dtype=str)[row]) >= 0 if len(row) else np.zeros(0, bool)


def _choices(known: _Words, f: Facts) -> tuple[np.ndarray, np.ndarray]:
    """(facts, places) nodes, a row for each way to choose a node for both arguments and each other word; -1 where a word
    has none. Facts without a node for an argument have no row."""
    sizes = np.array([2 + len(x) for x in f.others], np.int64)
    groups = [w for a, b, o in zip(f.arg1, f.arg2, f.others, strict=True) for w in (a, b, *o)]
    fact = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(groups)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, node = known.holding(fact, groups)
    # where nothing holds a text of several words, its last word that something holds stands for it
    missing = np.flatnonzero(np.bincount(row, minlength=len(groups)) == 0)
    parts = [(g, k, w) for g in missing.tolist() for k, w in enumerate(reversed(groups[g].split()))]
    if parts:
        owner, turn = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        r, n = known.holding(fact[owner], [p[2] for p in parts])
        best = np.full(len(groups), 1 << 30)
        np.minimum.at(best, owner[r], turn[r])
        use = turn[r] == best[owner[r]]
        row, node = np.concatenate([row, owner[r[use]]]), np.concatenate([node, n[use]])
    order = np.lexsort((node, row))
    row, node = row[order], node[order]
    many = np.bincount(row, minlength=len(groups))
    lost = np.unique(fact[(many == 0) & (place < 2)])
    owner = np.setdiff1d(np.arange(len(sizes)), lost)
    chosen = np.zeros((len(owner), 0), np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    first = np.concatenate([[0], np.cumsum(many)])
    for k in range(int(sizes[owner].max(initial=0))):
        group = begin[owner] + k
        here = k < sizes[owner]
        group = np.where(here, group, 0)
        some = here & (many[group] > 0)
        r, at = ranges(np.where(some, first[group], 0), np.where(some, first[group + 1] - 1, 0))
        new = np.where(some[r], node[np.minimum(at, len(node) - 1)] if len(node) else 0, -1)
        owner, chosen = owner[r], np.column_stack([chosen[r], new])
    return owner, chosen


def _climbs(g: Nodes, chosen: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By number of hops: (choice, nodes, edges, which of the choice's nodes it meets as bits) of all climbs from its nodes."""
    good = np.array([x not in ("punct", "dep") and re.fullmatch(r"\w+", x) is not None for x in g.names], bool)
    at = np.flatnonzero(good[g.label]) if len(g.label) else np.zeros(0, np.int64)
    up = Links(g.dst[at], g.src[at], at, len(g.text))
    places = chosen.shape[1]
    bit = lambda row, node: ((chosen[row] == node[:, None]) << np.arange(places)).sum(1)
    choice, node = [], []
    for k in range(places):
        again = (chosen[:, :k] == chosen[:, k : k + 1]).any(1)
        own = np.flatnonzero((chosen[:, k] >= 0) & ~again)
        choice.append(own)
        node.append(chosen[own, k])
    choice, nodes = np.concatenate(choice), np.concatenate(node)[:, None]
    edges, met = np.zeros((len(choice), 0), np.int64), bit(choice, nodes[:, 0])
    out = [(choice, nodes, edges, met)]
    for _ in range(longest):
        row, to, edge = up.hop(nodes[:, -1])
        fresh = (nodes[row] != to[:, None]).all(1)
        row, to, edge = row[fresh], to[fresh], edge[fresh]
        if not len(row):
            break
        choice, nodes, edges, met = choice[row], np.column_stack([nodes[row], to]), np.column_stack([edges[row], edge]), met[row] | bit(choice[row], to)
        out.append((choice, nodes, edges, met))
    return out


def induce(b: Batch, f: Facts, longest: int | None = None) -> tuple[np.ndarray, list[Pattern]]:
    """(sentence, pattern) of all paths over the words of each sentence's fact; ``longest`` bounds the nodes of a pattern.

    On the path arguments become {arg1} and {arg2}, words of the relation {rel} (or {rel0}, {rel1} ...) with their tags, and
    what is left {slotN}; a path is read from arg1 on. Patterns of a sentence are distinct.
    """
    g = prepare(b)
    known = _Words(g, b.sentences)
    owner, chosen = _choices(known, f)
    places = chosen.shape[1]
    # two words of one text at different places aren't a choice
    fit = np.ones(len(owner), bool)
    for k in range(places):
        for j in range(k):
            both = (chosen[:, j] >= 0) & (chosen[:, k] >= 0) & (chosen[:, j] != chosen[:, k])
            fit &= ~(both & (known.code[chosen[:, j]] == known.code[chosen[:, k]]))
    owner, chosen = owner[fit], chosen[fit]
    if not len(owner) or not len(g.src):
        return np.zeros(0, np.int64), []
    wanted = ((chosen >= 0) << np.arange(places)).sum(1)
    most = len(g.text) if longest is None else longest - 1
    climbs = _climbs(g, chosen, most)
    rows, found = [], []
    seen: dict[tuple, Pattern] = {}
    for left_size, left in enumerate(climbs):
        for right_size, right in enumerate(climbs):
            if not 0 < left_size + right_size <= most:
                continue
            a, z = _meeting(left, right, len(g.text))
            keep = (left[3][a] | right[3][z]) == wanted[left[0][a]]
            a, z = a[keep], z[keep]
            apart = np.ones(len(a), bool)
            for x in range(left_size + 1):
                for y in range(right_size + 1):
                    if (x, y) != (left_size, right_size):
                        apart &= left[1][a, x] != right[1][z, y]
            a, z = a[apart], z[apart]
            if len(a):
                nodes = np.column_stack([left[1][a], right[1][z][:, ::-1][:, 1:]])
                edges = np.column_stack([left[2][a], right[2][z][:, ::-1]])
                _read(g, known, f, owner[left[0][a]], nodes, edges, left_size, seen, rows, found)
    if not rows:
        return np.zeros(0, np.int64), []
    fact, pattern, end = np.concatenate(rows), np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found], 0)
    # a path that can be read from both of its ends is read from the first in order of place
    own, path = np.unique(np.column_stack([fact, end[:, 2], np.minimum(end[:, 0], end[:, 1]), np.maximum(end[:, 0], end[:, 1])]), axis=0, return_inverse=True)
    least = np.full(len(own), np.iinfo(np.int64).max)
    np.minimum.at(least, path.reshape(-1), end[:, 0])
    take = end[:, 0] == least[path.reshape(-1)]
    one = np.unique(np.column_stack([fact[take], pattern[take]]), axis=0)
    patterns = list(seen.values())
    return one[:, 0], [patterns[i] for i in one[:, 1].tolist()]


def _meeting(left, right, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both that belong to one choice and end in one node, having begun in different ones."""
    key = lambda x: x[0] * nodes + x[1][:, -1]
    order = np.argsort(key(right), kind="stable")
    there, here = key(right)[order], key(left)
    row, at = ranges(np.searchsorted(there, here), np.searchsorted(there, here, "right") - 1)
    other = order[at]
    differ = left[1][row, 0] != right[1][other, 0]
    return row[differ], other[differ]


def _read(g: Nodes, known: _Words, f: Facts, fact, nodes, edges, climbed: int, seen: dict, rows: list, found: list) -> None:
    """Turns paths (nodes and edges from left to right, the first ``climbed`` hops upward) into patterns."""
    n, width = nodes.shape
    code, tags = known.code[nodes], g.tag[nodes]
    valid = np.isin(tags, VALID_TAGS)
    flat, text = np.repeat(np.arange(n), width), g.text[nodes].reshape(-1)

    def among(words: list[list[str]]) -> np.ndarray:
        """Which nodes of a path have a text among the words of its fact."""
        of = np.repeat(np.arange(len(words)), [len(x) for x in words])
        keys = np.unique((of << 32) + codes([w for x in words for w in x], known.number))
        return member((fact[:, None] << 32) + code, keys)

    def place(words: list[str]) -> np.ndarray:
        """Where the argument stands: the node with that text, else one that contains it, else one that is a word of it."""
        tests = (code == codes(words, known.number)[fact][:, None], contains(text, [words[i] for i in fact.tolist()], flat).reshape(n, width), among([x.split() for x in words]))
        at = np.full(n, -1)
        for t in tests:
            hit = t & valid
            at = np.where((at < 0) & hit.any(1), hit.argmax(1), at)
        return at

    one, two = place(f.arg1), place(f.arg2)
    keep = np.flatnonzero((one == 0) & (two > 0))
    fact, nodes, edges, tags, two = fact[keep], nodes[keep], edges[keep], tags[keep], two[keep]
    code = code[keep]  # read by among()
    column = np.arange(width)
    inner = (column != 0) & (column != two[:, None])
    rel = among(f.rel) & inner
    some = np.flatnonzero(rel.any(1))
    fact, nodes, edges, tags, two, rel, inner = fact[some], nodes[some], edges[some], tags[some], two[some], rel[some], inner[some]
    if not len(fact):
        return
    kind = np.where(rel, 2, np.where(inner, 3, 0))
    kind[np.arange(len(kind)), two] = 1
    tag_names, tag_code = np.unique(tags, return_inverse=True)
    tag_code = np.where(inner, tag_code.reshape(tags.shape), -1)
    shape, which = np.unique(np.column_stack([kind, tag_code, g.label[edges]]), axis=0, return_inverse=True)
    number = np.empty(len(shape), np.int64)
    for i, x in enumerate(shape.tolist()):
        p = _pattern(x[:width], x[width : 2 * width], x[2 * width :], climbed, tag_names, g.names)
        number[i] = list(seen).index(str(p)) if str(p) in seen else len(seen)
        seen.setdefault(str(p), p)
    rows.append(fact)
    # a path is the set of its edges: its two readings have the same
    found.append((number[which.reshape(-1)], np.column_stack([nodes[:, 0], nodes[:, -1], _mixed(np.sort(edges, 1))])))


def _mixed(edges: np.ndarray) -> np.ndarray:
    """A number for each row of sorted edges."""
    out = np.zeros(len(edges), np.uint64)
    for k in range(edges.shape[1]):
        out = (out ^ edges[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.astype(np.int64)


def _pattern(kind: list[int], tag: list[int], label: list[int], climbed: int, tags: np.ndarray, names: list[str]) -> Pattern:
    several = kind.count(2) > 1
    counts = {2: 0, 3: 0}
    nodes = []
    for k, t in zip(kind, tag, strict=True):
        if k < 2:
            nodes.append(NodeMatcher("arg2" if k else "arg1"))
        else:
            alias = ("rel" if not several else f"rel{counts[2]}") if k == 2 else f"slot{counts[3]}"
            counts[k] += 1
            nodes.append(NodeMatcher(alias, str(tags[t])))
    return Pattern(tuple(nodes), tuple(EdgeMatcher(i < climbed, names[x]) for i, x in enumerate(label)))
