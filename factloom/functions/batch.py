"""Many sentences at once: flat arrays of tokens and edges, and set algebra over (query, token) pairs.

Tokens of all sentences of an Arrow batch are numbered through, in order of sentence and place, so a stretch of tokens is
a range of numbers. A set of tokens for each of many queries is one sorted array of keys ``query * tokens + token``;
closures advance all queries together, one hop at a time, and intersections, spans and blocked walks are array
operations. Nothing is a matrix, so memory follows the results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import product

import numpy as np
import pyarrow as pa

from .graph import Graph, lemma
from .patterns import EdgeMatcher, NodeMatcher, Pattern

#: Labels that widen a noun, labels of clauses that belong to an argument, labels of what attaches to a verb.
NOUN_LABELS = ("det", "prep_of", "amod", "num", "number", "nn", "poss", "quantmod", "neg")
CLAUSE_LABELS = ("rcmod", "infmod", "partmod", "ref", "prepc_of")
VERB_LABELS = ("aux", "cop", "auxpass", "prt", "acomp")

_lemma = lru_cache(1 << 16)(lemma)


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which keys occur in a sorted array."""
    if not len(among):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for all numbers first..last of each row, both included."""
    size = np.maximum(last - first + 1, 0)
    row = np.repeat(np.arange(len(first)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + first[row]


class Links:
    """Edges as (from, to, number of the edge), sorted by where they start."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, edge: np.ndarray, tokens: int):
        order = np.lexsort((edge, src))
        self.dst, self.edge = dst[order], edge[order]
        self.first = np.searchsorted(src[order], np.arange(tokens + 1))

    def hop(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of node, reached token, edge) for every edge that starts at one of the nodes."""
        row, at = ranges(self.first[node], self.first[node + 1] - 1)
        return row, self.dst[at], self.edge[at]


@dataclass
class Pairs:
    """Tokens of queries, as sorted distinct keys."""

    keys: np.ndarray
    tokens: int

    @property
    def query(self) -> np.ndarray:
        return self.keys // self.tokens

    @property
    def token(self) -> np.ndarray:
        return self.keys % self.tokens

    def __or__(self, other: Pairs) -> Pairs:
        return Pairs(np.union1d(self.keys, other.keys), self.tokens)

    def __sub__(self, other: Pairs) -> Pairs:
        return Pairs(self.keys[~member(self.keys, other.keys)], self.tokens)

    def __and__(self, other: Pairs) -> Pairs:
        return Pairs(self.keys[member(self.keys, other.keys)], self.tokens)

    def where(self, keep: np.ndarray) -> Pairs:
        return Pairs(self.keys[keep], self.tokens)

    def pick(self, queries: np.ndarray) -> Pairs:
        """The sets of the given queries, numbered anew in their order; a query may be picked often."""
        edges = np.searchsorted(self.keys, np.stack([queries, queries + 1]) * self.tokens)
        row, at = ranges(edges[0], edges[1] - 1)
        return Pairs(row * self.tokens + self.keys[at] % self.tokens, self.tokens)

    def merged(self, owner: np.ndarray) -> Pairs:
        """Sets of queries united by owner."""
        return Pairs(np.unique(owner[self.query] * self.tokens + self.token), self.tokens)

    def bounds(self, queries: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last token of each query's set; (0, -1) for an empty set."""
        low, high = np.zeros(queries, np.int64), np.full(queries, -1)
        edges = np.searchsorted(self.keys, np.arange(queries + 1) * self.tokens)
        full = np.flatnonzero(np.diff(edges) > 0)
        low[full], high[full] = self.keys[edges[full]] % self.tokens, self.keys[edges[full + 1] - 1] % self.tokens
        return low, high

    def filled(self, queries: int) -> Pairs:
        """Each set widened to all tokens between its first and its last."""
        row, token = ranges(*self.bounds(queries))
        return Pairs(row * self.tokens + token, self.tokens)

    def lists(self, queries: int) -> list[list[int]]:
        edges = np.searchsorted(self.keys, np.arange(queries + 1) * self.tokens).tolist()
        token = self.token.tolist()
        return [token[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Batch:
    """Sentences as flat arrays. Tokens come in order of place; an edge whose end isn't a token is left out."""

    def __init__(self, sizes, place, end, text, tag, lemmas, offset, edge_sizes, src, dst, label):
        sizes, place = np.asarray(sizes, np.int64), np.asarray(place, np.int64)
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((place, sentence))
        own = order.tolist()
        pick = (lambda x: list(x)) if own == list(range(len(own))) else lambda x: [x[i] for i in own]
        self.sentences, self.tokens = len(sizes), len(order)
        self.sentence, self.place, self.end, self.offset = sentence[order], place[order], np.asarray(end, np.int64)[order], np.asarray(offset, np.int64)[order]
        self.text, self.tag = pick(text), pick(tag)
        self.lemma = pick(lemmas) if lemmas is not None else [_lemma(x) for x in self.text]
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        key = (self.sentence << 32) + self.place
        edge_sentence = np.repeat(np.arange(len(sizes)), np.asarray(edge_sizes, np.int64))
        ends = []
        known = np.ones(len(edge_sentence), bool)
        for x in (src, dst):
            want = (edge_sentence << 32) + np.asarray(x, np.int64)
            at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            known &= key[at] == want if len(key) else False
            ends.append(at)
        names = sorted({str(x) for x in label})
        number = {x: i for i, x in enumerate(names)}
        code = np.array([number[str(x)] for x in label], np.int64)
        keep = np.flatnonzero(known)
        rank = keep[np.lexsort((code[keep], ends[1][keep], ends[0][keep]))]
        self.src, self.dst, self.code, self.names = ends[0][rank], ends[1][rank], code[rank], names
        self.number = number

    @staticmethod
    def of(graphs: list[Graph]) -> Batch:
        nodes = [n for g in graphs for n in g.nodes]
        edges = [e for g in graphs for e in g.edges]
        return Batch(
            [len(g.nodes) for g in graphs], [n.start for n in nodes], [n.end for n in nodes], [n.text for n in nodes], [n.postag for n in nodes], [n.lemma for n in nodes], [n.offset for n in nodes],
            [len(g.edges) for g in graphs], [e.src.start for e in edges], [e.dst.start for e in edges], [e.label for e in edges],
        )

    @staticmethod
    def of_arrow(tokens: pa.Array, deps: pa.Array, lemmas: Callable[[list[str]], list[str]] | None = None) -> Batch:
        """From list columns of structs (idx, text, postag, offset) and (label, src, dst); null lists are empty sentences.
        ``lemmas`` gives the lemmas of all texts at once (see functions.lemmas); without it the word rules do."""
        t, d = tokens.flatten(), deps.flatten()
        size = lambda column: np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
        ints = lambda a: a.to_numpy(zero_copy_only=False)
        place = ints(t.field("idx"))
        text = t.field("text").to_pylist()
        return Batch(size(tokens), place, place + 1, text, t.field("postag").to_pylist(), None if lemmas is None else lemmas(text), ints(t.field("offset")), size(deps), ints(d.field("src")), ints(d.field("dst")), d.field("label").to_pylist())

    def has(self, test) -> np.ndarray:
        """Tokens whose tag passes the test."""
        known = {x: bool(test(x)) for x in set(self.tag)}
        return np.array([known[x] for x in self.tag], bool)

    @cached_property
    def proper(self) -> np.ndarray:
        return self.has(lambda x: x in ("NNP", "NNPS"))

    @cached_property
    def verb(self) -> np.ndarray:
        return self.has(lambda x: x.startswith("VB"))

    def labelled(self, labels) -> np.ndarray:
        """Which edges have one of the labels (a tuple), or pass a test on the label (a function)."""
        good = np.array([labels(x) if callable(labels) else x in labels for x in self.names], bool)
        return good[self.code] if len(good) else np.zeros(0, bool)

    def down(self, keep: np.ndarray | None = None) -> Links:
        at = np.arange(len(self.src)) if keep is None else np.flatnonzero(keep)
        return Links(self.src[at], self.dst[at], at, self.tokens)

    def up(self, keep: np.ndarray) -> Links:
        at = np.flatnonzero(keep)
        return Links(self.dst[at], self.src[at], at, self.tokens)

    def both_ways(self, keep: np.ndarray) -> Links:
        at = np.flatnonzero(keep)
        return Links(np.concatenate([self.src[at], self.dst[at]]), np.concatenate([self.dst[at], self.src[at]]), np.concatenate([at, at]), self.tokens)

    def one(self, node: np.ndarray) -> Pairs:
        return Pairs(np.arange(len(node)) * self.tokens + node, self.tokens)

    def nothing(self) -> Pairs:
        return Pairs(np.zeros(0, np.int64), self.tokens)

    def reach(self, start: Pairs, links: Links, allowed=None) -> Pairs:
        """The closure of every query's set over the links; allowed(query, token, edge) may rule out single steps."""
        known = front = start.keys
        while len(front):
            row, token, edge = links.hop(front % self.tokens)
            query = front[row] // self.tokens
            if allowed is not None:
                ok = allowed(query, token, edge)
                query, token = query[ok], token[ok]
            found = np.unique(query * self.tokens + token)
            front = found[~member(found, known)]
            known = np.union1d(known, front)
        return Pairs(known, self.tokens)

    # walks and expansions ---------------------------------------------------------------------------------------------

    def unblocked(self, node: np.ndarray, among: Pairs, until: Pairs) -> Pairs:
        """What lies between the nearest blocked members of ``among`` left and right of each node, filled without gaps."""
        n = len(node)
        stop = among & until
        left, right = np.full(n, -1), np.full(n, self.tokens)
        before = stop.token < node[stop.query]
        after = stop.token > node[stop.query]
        np.maximum.at(left, stop.query[before], stop.token[before])
        np.minimum.at(right, stop.query[after], stop.token[after])
        inside = among.where((among.token > left[among.query]) & (among.token < right[among.query]))
        return inside.filled(n)

    def touching(self, node: np.ndarray, until: Pairs, labels: tuple[str, ...]) -> Pairs:
        """The island of neighbouring tokens around each node among what hangs below it by the labels."""
        below = self.reach(self.one(node), self.down(self.labelled(labels)))
        own = Pairs(np.arange(len(node)) * self.tokens + node, self.tokens)
        below = (below - until) | own
        q, t = below.query, below.token
        joined = np.zeros(len(q), bool)
        joined[1:] = (q[1:] == q[:-1]) & (t[1:] == t[:-1] + 1) & (self.place[t[1:]] == self.end[t[:-1]])
        island = np.cumsum(~joined)
        home = island[np.searchsorted(below.keys, own.keys)]
        return below.where(island == home[q])

    def widened(self, node: np.ndarray, until: Pairs, labels) -> Pairs:
        """Each node with what the labels hang below it and what nn edges connect it to, up to blocked tokens."""
        start = self.one(node)
        group = self.reach(start, self.down(self.labelled(labels))) | self.reach(start, self.both_ways(self.labelled(("nn",))))
        return self.unblocked(node, group, until)

    def subtrees(self, node: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, Pairs]:
        """(query of each child over one of the edges, all below that child)."""
        row, child, _ = self.down(edges).hop(node)
        return row, self.reach(self.one(child), self.down())

    def clauses(self, node: np.ndarray, labels: tuple[str, ...], without: Pairs, nested: bool) -> tuple[np.ndarray, Pairs]:
        """(query, tokens) of every stretch that hangs below a node by one of the labels and doesn't touch ``without``.

        A stretch never climbs back to its node, nor over a conjunction to the head of another one, and passes further
        edges of the labels only if ``nested``.
        """
        mine = self.labelled(labels)
        row, head, _ = self.down(mine).hop(node)
        heads = np.unique(row * self.tokens + head)
        conj = self.labelled(lambda x: x.startswith("conj"))

        def allowed(query, token, edge):
            owner = row[query]
            other = conj[edge] & member(owner * self.tokens + token, heads)
            return (token != node[owner]) & ~other & (nested | ~mine[edge])

        below = self.reach(self.one(head), self.down(), allowed)
        hit = np.zeros(len(row), bool)
        hit[below.query[member(row[below.query] * self.tokens + below.token, without.keys)]] = True
        good = np.flatnonzero(~hit)
        return row[good], below.pick(good).filled(len(good))

    def arguments(self, node: np.ndarray, until: Pairs) -> Pairs:
        """The tokens of an argument around each node: a noun with what widens it and, unless it has a proper noun, its
        clauses; nouns joined by and / or become one stretch."""
        conj = self.both_ways(self.labelled(("conj_and", "conj_or")))
        joined = self.reach(self.one(node), conj, lambda query, token, edge: ~self.verb[token])
        owner, each = joined.query, joined.token
        blocked = until.pick(owner)
        own = self.widened(each, blocked, NOUN_LABELS)
        named = np.zeros(len(each), bool)
        named[own.query[self.proper[own.token]]] = True
        plain = np.flatnonzero(~named)
        of, clause = self.clauses(each[plain], CLAUSE_LABELS, blocked.pick(plain), False)
        own = own | clause.merged(plain[of]) if len(of) else own
        whole = own.merged(owner)
        several = np.bincount(owner, minlength=len(node)) > 1
        return whole.where(~several[whole.query]) | whole.where(several[whole.query]).filled(len(node))

    def relations(self, node: np.ndarray, until: Pairs) -> list[list[tuple[list[int], str]]]:
        """For each node the forms of its relation, one for each pair of direct and indirect object: (tokens, text).

        The text has the pieces in order of place: the widened node, what attaches to it or to the verb it is the
        predicate of, and the objects. A relative pronoun doesn't make a piece.
        """
        n, nouns = len(node), self.has(lambda x: x.startswith("NN"))[node] if len(node) else np.zeros(0, bool)
        no_of = tuple(x for x in NOUN_LABELS if x != "prep_of")
        own = self.nothing()
        for at, labels in ((np.flatnonzero(nouns), NOUN_LABELS), (np.flatnonzero(~nouns), no_of)):
            if len(at):
                own = own | self.widened(node[at], until.pick(at), labels).merged(at)
        adverb = self.has(lambda x: x == "RB")
        attach = self.labelled(VERB_LABELS)
        loose = self.labelled(("advmod",))
        attach = attach | (loose & adverb[self.dst]) if len(self.src) else attach
        pieces: list[list[list[int]]] = [[] for _ in range(n)]
        rest: list[list[list[int]]] = [[x] for x in own.lists(n)]
        # what attaches to the node itself, without what it already has
        row, below = self.subtrees(node, attach & (self.src != self.dst))
        for q, tokens in zip(row.tolist(), (below - own.pick(row)).lists(len(row)), strict=True):
            rest[q].append(tokens)
        # what attaches to the token that the node is the copula of
        row, head, _ = self.up(self.labelled(("cop",))).hop(node)
        if len(row):
            first = np.unique(row, return_index=True)[1]
            row, head = row[first], head[first]
            of, child, _ = self.down(attach).hop(head)
            keep = child != node[row[of]]
            under = self.reach(self.one(child[keep]), self.down())
            for q, tokens in zip(row[of[keep]].tolist(), under.lists(int(keep.sum())), strict=True):
                pieces[q].append(tokens)
        objects = []
        for label in ("dobj", "iobj"):
            of, found = self.clauses(node, (label,), until, True)
            options: list[list[list[int]]] = [[] for _ in range(n)]
            for q, tokens in zip(of.tolist(), found.lists(len(of)), strict=True):
                options[q].append(tokens)
            objects.append([x or [[]] for x in options])
        out = []
        for q in range(n):
            forms: dict[tuple[tuple[int, ...], str], None] = {}
            for direct, other in product(objects[0][q], objects[1][q]):
                more = [x for x in (*rest[q], direct, other) if x and not (len(x) == 1 and self.tag[x[0]] == "WP")]
                groups = sorted([*pieces[q], *more], key=lambda x: (x[0], x[-1]))
                if groups:
                    tokens = tuple(sorted({t for x in groups for t in x}))
                    forms[tokens, " ".join(self.words(x) for x in groups)] = None
            out.append([(list(tokens), text) for tokens, text in forms])
        return out

    def words(self, tokens) -> str:
        return " ".join(self.text[t] for t in tokens)

    # matching ---------------------------------------------------------------------------------------------------------

    def _nodes(self, m: NodeMatcher) -> np.ndarray | None:
        """Which tokens a node matcher takes; None for all."""
        key = (m.postag, m.regex)
        if key == (None, None):
            return None
        if key not in self._node_cache:
            ok = np.ones(self.tokens, bool) if m.postag is None else self.has(lambda x: x == m.postag)
            if m.regex is not None:
                good = {x: m.matches_lemma(x) for x in set(self.lemma)}
                ok = ok & np.array([good[x] for x in self.lemma], bool)
            self._node_cache[key] = ok
        return self._node_cache[key]

    @cached_property
    def _node_cache(self) -> dict:
        return {}

    @cached_property
    def _link_cache(self) -> dict:
        return {}

    def _links(self, m: EdgeMatcher) -> Links | None:
        key = (m.up, m.label if m.regex is None else None, m.regex)
        if key not in self._link_cache:
            good = {x for x in self.names if m.capture(x) is not None}
            at = self.labelled(tuple(good)) if good else None
            self._link_cache[key] = None if at is None else self.up(at) if m.up else self.down(at)
        return self._link_cache[key]

    def matches(self, p: Pattern, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(rows, nodes) tokens and (rows, edges) edges of all paths of the batch that the pattern matches."""
        links = [self._links(e) for e in p.edges]
        none = np.zeros((0, len(p.nodes)), np.int64), np.zeros((0, len(p.edges)), np.int64)
        if any(x is None for x in links) or not links:
            return none
        # all sources of the first edge's links
        first = links[0].first
        at = np.flatnonzero(np.diff(first) > 0)
        ok = self._nodes(p.nodes[0])
        nodes = (at if ok is None else at[ok[at]])[:, None]
        edges = np.zeros((len(nodes), 0), np.int64)
        for k, link in enumerate(links):
            row, token, edge = link.hop(nodes[:, -1])
            good = np.ones(len(row), bool)
            ok = self._nodes(p.nodes[k + 1])
            if ok is not None:
                good &= ok[token]
            if distinct:
                good &= (nodes[row] != token[:, None]).all(1)
            row, token, edge = row[good], token[good], edge[good]
            nodes, edges = np.column_stack([nodes[row], token]), np.column_stack([edges[row], edge])
            if not len(row):
                return none
        return nodes, edges

    def captures(self, p: Pattern, nodes: np.ndarray, edges: np.ndarray) -> dict[str, str]:
        """What a match caught: texts of the nodes by alias, and labels (or their first group) by the alias of an edge."""
        out = {m.alias: self.text[t] for m, t in zip(p.nodes, nodes, strict=True)}
        for m, e in zip(p.edges, edges, strict=True):
            if m.regex is not None:
                out[m.label] = m.capture(self.names[self.code[e]])
        return out

