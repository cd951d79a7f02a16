"""Clauses turned into the other voice, for all sentences of a batch at once.

Every clause of a batch is a query with its own copy of the sentence's tokens. Insertions raise places by the number of
inserted tokens at or before them, an exchange moves two sets of tokens by one amount each, and offsets in the new text are
a running sum of lengths within each query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .batch import Batch, Pairs, member, ranges


@dataclass
class Clauses:
    """Queries: the verb, both sets that change sides, the edges that go (as keys query * edges + edge), and the new edges as
    (query, from, to, label), where tokens from ``tokens`` on are inserted ones: +0 was, +1 by."""

    verb: np.ndarray
    left: Pairs
    right: Pairs
    gone: np.ndarray
    new: tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]


def _first(b: Batch, label: str) -> np.ndarray:
    """For each token its first edge of that label, or -1. Edges are in order of their ends."""
    out = np.full(b.tokens, -1)
    at = np.flatnonzero(b.labelled((label,)))[::-1]
    out[b.src[at]] = at
    return out


def _edge_keys(b: Batch, *edges: np.ndarray) -> np.ndarray:
    n = len(edges[0])
    return np.unique(np.concatenate([np.arange(n) * max(1, len(b.src)) + e for e in edges]))


def _passive(b: Batch) -> Clauses:
    subject, thing = _first(b, "nsubj"), _first(b, "dobj")
    verb = np.flatnonzero((subject >= 0) & (thing >= 0) & b.verb)
    s, o = subject[verb], thing[verb]
    q, was, by = np.arange(len(verb)), np.full(len(verb), b.tokens), np.full(len(verb), b.tokens + 1)
    new = (np.concatenate([q] * 4), np.concatenate([verb, by, verb, verb]), np.concatenate([by, b.dst[s], was, b.dst[o]]), [x for x in ("prep", "pobj", "auxpass", "nsubjpass") for _ in verb])
    down = b.down()
    return Clauses(verb, b.reach(b.one(b.dst[s]), down), b.reach(b.one(b.dst[o]), down), _edge_keys(b, s, o), new)


def _active(b: Batch) -> Clauses:
    subject, helper = _first(b, "nsubjpass"), _first(b, "auxpass")
    named = np.array([x == "by" for x in b.text], bool)
    thing = _first(b, "pobj")
    prep = np.flatnonzero(b.labelled(("prep",)))
    prep = prep[named[b.dst[prep]] & (thing[b.dst[prep]] >= 0)]
    by = np.full(b.tokens, -1)
    by[b.src[prep[::-1]]] = prep[::-1]
    verb = np.flatnonzero((subject >= 0) & (helper >= 0) & (by >= 0))
    s, e = subject[verb], by[verb]
    agent = thing[b.dst[e]]
    q = np.arange(len(verb))
    new = (np.concatenate([q, q]), np.concatenate([verb, verb]), np.concatenate([b.dst[agent], b.dst[s]]), [x for x in ("nsubj", "dobj") for _ in verb])
    down = b.down()
    return Clauses(verb, b.reach(b.one(b.dst[s]), down), b.reach(b.one(b.dst[agent]), down), _edge_keys(b, s, helper[verb], e, agent), new)


def _turned(b: Batch, c: Clauses, passive: bool) -> tuple[np.ndarray, pa.Array]:
    """(sentence, graph) of the clauses whose sets stand one behind the other."""
    n = len(c.verb)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    own = b.sentence[c.verb]
    # tokens of each query, those that have an edge
    used = np.zeros(b.tokens, bool)
    used[b.src] = used[b.dst] = True
    query, token = ranges(b.begin[own], b.begin[own + 1] - 1)
    query, token = query[used[token]], token[used[token]]
    place = b.place[token]
    if passive:
        low = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(low, c.right.query, b.place[c.right.token])
        at = b.place[c.verb]  # was goes before the verb, by before the object
        place = place + (place >= at[query]) + (place >= low[query])
        query = np.concatenate([query, np.arange(n), np.arange(n)])
        token = np.concatenate([token, np.full(n, b.tokens), np.full(n, b.tokens + 1)])
        place = np.concatenate([place, at + (low <= at), low + (at <= low)])
    wide = b.tokens + 2
    key = query * wide + token
    order = np.argsort(key)
    key, query, token, place = key[order], query[order], token[order], place[order]
    # the last place of the left set and the first of the right one are exchanged, each set moved as a whole
    sides = [np.searchsorted(key, x.query * wide + x.token) for x in (c.left, c.right)]
    last, first = np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
    np.maximum.at(last, query[sides[0]], place[sides[0]])
    np.minimum.at(first, query[sides[1]], place[sides[1]])
    good = last < first
    step = np.where(good, first - last, 0)
    moved = place.copy()
    moved[sides[0]] += step[query[sides[0]]]
    moved[sides[1]] -= step[query[sides[1]]]
    # edges of the queries
    edge_sentence = b.sentence[b.src]
    eq, edge = ranges(np.searchsorted(edge_sentence, own), np.searchsorted(edge_sentence, own, "right") - 1)
    stay = ~member(eq * max(1, len(b.src)) + edge, c.gone)
    eq, edge = eq[stay], edge[stay]
    names = {x: i for i, x in enumerate(b.names)}
    added = np.array([names.setdefault(x, len(names)) for x in c.new[3]], np.int64)
    eq, src, dst = np.concatenate([eq, c.new[0]]), np.concatenate([b.src[edge], c.new[1]]), np.concatenate([b.dst[edge], c.new[2]])
    label = np.concatenate([b.code[edge], added])
    keep = good[eq]
    eq, src, dst, label = eq[keep], src[keep], dst[keep], label[keep]
    a, z = np.searchsorted(key, eq * wide + src), np.searchsorted(key, eq * wide + dst)
    # tokens in their new order, those without an edge gone; offsets in the new text
    live = np.zeros(len(key), bool)
    live[a] = live[z] = True
    texts, tags = np.array([*b.text, "was", "by"], dtype=str), np.array([*b.tag, "VBD", "IN"], dtype=str)
    row = np.flatnonzero(live)
    # tokens that meet in one place stand in order of text, or as they stood before where places are numbered anew
    row = row[np.lexsort((texts[token[row]] if passive else token[row], moved[row], query[row]))]
    size = np.char.str_len(texts[token[row]]) + 1
    before = np.cumsum(size) - size
    start = np.searchsorted(query[row], np.arange(n))
    offset = before - before[np.minimum(start[query[row]], len(row) - 1)]
    if not passive:  # without gaps
        moved[row] = np.arange(len(row)) - start[query[row]]
    rank, offsets = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    rank[row], offsets[row] = np.arange(len(row)), offset
    word = np.array(sorted(names, key=names.get), dtype=str)
    by_name = np.argsort(np.argsort(word))
    one = np.unique(np.column_stack([eq, moved[a], moved[z], by_name[label], rank[a], rank[z], label, a, z]), axis=0)
    eq, label, a, z = one[:, 0], one[:, 6], one[:, 7], one[:, 8]

    def node(i: np.ndarray) -> pa.Array:
        number = lambda x: pa.array(x).cast(pa.string())
        return pc.binary_join_element_wise(pa.array(texts[token[i]]), pa.array(tags[token[i]]), number(moved[i]), number(offsets[i]), "_")

    parts = pc.binary_join_element_wise(pa.array(word[label]), "(", node(a), ", ", node(z), ")", "")
    found = np.flatnonzero(np.bincount(eq, minlength=n) > 0)
    edges = np.searchsorted(eq, np.append(found, n))
    graphs = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), parts), "; ")
    return own[found], graphs


def switched(b: Batch) -> tuple[np.ndarray, pa.Array]:
    """(sentence, graph) for each clause of a batch that can be turned: active ones with a subject and an object, passive
    ones with a subject, an auxiliary and an agent behind ``by``.

    ``was`` goes before the verb and ``by`` before the object, and places from there on move up; in the other direction both
    go and places are numbered anew. A clause whose two sides overlap or stand the other way round is left alone.
    """
    parts = [_turned(b, _passive(b), True), _turned(b, _active(b), False)] if len(b.src) else []
    if not parts:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    return np.concatenate([p[0] for p in parts]), pa.concat_arrays([p[1].cast(pa.string()) for p in parts])
