"""The pipeline by dictionaries, searches and pairs: for small tables."""

from __future__ import annotations

import math
import zlib

import public_tokenizers
import regex

from factloom.llm.quality import BOILERPLATE
from factloom.llm.tokens import library

from . import brute, brute_lines
from .test_text import brute_quality, brute_scores


def language(rows, least=0.3, sure_after=12):
    """rows (doc_id, text, lang): those whose language is told, from words and n-grams of the documents that aren't held out."""
    learned = [(" ".join(regex.findall(r"\p{L}+", t.lower())), k) for i, t, k in rows if t is not None and k is not None and i is not None and zlib.crc32(str(i).encode()) % 5]
    languages = sorted({k for _, k in learned})
    bags = [regex.findall(r"\p{L}+", (t or "").lower()) for _, t, _ in rows]
    scores = brute_scores(learned, languages, {w for bag in bags for w in bag}) if languages else {}
    out = []
    for row, bag in zip(rows, bags, strict=True):
        if not bag:
            continue
        if languages:
            total = [sum(scores[w][j] for w in bag) / len(bag) * min(len(bag), sure_after) for j in range(len(languages))]
            share = 1 / sum(math.exp(x - max(total)) for x in total)
            if share < least:
                continue
        out.append(row)
    return out


def line_fails(line):
    n, letters = len(line), len(regex.findall(r"\p{L}", line))
    if not letters or 20 * sum(c in "#*$%&|<>" for c in line) >= n or ("!" in line and 20 * line.count("!") >= n):
        return True
    if not regex.search(r"\p{Ll}{2}", line) and regex.search(r"\p{Lu}{2}", line) and letters >= 20:
        return True
    return n < 200 and (any(x in line.lower() for x in BOILERPLATE) or not regex.search(r"[.!?:;…。！？»”’\"')\]]\s*$", line))


def quality(rows):
    out = []
    for i, text, k in rows:
        n, _, _, _, repeated = brute_quality(text)
        lines = text.split("\n")
        left = [x for x in lines if not line_fails(x)]
        chars = sum(map(len, lines))
        if n >= 10 and 100 * repeated <= 20 * n and chars and sum(map(len, left)) >= 0.5 * chars:
            out.append((i, "\n".join(left), k))
    return out


def lines(rows):
    done = brute_lines.dedup([r[:2] for r in rows])
    return [(i, done[i][0], k) for i, _, k in rows if not done[i][2] or regex.search(r"[^\x20\x09-\x0D]", done[i][0])]


def near(rows, similar=80):
    found = brute.near_duplicates([r[:2] for r in rows], similar)
    return [r for r in rows if found[r[0]][1] == r[0]]


def pieces(rows, capacity=2048):
    """doc_id, piece, start, length, checksum of all documents' tokens and their end."""
    code, out = library(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, text, _ in rows:
        ids = [*code.encode(text, add_special_tokens=False).ids, 0]
        at, size = 0, len(ids) % capacity or capacity
        for number in range(-(-len(ids) // capacity)):
            own = ids[at : at + size]
            out.append((i, number, at, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))))
            at, size = at + size, capacity
    return out


def kept(rows):
    return near(lines(quality(language(rows))))
