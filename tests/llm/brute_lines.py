"""Repeated passages by plain search over lines."""

from __future__ import annotations

import re


def dedup(rows: list[tuple[int, str | None]], min_words: int = 50) -> dict[int, tuple[str | None, int, int]]:
    """id -> (text, lines, lines removed): least stretches of neighbouring worded lines with enough words, from each line on
    and up to each line; what stands at an earlier place too, not overlapping it, goes, with the blank lines inside."""
    docs = {}
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        docs[i] = lines, [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0d]", x)]
    places: dict[tuple[str, ...], list[tuple[int, int, int]]] = {}
    for i, (lines, worded) in docs.items():
        size = [len(re.findall(r"[^\x20\x09-\x0d]+", lines[k])) for k in worded]
        spans = set()
        for a in range(len(worded)):
            n, b = 0, a
            while b < len(worded) and n < min_words:
                n, b = n + size[b], b + 1
            if n >= min_words:
                spans.add((a, b - 1))
            n, b = 0, a
            while b >= 0 and n < min_words:
                n, b = n + size[b], b - 1
            if n >= min_words:
                spans.add((b + 1, a))
        for a, b in spans:
            places.setdefault(tuple(lines[worded[k]] for k in range(a, b + 1)), []).append((i, a, b))
    gone: dict[int, set[int]] = {i: set() for i in docs}
    for found in places.values():
        home = min(found)
        for i, a, b in found:
            if not (i == home[0] and a <= home[2]):
                gone[i] |= set(range(a, b + 1))
    out = {}
    for i, t in rows:
        lines, worded = docs[i]
        drop = {worded[k] for k in gone[i]}
        for k in gone[i]:
            if k + 1 in gone[i]:
                drop |= set(range(worded[k], worded[k + 1]))
        left = [x for k, x in enumerate(lines) if k not in drop]
        out[i] = (t if t is None or not drop else "\n".join(left)), len(lines), len(drop)
    return out
