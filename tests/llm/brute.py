"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import re


def shingles(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def roots(ids: list, links: list[tuple]) -> dict:
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(rows: list[tuple[int, str | None]], similar: int = 85) -> dict[int, tuple[int, int]]:
    """id -> (set size, component)."""
    sets = {i: shingles(t) for i, t in rows}
    by: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    seen, links = set(), []
    for members in by.values():
        for k, a in enumerate(members):
            for b in members[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= similar * (len(sets[a]) + len(sets[b]) - both):
                        links.append((a, b))
    root = roots(list(sets), links)
    return {i: (len(sets[i]), root[i]) for i in sets}
