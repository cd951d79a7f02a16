"""Edit distances between all strings of two blocks, computed once for what their beginnings share."""

from __future__ import annotations

import numpy as np

#: Cells of the table of distances that are held at a time, of one byte each.
CELLS = 1 << 24


class Tree:
    """The distinct beginnings of strings by length. In sorted order neighbours share theirs; in any other order some
    beginnings stand there more than once, and nothing else changes."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts])
        width = int(self.sizes.max(initial=0))
        codes = np.frombuffer("".join(t.ljust(width) for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), width).copy()
        codes[np.arange(width) >= self.sizes[:, None]] = 0xFFFFFFFF  # no letter
        fresh = np.ones(codes.shape, bool)
        fresh[1:] = np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1)
        #: of each length from 1 on, the place of each beginning's own beginning in the length before, and its last letter
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        #: of each string, its place among the beginnings of its length
        self.ends = np.zeros(len(texts), np.int64)
        for i in range(width):
            new = fresh[:, i] & (self.sizes > i)
            self.levels.append((self.ends[new], codes[new, i]))
            self.ends = np.where(self.sizes > i, np.cumsum(new) - 1, self.ends)

    def __len__(self) -> int:
        return 1 + sum(len(letters) for _, letters in self.levels)


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances, a row for each string of a and a column for each of b; no string has more than 250 letters.

    The usual table, whose rows and columns are the beginnings of two strings, has one cell for each pair of distinct
    beginnings of the blocks: all beginnings of two lengths are one array, which follows from those one letter shorter.
    """
    columns = Tree(b)
    most = max(1, CELLS // len(columns))
    return np.concatenate([_distances(Tree(a[at : at + most]), columns) for at in range(0, len(a), most)]) if a else np.zeros((0, len(b)), np.uint8)


def _distances(rows: Tree, columns: Tree) -> np.ndarray:
    out = np.empty((len(rows.sizes), len(columns.sizes)), np.uint8)
    ends = [(j, at := np.flatnonzero(columns.sizes == j), columns.ends[at]) for j in np.unique(columns.sizes)]
    last = [np.zeros((1, 1), np.uint8), *[np.full((1, len(letters)), j, np.uint8) for j, (_, letters) in enumerate(columns.levels, 1)]]
    for i in range(len(rows.levels) + 1):
        if i:
            above, own = rows.levels[i - 1]
            now = [np.full((len(own), 1), i, np.uint8)]
            for j, (left, letters) in enumerate(columns.levels):
                cell = last[j][:, left].take(above, 0)
                cell += own[:, None] != letters
                step = np.minimum(last[j + 1].take(above, 0), now[j][:, left])
                step += 1
                now.append(np.minimum(cell, step, out=cell))
            last = now
        done = np.flatnonzero(rows.sizes == i)
        if len(done):
            for j, at, end in ends:
                found = last[j].take(rows.ends[done], 0)
                if np.array_equal(end, np.arange(out.shape[1])) and found.shape[1] == out.shape[1]:  # sorted, of one length, each another: in place
                    out[done] = found
                else:
                    out[np.ix_(done, at)] = found[:, end]
    return out
