"""Vectorised splitting of UTF-8 text into pre-tokens of a byte-level BPE tokenizer.

Works on Arrow buffers: a batch of texts becomes one array of pre-tokens (byte slices, no Python strings),
which Arrow's exact dictionary encoding reduces to the distinct ones. Only those meet Python.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The endings that the pre-tokenizer's pattern splits off after an apostrophe.
ENDINGS_1 = ("s", "t", "m", "d")
ENDINGS_2 = ("re", "ve", "ll")


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point: letter (L), number (N), white space or other."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype(np.uint32)
    text = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, text):
            table[points[found.start() : found.end()]] = kind
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes -> (byte offset, code point) of each character."""
    lead = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32 if len(data) < 2**31 else np.int64)
    point = data[lead].astype(np.int32)
    wide = np.flatnonzero(point >= 0xC0)
    if len(wide):
        first, at = point[wide], lead[wide]
        tail = lambda k: data[at + k].astype(np.int32) & 0x3F
        value = ((first & 0x1F) << 6) | tail(1)
        for low, mask, more in ((0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
            long = np.flatnonzero(first >= low)
            if not len(long):
                break
            value[long] = first[long] & mask
            for k in range(1, more + 1):
                value[long] = (value[long] << 6) | (data[at[long] + k].astype(np.int32) & 0x3F)
        point[wide] = value
    return lead, point


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column (nulls count as empty) -> (bytes, offsets of its rows)."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def gpt_boundaries(lead: np.ndarray, point: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Character indices at which a pre-token of the byte-level pattern begins; rows never share one."""
    n = len(point)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[point]
    first = np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])
    row = np.zeros(n + 1, bool)
    row[first] = True
    row[n] = True
    start = np.empty(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[0] = start[n] = True
    start |= row
    runs = np.flatnonzero(start)
    begin, end = runs[:-1], runs[1:]
    inner = (kind[begin] == SPACE) & ~row[end]
    end = end[inner]
    start[end - 1] = True  # the last white space of a run stands alone ...
    start[end[point[end - 1] == 32]] = False  # ... or, as a blank, goes with what follows
    quote = np.flatnonzero(start[:n] & (point == 39))
    quote = quote[~row[quote + 1]]
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        one = np.isin(point[quote + 1], [ord(x) for x in ENDINGS_1])
        two = np.zeros(len(quote), bool)
        room = np.flatnonzero(~row[quote + 2])
        for x in ENDINGS_2:
            two[room] |= (point[quote[room] + 1] == ord(x[0])) & (point[quote[room] + 2] == ord(x[1]))
        for hit, width in ((quote[one], 1), (quote[two & ~one], 2)):
            start[hit + 1] = False
            start[hit + 1 + width] = True
    return np.flatnonzero(start[:n])


def slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray | None = None) -> pa.Array:
    """Byte slices of data as an Arrow binary array; without ``end`` each reaches to the next."""
    if end is None:
        edges = np.append(begin, len(data)).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    # both kinds of gap: alternate slices are taken
    edges = np.empty(2 * len(begin) + 1, np.int64)
    edges[0:-1:2], edges[1::2], edges[-1] = begin, end, end[-1] if len(end) else 0
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(begin), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    return whole.take(pa.array(np.arange(0, 2 * len(begin), 2)))


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Concatenates flat[starts[p] : starts[p] + sizes[p]] for each p of pick."""
    size = sizes[pick]
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(starts[pick], size)
    return flat[at]


def pieces_of(column: pa.Array, most: int = 8 << 20):
    """Row ranges of a column with about ``most`` bytes each; a longer row stands alone."""
    _, offsets = text_buffers(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, len(column))
        at = to
