"""SentencePiece models in batched numpy: encoding and decoding of whole texts.

Distinct words of equal length advance together. Prefix hashes give the hash of every substring, which is looked up in
the sorted hashes of the pieces. For unigram models a Viterbi pass takes vectorised maxima and stores backpointers. For
BPE models the best segmentation isn't what the library returns (it merges greedily by rank), so the same tables drive
rounds of merges instead: in each round every word of the batch merges its best pair.
"""

from __future__ import annotations

import functools
import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens as P
from .common import free
from .shingles import mix

BLANK = 0x2581
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Fixed value: what an unknown character costs below the worst piece.
UNKNOWN_COST = 10.0
#: Longer words leave the batches: one at a time, with a heap (BPE) or by the same passes over sparse tables (unigram).
LONG = 96
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _fields(raw: bytes):
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = raw[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    while at < len(raw):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield number, raw[at : at + size]
        at += size


class Model:
    """Pieces, scores and switches of a model file. Normalisation other than identity isn't supported and raises."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores, self.kind, rule = [], UNIGRAM, {}
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode("utf-8"))
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rule = dict(_fields(value))
        if self.kind not in (UNIGRAM, BPE) or rule.get(2) or rule.get(4, 1) or not rule.get(5, 1):
            raise NotImplementedError("only unigram and BPE models with identity normalisation are supported")
        if USER in self.kinds or UNUSED in self.kinds or any("▁" in p.lstrip("▁") for p, k in zip(self.pieces, self.kinds, strict=True) if k == NORMAL):
            raise NotImplementedError("user-defined and unused pieces, and blanks inside pieces, aren't supported")
        self.prefix = bool(rule.get(3, 1))
        self.scores = np.array(scores, np.float32)
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = np.full(256, self.unknown, np.int64)
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        normal = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        self.widest = max(len(self.pieces[i]) for i in normal)
        keys = np.array([self.hash_of(self.pieces[i]) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int64)[order]
        self.index = {self.pieces[i]: i for i in normal}
        worst = float(self.scores[normal].min())
        self.unknown_score = worst - UNKNOWN_COST
        # decoding: the bytes of every piece
        body = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace("▁", " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.body_size = np.array([len(b) for b in body], np.int64)
        self.body = np.frombuffer(b"".join(body), np.uint8)
        self.body_at = np.cumsum(self.body_size) - self.body_size

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for ch in piece:
            h = (h * int(BASE) + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
        return int(mix(np.array([h ^ len(piece)], np.uint64))[0])

    def tables(self, words: np.ndarray) -> np.ndarray:
        """(n, L) code points -> piece of words[:, i : i + k + 1] or -1, for all i and k < widest."""
        n, length = words.shape
        prefix = np.zeros((n, length + 1), np.uint64)
        for i in range(length):
            prefix[:, i + 1] = prefix[:, i] * BASE + (words[:, i].astype(np.uint64) + np.uint64(1))
        found = np.full((n, length, self.widest), -1, np.int32)
        power = 1
        for k in range(min(self.widest, length)):
            power = power * int(BASE) & 0xFFFFFFFFFFFFFFFF
            h = mix((prefix[:, k + 1 :] - prefix[:, : length - k] * np.uint64(power)) ^ np.uint64(k + 1))
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            found[:, : length - k, k] = np.where(self.keys[at] == h, self.ids[at], -1)
        return found

    def merge(self, words: np.ndarray) -> np.ndarray:
        """BPE: (n, L) -> ends[n, i]: end of the symbol that begins at i, or 0."""
        n, length = words.shape
        table = self.tables(words)
        score = np.where(table >= 0, self.scores[np.maximum(table, 0)], -np.inf).astype(np.float32)
        ends = np.tile(np.arange(1, length + 1), (n, 1))
        out = ends.copy()
        live = np.arange(n)
        place = np.arange(length)
        while len(live) and length > 1:
            e = ends
            after = np.where((e > 0) & (e < length), np.take_along_axis(e, np.minimum(e, length - 1), 1), 0)
            width = after - place
            ok = (after > 0) & (width <= self.widest)
            value = np.where(ok, np.take_along_axis(score, np.clip(width - 1, 0, self.widest - 1)[:, :, None], 2)[:, :, 0], -np.inf)
            best = value.argmax(1)  # ties: the leftmost
            rows = np.arange(len(live))
            good = value[rows, best] > -np.inf
            done = ~good
            out[live[done]] = ends[done]
            rows, best = rows[good], best[good]
            gone = ends[rows, best]
            ends[rows, best] = after[rows, best]
            ends[rows, gone] = 0
            ends, live, score = ends[good], live[good], score[good] if done.any() else score
        return out

    def viterbi(self, words: np.ndarray) -> np.ndarray:
        """Unigram: as merge()."""
        n, length = words.shape
        table = self.tables(words)
        score = np.where(table >= 0, self.scores[np.maximum(table, 0)], -np.inf).astype(np.float32)
        single = score[:, :, 0]
        score[:, :, 0] = np.where(np.isinf(single), np.float32(self.unknown_score), single)
        best = np.full((n, length + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back = np.zeros((n, length + 1), np.int32)
        for j in range(1, length + 1):
            most = min(self.widest, j)
            # widths from the widest down: of equal sums the longer last piece stands
            options = np.stack([best[:, j - k] + score[:, j - k, k - 1] for k in range(most, 0, -1)], 1)
            pick = options.argmax(1)
            best[:, j] = options[np.arange(n), pick]
            back[:, j] = j - (most - pick)
        ends = np.zeros((n, length), np.int64)
        at = np.full(n, length)
        live = np.arange(n)
        while len(live):
            before = back[live, at[live]]
            ends[live, before] = at[live]
            at[live] = before
            live = live[before > 0]
        return ends

    def merge_long(self, word: str) -> list[str]:
        """BPE of one long word with a heap of pairs."""
        part = list(word)
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (at := self.index.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-float(self.scores[at]), i, j, part[i] + part[j]))

        for i in range(len(part) - 1):
            push(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not part[i] or not part[j] or right[i] != j or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(left[i], i)
            push(i, right[i])
        return [p for p in part if p]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words (UTF-8, blanks as U+0020) -> (flat ids, ids of each word)."""
        data, offsets = P.text_buffers(words.cast(pa.large_string()))
        lead, point = P.code_points(data)
        point = np.where(point == 32, BLANK, point)
        begin = np.searchsorted(lead, offsets)
        sizes = np.diff(begin)
        step = self.merge if self.kind == BPE else self.viterbi
        owner, order, ids = [], [], []
        for length in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == length)
            if length > LONG and self.kind == BPE:
                for r in rows.tolist():
                    symbols = self.merge_long("".join(map(chr, point[begin[r] : begin[r + 1]].tolist())))
                    flat = [x for s in symbols for x in ([self.index[s]] if s in self.index else self.bytes[list(s.encode("utf-8"))].tolist())]
                    owner.append(np.full(len(flat), r))
                    order.append(np.arange(len(flat)))
                    ids.append(np.array(flat, np.int64))
                continue
            block = max(1, 2_000_000 // (length * self.widest))
            for at in range(0, len(rows), block):
                mine = rows[at : at + block]
                chars = point[begin[mine][:, None] + np.arange(length)]
                ends = step(chars)
                r, i = np.nonzero(ends)
                width = ends[r, i] - i
                piece = np.full(len(r), -1, np.int64)
                # ids of the chosen symbols: their hashes once more, by width
                for k in np.unique(width).tolist():
                    some = np.flatnonzero(width == k)
                    h = np.zeros(len(some), np.uint64)
                    for q in range(k):
                        h = h * BASE + (chars[r[some], i[some] + q].astype(np.uint64) + np.uint64(1))
                    h = mix(h ^ np.uint64(k))
                    place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                    piece[some] = np.where(self.keys[place] == h, self.ids[place], -1)
                known = np.flatnonzero(piece >= 0)
                owner.append(mine[r[known]])
                order.append(i[known] * 4)
                ids.append(piece[known])
                odd = np.flatnonzero(piece < 0)  # single characters that no piece has: their bytes
                if len(odd):
                    for x in odd.tolist():
                        raw = list(chr(int(chars[r[x], i[x]])).encode("utf-8"))
                        owner.append(np.full(len(raw), mine[r[x]]))
                        order.append(i[x] * 4 + np.arange(len(raw)))
                        ids.append(self.bytes[raw])
        if not owner:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        own, place, flat = np.concatenate(owner), np.concatenate(order), np.concatenate(ids)
        return flat[np.lexsort((place, own))], np.bincount(own, minlength=len(words))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each row); null and empty rows have none."""
        column = column.cast(pa.large_string()).fill_null("")
        if self.prefix:
            column = pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
        data, offsets = P.text_buffers(column)
        lead, point = P.code_points(data)
        if not len(point):
            return np.zeros(0, np.int64), np.zeros(len(column), np.int64)
        blank = (point == 32) | (point == BLANK)
        start = np.empty(len(point), bool)
        start[0], start[1:] = True, blank[1:] & ~blank[:-1]
        start[np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])] = True
        begin = lead[np.flatnonzero(start)].astype(np.int64)
        coded = P.slices(data, begin).dictionary_encode()
        table, sizes = self.encode_words(coded.dictionary)
        pick = coded.indices.to_numpy()
        total = np.concatenate([[0], np.cumsum(sizes[pick])])
        return P.ragged(table, np.cumsum(sizes) - sizes, sizes, pick), np.diff(total[np.searchsorted(begin, offsets)])

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Rows of ids -> texts. Bytes that aren't UTF-8 become U+FFFD, control pieces nothing, the first blank goes."""
        raw = P.ragged(self.body, self.body_at, self.body_size, flat)
        edges = np.concatenate([[0], np.cumsum(self.body_size[flat])])[np.concatenate([[0], np.cumsum(counts)])]
        if self.prefix:
            some = np.flatnonzero(np.diff(edges) > 0)
            cut = np.zeros(len(counts), np.int64)
            cut[some] = raw[edges[:-1][some]] == 32
            keep_ = np.ones(len(raw), bool)
            keep_[edges[:-1][cut > 0]] = False
            raw, edges = raw[keep_], edges - np.concatenate([[0], np.cumsum(cut)])
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
        try:
            return out.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.large_string())


@functools.lru_cache(4)
def model_of(raw: bytes) -> Model:
    return Model(raw)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _ids_schema(docs: DataFrame, others: list[str], extra: str) -> str:
    return ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + [extra])


def encode(docs: DataFrame, model: bytes, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out`` (array<int>): ids of the whole text as the library gives them, without begin and end.

    Null text: null. Empty text: no ids. Long texts are encoded whole. Rows stand for themselves; empty tables stay
    empty. A column of docs named like ``out`` is dropped first. No shuffle; the model file (its size is fixed) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c.lower() != out.lower()]

    def run(batches):
        m = model_of(shared.value)
        for batch in batches:
            at_text = len(others)
            for at, to in P.pieces_of(batch.column(at_text)):
                part = batch.slice(at, to - at)
                column = part.column(at_text)
                flat, counts = m.encode(column)
                edges = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                valid = column.is_valid()
                lists = pa.ListArray.from_arrays(edges, pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:at_text], lists if not column.null_count else pc.if_else(valid, lists, pa.scalar(None, lists.type))], [*others, out])

    return docs.select(*others, F.col(text).alias(free(others, "text_again")[0])).mapInArrow(run, _ids_schema(docs, others, f"`{out}` array<int>"))


def decode(docs: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` (string): the text of the ids; null ids: null, no ids: empty. An id outside the model raises."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c.lower() != out.lower()]

    def run(batches):
        m = model_of(shared.value)
        for batch in batches:
            column = batch.column(len(others))
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = m.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts if not column.null_count else pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))], [*others, out])

    return docs.select(*others, F.col(ids).alias(free(others, "ids_again")[0])).mapInArrow(run, _ids_schema(docs, others, f"`{out}` string"))


def digest(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_ids, ids_crc32 (of little-endian 32-bit ids), decoded_equal: encoding, decoding and comparison in one pass.

    Null or empty text: 0 ids, equal. A text with U+2581 decodes to a blank there, so it isn't equal. Very long texts are
    encoded whole. A null key is kept; rows that repeat a key are answered each; there are no ties. An empty table gives an
    empty result. Other columns, whatever they are called, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        m = model_of(shared.value)
        for batch in batches:
            for at, to in P.pieces_of(batch.column(1)):
                column = batch.column(1).slice(at, to - at).cast(pa.large_string()).fill_null("")
                flat, counts = m.encode(column)
                raw, edges = memoryview(flat.astype("<u4").tobytes()), np.concatenate([[0], np.cumsum(counts)]) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64()), pc.equal(m.decode(flat, counts), column)], [key, "n_ids", "ids_crc32", "decoded_equal"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_ids long, ids_crc32 long, decoded_equal boolean")
