"""Byte-level BPE: exact ids and counts of whole texts by distinct pre-tokens, with a proven whole-token shortcut."""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens as P

@functools.cache
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def specials(path: str) -> tuple[str, ...]:
    """Strings that the library cuts out of a text before pre-tokenizing it."""
    return tuple(x["content"] for x in json.loads(library(path).to_str())["added_tokens"])


@functools.cache
def vectorisable(path: str) -> bool:
    """Whether the file's pre-tokenizer is the one that pretokens.py reproduces and nothing normalises the text."""
    spec = json.loads(library(path).to_str())
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["model"]["type"] == "BPE"


@functools.cache
def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(own)]
    return {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(rest)}


@functools.cache
def whole_tokens(path: str) -> dict[bytes, int]:
    """The proof behind the shortcut: vocabulary strings that the library itself, given them alone, encodes as their one token.

    The library's own encoding is the proof, string by string; nothing is assumed about merges. Strings that aren't UTF-8
    or that the pre-tokenizer would split are left out, so a pre-token equal to a listed string is exactly that token.
    """
    tok, letters = library(path), byte_letters()
    found: dict[bytes, int] = {}
    texts, keys = [], []
    for piece, number in tok.get_vocab(with_added_tokens=False).items():
        try:
            raw = bytes(letters[x] for x in piece)
            texts.append(raw.decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue
        keys.append((raw, number))
    for (raw, number), text, encoded in zip(keys, texts, tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        if encoded.ids == [number] and len(tok.pre_tokenizer.pre_tokenize_str(text)) == 1:
            found[raw] = number
    return found


@functools.cache
def merger(path: str):
    """bytes -> ids of one pre-token, by merge rank. A vocabulary whose ids don't rise with its merges gets the library itself."""
    spec, letters = json.loads(library(path).to_str()), byte_letters()
    vocab = spec["model"]["vocab"]
    joined = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    special = {x["content"] for x in spec["added_tokens"]}
    try:
        ranks = {bytes(letters[x] for x in piece): number for piece, number in vocab.items() if piece not in special}
    except KeyError:
        ranks = {}
    if len(ranks) == 256 + len(joined) and joined == sorted(joined) and all(ranks.get(bytes([x]), len(ranks)) < joined[0] for x in range(256)):
        import tiktoken

        return tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda raw: library(path).encode(raw.decode("utf-8"), add_special_tokens=False).ids


class Encoder:
    """Encodes string columns: the whole-token table answers what it can, the rest is merged once for each distinct pre-token of a slice."""

    def __init__(self, path: str, whole: dict[bytes, int]):
        self.path = path
        self.keys = pa.array(list(whole), pa.large_binary())
        self.ids = np.fromiter(whole.values(), np.uint32, len(whole))
        self.shortcut = self.merged = 0

    def ids_of(self, words: pa.Array, ids: bool) -> tuple[np.ndarray | None, np.ndarray]:
        """Distinct pre-tokens -> (flat ids, ids of each)."""
        import pyarrow.compute as pc

        at = pc.index_in(words, value_set=self.keys).fill_null(-1).to_numpy()
        rest = np.flatnonzero(at < 0)
        merge = merger(self.path)
        lists = [merge(w) for w in words.take(pa.array(rest)).to_pylist()]
        self.shortcut += len(words) - len(rest)
        self.merged += len(rest)
        sizes = np.ones(len(words), np.int64)
        sizes[rest] = np.fromiter(map(len, lists), np.int64, len(lists))
        if not ids:
            return None, sizes
        begin = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.uint32)
        known = np.flatnonzero(at >= 0)
        flat[begin[known]] = self.ids[at[known]]
        own = np.ones(len(flat), bool)
        own[begin[known]] = False
        flat[own] = np.fromiter((i for x in lists for i in x), np.uint32, int(own.sum()))
        return flat, sizes

    def _odd_rows(self, column: pa.Array) -> np.ndarray:
        """Rows with an added token's string; the library handles those texts as a whole."""
        import pyarrow.compute as pc

        odd = np.zeros(len(column), bool)
        if not vectorisable(self.path):
            return ~odd
        for s in specials(self.path):
            odd |= pc.match_substring(column, s).fill_null(False).to_numpy(zero_copy_only=False)
        return odd

    def encode(self, column: pa.Array, ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """(flat ids of all rows, number of ids of each row); nulls are empty texts."""
        odd = self._odd_rows(column)
        if odd.any():
            plain = column if not odd.all() else None
            texts = [column[int(i)].as_py() or "" for i in np.flatnonzero(odd)]
            # one text a call: the library pads or truncates whole batches only
            lists = [library(self.path).encode_batch_fast([t], add_special_tokens=False)[0].ids for t in texts]
            if plain is None:
                counts = np.array([len(x) for x in lists], np.int64)
                return (np.array([i for x in lists for i in x], np.uint32) if ids else None), counts
            mask = pa.array(odd)
            import pyarrow.compute as pc

            flat, counts = self.encode(pc.if_else(mask, "", column), ids)
            counts = counts.copy()
            if ids:
                edges = np.concatenate([[0], np.cumsum(counts)])
                own = dict(zip(np.flatnonzero(odd).tolist(), lists, strict=True))
                flat = np.concatenate([np.array(own[i], np.uint32) if i in own else flat[edges[i] : edges[i + 1]] for i in range(len(column))])
            for i, x in zip(np.flatnonzero(odd), lists, strict=True):
                counts[i] = len(x)
            return flat, counts
        data, offsets = P.text_buffers(column)
        lead, point = P.code_points(data)
        begin = lead[P.gpt_boundaries(lead, point, offsets)]
        coded = P.slices(data, begin).dictionary_encode()
        table, sizes = self.ids_of(coded.dictionary, ids)
        pick = coded.indices.to_numpy()
        total = np.concatenate([[0], np.cumsum(sizes[pick])])
        counts = np.diff(total[np.searchsorted(begin, offsets)])
        return (P.ragged(table, np.cumsum(sizes) - sizes, sizes, pick) if ids else None), counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str, whole: dict[bytes, int]) -> Encoder:
    """One encoder for each Python worker and file; what it has merged stays for later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, whole)
    return _encoders[path]


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """All columns of docs but the text, and n_bytes, n_tokens and over_limit, as the tokenizer file's library counts whole texts.

    Whole-token shortcut: the strings proven to encode alone as one token (``whole_tokens``, at most the vocabulary, sent
    to the workers once) count directly; merges run only for the other distinct pre-tokens. No shuffle.

    Null and empty text: 0 bytes, 0 tokens, not over the limit. Long texts are counted whole. Repeated rows are counted
    each. An empty table gives an empty result. Columns of docs named like a result are dropped first.
    """
    import pyspark

    spark = docs.sparkSession
    whole: pyspark.Broadcast = spark.sparkContext.broadcast(whole_tokens(tokenizer) if vectorisable(tokenizer) else {})
    names = ("n_bytes", "n_tokens", "over_limit")
    kept = docs.select(*[c for c in docs.columns if c.lower() not in names and c != text], F.col(text).alias(text))
    others = [c for c in kept.columns if c != text]
    schema = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in others] + ["n_bytes bigint", "n_tokens bigint", "over_limit boolean"])

    def count(batches):
        code = encoder(tokenizer, whole.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            _, offsets = P.text_buffers(column)
            n = np.zeros(len(column), np.int64)
            for at, to in P.pieces_of(column):
                _, n[at:to] = code.encode(column.slice(at, to - at), ids=False)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in others] + [pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], [*others, *names])

    return kept.mapInArrow(count, schema)
