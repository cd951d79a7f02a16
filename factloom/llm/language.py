"""Language identification: known words first, shorter and shorter character n-grams for the others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pretokens as P
from .common import free
from .shingles import PLACE, mix

#: Bound of the fit: documents learned from for each language (expected number, by hash). All their words and n-grams count.
DOCS_PER_LANGUAGE = 2000
#: A table with more values of lang than this isn't labelled by language.
MOST_LANGUAGES = 1000
LONGEST = 4
#: Bytes of text handled at a time.
PIECE = 4 << 20
UNKNOWN = "und"
#: Words whose evidence is believed in full; a longer text is not surer of its language than that.
SURE_AFTER = 12


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def letter_runs(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case letter runs of a string column, the run at each place, and the runs of each row."""
    data, offsets = P.text_buffers(pc.utf8_lower(column))
    lead, point = P.code_points(data)
    if not len(point):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(len(column), np.int64)
    letter = P.classes()[point] == P.LETTER
    row = np.zeros(len(point), bool)
    row[np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])] = True
    edge = np.empty(len(point), bool)
    edge[0], edge[1:] = True, letter[1:] != letter[:-1]
    edge |= row
    at = np.flatnonzero(edge)
    begin = lead[at].astype(np.int64)
    coded = P.slices(data, begin).filter(pa.array(letter[at])).dictionary_encode()
    begin = begin[letter[at]]
    return coded.dictionary, coded.indices.to_numpy(), np.diff(np.searchsorted(begin, offsets))


def padded_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between two marks (0), and where each word begins; one more entry at the end."""
    data, offsets = P.text_buffers(words.cast(pa.large_string()))
    lead, point = P.code_points(data)
    edges = np.searchsorted(lead, offsets)  # characters before each word
    sizes = np.diff(edges)
    begin = np.concatenate([[0], np.cumsum(sizes + 2)])
    out = np.zeros(int(begin[-1]), np.int64)
    out[np.arange(len(point)) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1] = point
    return out, begin


def gram_hashes(points: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, 64-bit hash) of every n-gram inside a word, marks included."""
    sizes = np.diff(begin)
    last = np.repeat(begin[1:], sizes)
    at = np.flatnonzero(np.arange(len(points)) + n <= last)
    total = np.full(len(at), n, np.uint64)
    for k in range(n):
        total += mix((points[at + k] + 1).astype(np.uint64)) * PLACE[k]
    return at, mix(total)


def word_keys(points: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(begin) < 2:
        return np.zeros(0, np.uint64)
    place = (np.arange(len(points)) - np.repeat(begin[:-1], np.diff(begin))).astype(np.uint64)
    return mix(np.add.reduceat(mix((points + 1).astype(np.uint64) ^ mix(place)), begin[:-1]))


class Model:
    """Log frequencies of words and n-grams by language, in sorted arrays of 64-bit hashes.

    A string of no training text is taken for a known one once in 10^13 times, for a million known ones.
    """

    def __init__(self, languages: list[str], found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """found: for words (0) and for n-grams of each n, sorted hashes, their counts (a column each language) and the totals."""
        self.languages = languages
        self.keys = [keys for keys, _, _ in found]
        self.logs = [np.log((counts + 0.1) / (totals + 100.0)).astype(np.float32) for _, counts, totals in found]

    def rows(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes among the known ones, -1 for others."""
        keys = self.keys[n]
        if not len(keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, at, -1)

    def words(self, words: pa.Array) -> np.ndarray:
        """(words, languages): of known words their log frequencies; of others the mean over their longest known n-grams, place by place."""
        k = len(self.languages)
        points, begin = padded_points(words)
        out = np.zeros((len(words), k))
        at = self.rows(0, word_keys(points, begin))
        out[at >= 0] = self.logs[0][at[at >= 0]]
        rest = np.flatnonzero(at < 0)
        if len(rest):
            sizes = np.diff(begin)
            points = P.ragged(points, begin[:-1], sizes, rest)
            begin = np.concatenate([[0], np.cumsum(sizes[rest])])
            owner = np.repeat(np.arange(len(rest)), sizes[rest])
            row, level = np.full(len(points), -1), np.zeros(len(points), np.int8)
            for n in range(LONGEST, 0, -1):
                place, hashes = gram_hashes(points, begin, n)
                live = level[place] == 0
                place, got = place[live], self.rows(n, hashes[live])
                row[place[got >= 0]], level[place[got >= 0]] = got[got >= 0], n
            total, count = np.zeros((len(rest), k)), np.bincount(owner[level > 0], minlength=len(rest))
            for n in range(1, LONGEST + 1):
                mine = np.flatnonzero(level == n)
                for j in range(k):
                    total[:, j] += np.bincount(owner[mine], self.logs[n][row[mine], j], len(rest))
            out[rest] = total / np.maximum(count, 1)[:, None]
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, pick, sizes = letter_runs(column)
        k = len(self.languages)
        if not k:
            return np.full(len(column), -1), np.zeros(len(column))
        scores = self.words(words)
        total = np.zeros((len(column), k))
        row = np.repeat(np.arange(len(column)), sizes)
        for j in range(k):
            total[:, j] = np.bincount(row, scores[pick, j], len(column)) if len(row) else 0
        total = total / np.maximum(sizes, 1)[:, None] * np.minimum(sizes, SURE_AFTER)[:, None]
        total -= total.max(1, keepdims=True)
        share = np.exp(total)
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        return np.where(sizes > 0, best, -1), np.where(sizes > 0, share.max(1), 0.0)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learns from text and language of documents that aren't held out.

    Documents are drawn by the hash of their key at a rate that is expected to give ``docs_per_language`` of each
    language (all, where there are fewer). The counting of their words and n-grams is distributed; the counts come to the
    driver, as many as those documents have distinct words and n-grams: the sample bounds them, not the table. Ties in
    the counts don't matter. Raises if lang has more than MOST_LANGUAGES values.

    Rows with a null key, text or language teach nothing; empty texts count as documents without words. Long texts are
    counted whole, repeated rows each. A table without a usable row gives a model that knows no language. Other columns are
    ignored.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.coalesce(~held_out(F.col(key)), F.lit(False)))
    n_of = {r[0]: r[1] for r in usable.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(n_of) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of {lang}")
    if not n_of:
        return Model([], [])
    rate = F.create_map(*[x for k, v in n_of.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_language / v)))])
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("draw")), F.lit(1 << 30)) < F.element_at(rate, F.col(lang)) * float(1 << 30)

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for at, to in P.pieces_of(batch.column(0), PIECE):
                words, pick, sizes = letter_runs(batch.column(0).slice(at, to - at))
                row = np.repeat(np.arange(to - at), sizes)
                names, group = np.unique(langs[at:to], return_inverse=True)
                for g, one in enumerate(names):
                    mine = np.bincount(pick[group[row] == g], minlength=len(words))
                    used = np.flatnonzero(mine)
                    points, begin = padded_points(words.take(pa.array(used)))
                    weight = np.repeat(mine[used], np.diff(begin))
                    for n in range(LONGEST + 1):
                        place, hashes = gram_hashes(points, begin, n) if n else (begin[:-1], word_keys(points, begin))
                        keys, where = np.unique(hashes, return_inverse=True)
                        c = np.bincount(where, weight[place], len(keys)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([one] * len(keys), pa.string()), pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), pa.array(c)], ["lang", "n", "gram", "c"])

    sample = usable.where(draw).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = sample.mapInArrow(count, "lang string, n int, gram long, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")).toArrow()
    languages = sorted(n_of)
    number = {x: i for i, x in enumerate(languages)}
    coded = rows["lang"].combine_chunks().dictionary_encode()
    column = np.array([number[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    level, gram, c = rows["n"].to_numpy(), rows["gram"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    found = []
    for n in range(LONGEST + 1):
        mine = np.flatnonzero(level == n)
        keys, at = np.unique(gram[mine], return_inverse=True)
        counts = np.zeros((len(keys), len(languages)))
        counts[at, column[mine]] = c[mine]
        found.append((keys, counts, counts.sum(0)))
    return Model(languages, found)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to docs, from the text alone and from all of it.

    A text that is null or has no letter: ``und`` and 0. Ties go to the language first in order of name. With a model of
    no language all are ``und``. Repeated rows get the same answer. Empty tables stay empty. Columns of docs named like a
    result are dropped first. No shuffle; the model is broadcast and bounded by the sample it was learned from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    kept = docs.select(*own, F.col(text).alias(free(own, "text_again")[0]))
    names = own
    from pyspark.sql import types as T

    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        m = shared.value
        for batch in batches:
            column = batch.column(len(names))
            best, score = np.empty(len(column), np.int64), np.empty(len(column))
            for at, to in P.pieces_of(column, PIECE):
                best[at:to], score[at:to] = m.predict(column.slice(at, to - at))
            pa.default_memory_pool().release_unused()
            labels = pa.array([*m.languages, UNKNOWN], pa.string()).take(pa.array(np.where(best < 0, len(m.languages), best)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], labels, pa.array(np.where(np.isfinite(score), np.clip(score, 0, 1), 0.0))], [*names, "lang_pred", "score"])

    return kept.mapInArrow(predict, schema)
