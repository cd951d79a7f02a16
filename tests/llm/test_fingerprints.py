"""Fingerprints against plain polynomial sums and plain text comparison."""

from __future__ import annotations

import hashlib
import os
import random

import pytest

from factloom.llm import fingerprints as fp


def plain_hash(text, base):
    return sum((ord(c) + 1) * pow(base, k, fp.PRIME) for k, c in enumerate(text)) % fp.PRIME


def words(rng, n):
    return " ".join(rng.choice(["ab", "été", "zebra", "日本", "q", "lorem", "x" * 9]) + str(rng.randint(0, 99)) for _ in range(n))


def test_spans_and_extensions():
    rng = random.Random(1)
    for _ in range(60):
        text = words(rng, 12)
        own = fp.Prefixes.of(text)
        i = rng.randint(0, len(text) - 1)
        j = rng.randint(i, len(text))
        want = 0
        for base in fp.BASES:
            want = want << 31 | plain_hash(text[i:j], base)
        assert own.span(i, j) == want
        other = words(rng, 3) + text[i:]
        k = other.index(text[i:])
        assert own.extension(i, fp.Prefixes.of(other), k) == len(text) - i
        changed = text[:j] + "\0" + text[j:]
        assert own.extension(0, fp.Prefixes.of(changed), 0) == j
        tail = rng.randint(0, len(other))
        assert all((a == b).all() for a, b in zip(own.edited(j, fp.Prefixes.of(other), tail).arrays, fp.Prefixes.of(text[:j] + other[:tail]).arrays, strict=True))


def test_sketch_is_of_all_spans():
    rng = random.Random(2)
    for n in (1, 3, 6, 40, 400):
        text = words(rng, n)
        width = min(fp.WIDTH, len(text))
        values = set()
        for i in range(len(text) - width + 1):
            v = plain_hash(text[i : i + width], fp.BASES[0])
            v = (v ^ v >> 15) * 0x2C1B3C6D % fp.PRIME
            values.add((v ^ v >> 12) * 0x297A2D39 % fp.PRIME)
        assert fp.Prefixes.of(text).sketch().tolist() == sorted(values)[: fp.SKETCH]


def test_likeness():
    rng = random.Random(3)
    mark = lambda t: fp.Prefixes.of(t).fingerprint()
    for n in (5, 60, 800, 4000):
        text, other = words(rng, n), words(rng, n)
        assert fp.likeness(mark(text), mark(text)) == 1
        assert fp.likeness(mark(text), mark(other)) < 0.2
        assert fp.likeness(mark(text), mark(text[: 3 * len(text) // 4] + other[: len(text) // 4])) > 0.6
        assert fp.likeness(mark(text), mark("A title. " + text)) > 0.5  # shifted
        assert fp.likeness(mark(text), mark(other)) == fp.likeness(mark(other), mark(text))
    assert fp.likeness(mark(""), mark("")) == 1 and fp.likeness(mark(""), mark("a")) == 0
    assert fp.likeness(mark("a"), mark("b")) == 0


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_whole_table(spark, parts):
    """Nulls, empty, repeated and very long texts, repeated keys; more ranges than rows."""
    rng = random.Random(4)
    rows = [(k, words(rng, rng.randint(0, 50)), "x") for k in range(9)] + [(None, "no key", "x"), (20, None, "x"), (21, "", "x"), (22, words(rng, 30_000), "x"), (23, "same", "x"), (23, "same", "x")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, n_chars string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == len(rows)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [r[1] or "" for r in rows]
    got.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.edited_sha256))
    found = {(r.doc_id, r.edited_sha256): r for r in got}
    for k, t in enumerate(texts):
        after, tail = texts[(k + 1) % len(texts)], len(t) // 4
        edited = t[: len(t) - tail] + after[:tail]
        r = found[rows[k][0], hashlib.sha256(edited.encode()).hexdigest()]
        mine, its, changed = (fp.Prefixes.of(x).fingerprint() for x in (t, after, edited))
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(t), mine, changed)
        assert (r.near_edited, r.near_next) == (fp.likeness(mine, changed), fp.likeness(mine, its))
        assert r.common_edited == len(os.path.commonprefix([t, edited])) and r.common_next == len(os.path.commonprefix([t, after]))


def test_one_row_and_none(spark):
    schema = "doc_id long, text string"
    one = fp.fingerprints(spark.createDataFrame([(1, "abcdefgh")], schema)).collect()[0]
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert fp.fingerprints(spark.createDataFrame([], schema)).collect() == []


def test_extensions_of_pairs(spark):
    rows = [("abcdef", "xcdefg", 2, 1, 0), ("aaa", "aaa", 0, 0, 0), (None, "a", 0, 0, 0), ("a", "b", None, None, 0), ("ab", "ab", 5, 0, 0)]
    pairs = spark.createDataFrame(rows, "one string, other string, i long, j long, extension int")
    assert [r.extension for r in fp.extensions(pairs, "one", "other", "i", "j").collect()] == [4, 3, 0, 0, 0]
