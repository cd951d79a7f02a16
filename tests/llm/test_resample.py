"""Resampling against a plain count of strings."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from factloom.llm import resample as rs

SCHEMA = "doc_id long, text string, rank string"


def features(text, run=2):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + n]) for n in range(1, run + 1) for i in range(len(w) - n + 1)]


def bucket(x, buckets):
    return zlib.crc32(x.encode()) % buckets


def plain(docs, target, run=2, buckets=10_000, percent=25, least=20, seed=7):
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for x in features(text, run)[1]:
            s[bucket(x, buckets)] += 1
    for text in target:
        for x in features(text, run)[1]:
            t[bucket(x, buckets)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for k, text in docs:
        w, f = features(text, run)
        weight = sum(gain[bucket(x, buckets)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    rank = {id(r): i + 1 for i, r in enumerate(drawn)}
    return [(*r[:4], rank.get(id(r))) for r in out]


def generated(n=120):
    rng = random.Random(9)
    vocabulary = ["The", "été", "ÉTÉ", "a1", "naïve", "日本語", "It's", "x_y", "Z" * 300, "plain", "words", "of", "text", " nbsp", "é"]
    text = lambda k: rng.choice([" ", "\n", ", "]).join(rng.choice(vocabulary) for _ in range(k))
    docs = [(k, text(rng.randint(0, 60))) for k in range(n)] + [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, text(20_000))]
    return docs, [text(40) for _ in range(5)] + [None]


def key(r):
    return (r[0] is not None, r[0] or 0, r[1])


def test_crc_of_joined_strings():
    rng = random.Random(1)
    parts = [(bytes(rng.randrange(256) for _ in range(rng.randint(0, 9))), bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 5, 300, 5000])))) for _ in range(300)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = rs.joined(crc(a for a, _ in parts), crc(b for _, b in parts), np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_features_of_pieces():
    docs, _ = generated()
    texts = [t for _, t in docs]
    for run in (1, 2, 3):
        own = rs.Features(pa.array(["before", *texts])[1:], run)
        want = [features(t, run) for t in texts]
        assert own.n_words.tolist() == [len(w) for w, _ in want]
        counts = np.zeros(97, int)
        for _, f in want:
            for x in f:
                counts[bucket(x, 97)] += 1
        assert own.counts(97).tolist() == counts.tolist()
        gains = np.arange(97) - 40
        n, total = own.sums(gains)
        assert n.tolist() == [len(f) for _, f in want] and total.tolist() == [sum(gains[bucket(x, 97)] for x in f) for _, f in want]


def test_equal_to_plain_counts(spark):
    docs, target = generated()
    table = spark.createDataFrame([(*d, "own") for d in docs], SCHEMA)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for options in ({}, {"run": 3, "buckets": 50, "percent": 60, "least_words": 5, "seed": 1}):
        got = sorted((tuple(r) for r in rs.resample(table, goal, **options).collect()), key=key)
        options = {{"least_words": "least"}.get(k, k): v for k, v in options.items()}
        assert got == sorted(plain(docs, target, **options), key=key)


def test_repeated_rows_ties_and_null_keys(spark):
    """Copies of a row have one score; as many of them are drawn as there is room, with ranks of their own."""
    text = " ".join(["word"] * 30)
    docs = [(5, text)] * 40 + [(None, text)] * 4 + [(6, text)]
    got = rs.resample(spark.createDataFrame([(*d, "own") for d in docs], SCHEMA), spark.createDataFrame([("word",)], "text string")).collect()
    assert len(got) == 45 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 45 * 25 // 100 + 1))
    want = plain(docs, ["word"])
    assert sorted(str((r[0], r[3], r[4] is None)) for r in want) == sorted(str((r.doc_id, r.score, r["rank"] is None)) for r in got)


def test_empty_tables(spark):
    none, goal = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert rs.resample(none, goal).collect() == []
    docs, _ = generated(20)
    got = sorted((tuple(r) for r in rs.resample(spark.createDataFrame([(*d, "own") for d in docs], SCHEMA), goal).collect()), key=key)
    assert got == sorted(plain(docs, []), key=key)
