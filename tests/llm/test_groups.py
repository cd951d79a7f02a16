"""Near duplicates of texts and vectors, repeated passages, archives, licenses: against brute force, with edge cases."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import license as lic
from factloom.llm import linededup, minhash, neighbours, warc
from factloom.llm.common import components, lookup, scratch_path

from . import brute, brute_lines


def test_lookup_keeps_all_rows(spark):
    key = F.when(F.col("id") < 6000, 0).when(F.col("id") < 6100, None).otherwise(F.col("id"))
    left = spark.range(10000).select(key.alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    out = lookup(left, right, "k", "n", 10000)
    assert out.count() == 10000 and out.where("n is not null").count() == 9900 and out.where("k = 0 and n = 6000").count() == 6000


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)] + [(60, 61), (61, 62), (5, 60)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    nodes = sorted({x for p in links for x in p})
    assert {r.node: r.root for r in components(df).collect()} == brute.roots(nodes, links)


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((n, " ".join(text)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "  \n "), (n + 3, "One two"), (n + 4, "one  TWO"), (n + 5, "long " * 3000)]


@pytest.mark.parametrize("seed", range(2))
def test_minhash_equals_brute_force(spark, seed):
    rows = corpus(seed)
    out = minhash.near_duplicates(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, component_id int, kept string")).collect()
    want = brute.near_duplicates(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_minhash_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out) == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_that_share_one_band_are_compared(spark):
    """No pair is dropped for sharing few bands: all pairs of similarity 0.85 and more of many small sets are linked."""
    rng = random.Random(11)
    rows = []
    for i in range(150):
        words = [f"g{i}w{k}" for k in range(44)]  # 40 shingles
        rows.append((2 * i, " ".join(words)))
        at = rng.choice([0, 1, 2])
        words[at] += "y"  # loses at + 1 shingles on each side
        rows.append((2 * i + 1, " ".join(words)))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.near_duplicates(rows)


def test_hot_bucket_of_unlike_texts(spark, monkeypatch):
    """Blocks of a bucket with many components: more members than a block holds, sets compared across all of them."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(60), rng.choice([1, 2, 3, 4])):
            words[k] = f"v{i}k{k}"
        rows.append((i, " ".join(words)))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similar=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.near_duplicates(rows, 80)


def test_repeated_key_with_other_text(spark):
    rows = [(5, "a b c d e f g"), (5, "n m o p q r s"), (7, "N m o p q r s"), (2, "a b c d e f g")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(2, 2), (5, 2), (5, 5), (7, 5)]


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((160, 24))
    centers = rng.standard_normal((6, 24))
    near = np.concatenate([centers[i] + 0.12 * rng.standard_normal((n, 24)) for i, n in enumerate((2, 3, 5, 12, 40, 60))])
    x = np.concatenate([x, near, near[:4] * 2, near[:1]]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 24, 0), (1003, [float("nan")] * 24, 0), (1004, [1.0, None] * 12, 0), (1005, [float("inf")] + [0.0] * 23, 0)]
    out = neighbours.near_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, n_links int")).collect()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    roots = brute.roots(list(range(len(x))), [(int(a), int(b)) for a, b in zip(*np.nonzero(s), strict=True)])
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    assert all(got[i] == (int(s[i].sum()), roots[i]) for i in range(len(x)))
    assert all(got[i] == (0, i) for i in range(1000, 1006))
    assert neighbours.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_line_dedup(spark):
    p1, p2 = " ".join(f"alpha{i}" for i in range(30)), " ".join(f"beta{i}" for i in range(25))
    one = " ".join(f"long{i}" for i in range(60))
    rows = [
        (1, f"x one two.\n{p1}\n{p2}\ny end"), (2, f"other start\n{p1}\n\n{p2}\nother end"), (3, f"q\n{one}\nr"), (4, f"s\n{one}\nt"), (5, None), (6, ""),
        (7, "x one two.\nshort rep"), (8, "x one two.\nshort rep"), (None, one), (9, f"{p1}\nfoo\n{p2}"), (10, "z " * 9000), (11, f"u\n{one}"), (11, f"u\n{one}"),
    ]
    out = linededup.dedup_lines(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_lines int")).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert by[2].text == "other start\nother end" and by[2].n_removed == 3
    assert by[3].text == "q\nr" and by[4].text == "s\nt" and by[None].text == one and by[11].text == "u"
    assert by[5].text is None and by[5].n_lines == 0 and by[6].text == ""
    for i in (1, 7, 8, 9, 10):
        assert by[i].text == dict(rows)[i]
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def passages(seed):
    rng = random.Random(seed)
    line = lambda n, p: " ".join(f"{p}{rng.randrange(10**6)}" for _ in range(n))
    shared = [[line(rng.randint(4, 40), f"p{i}x") for _ in range(rng.randint(1, 8))] for i in range(12)]
    short = [line(3, "s") for _ in range(5)]
    rows = []
    for d in range(80):
        out = []
        for _ in range(rng.randint(1, 6)):
            kind = rng.random()
            if kind < 0.4:
                p = rng.choice(shared)
                a, b = (0, len(p)) if rng.random() < 0.5 else sorted(rng.sample(range(len(p) + 1), 2))
                for x in p[a:b]:
                    out += [x, ""] if rng.random() < 0.1 else [x]
            else:
                out.append(rng.choice(short) if kind < 0.55 else line(rng.randint(3, 30), "u"))
        rows.append((d, "\n".join(out)))
    return [*rows, (1000, None), (1001, ""), (1002, "x " * 9000)]


def test_registered_line_query_equals_brute_force(spark, tmp_path):
    """Full rows of op10_lines: what goes repeats as a whole, and all that repeats as a whole goes."""
    from factloom.llm import entry

    rows = passages(2)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in entry.op10_lines(spark, str(tmp_path)).collect()}
    want = brute_lines.dedup(rows)
    assert got == want and sum(x[2] for x in want.values()) > 50


def test_lines_put_together_once_stay(spark):
    """Lines that each occur elsewhere, but nowhere together, are no repeated passage."""
    parts = [" ".join(f"q{i}w{k}" for k in range(12)) for i in range(6)]
    rows = [(0, "\n".join(parts)), *[(i + 1, f"start {i}\n{p}\nend {i}") for i, p in enumerate(parts)]]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == dict(rows)


def test_warc_round_trip(spark):
    html = "<p>é &amp; x</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/ b", html), (2, "http://b", html), (3, None, None), (4, "u\r\nX: 1", ""), (5, "c", "z" * 200_000), (None, "d", "only"), (6, "e", html), (6, "e", html)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    out = warc.round_trip(spark, df).collect()
    assert len(out) == len(rows)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    by = {r.page_id: r for r in out}
    for i, _, t in rows:
        assert (by[i].payload_bytes, by[i].payload_digest) == (len((t or "").encode()), sha(t))
    assert [(by[i].record_type, by[i].refers_to) for i in (1, 2, 3, 4, 5, 6, None)] == [("revisit", 6), ("revisit", 6), ("revisit", 4), ("response", None), ("response", None), ("response", None), ("response", None)]
    index = warc.write(df, scratch_path(spark, "warc-test"))
    some = warc.read(index.where("record_id in ('1', '6', '5')")).collect()
    assert sorted((r.record_id, r.record_type, None if r.payload is None else bytes(r.payload).decode()) for r in some) == sorted([("1", "revisit", None), ("6", "response", html), ("6", "response", html), ("5", "response", "z" * 200_000)])
    assert {r.url for r in some} == {"http://a/ b", "e", "c"}
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_ranges_are_coalesced():
    assert warc.ranges([(0, 10), (10, 5), (100_000, 5), (100_010, 5)], gap=64) == [(0, 15, [0, 1]), (100_000, 100_015, [2, 3])]


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
        ("a/b/c/f.py", "code only"), ("a/b/g.py", "text\nLicensed under the Apache License, Version 2.0.\ncode"), ("x/f.py", "nothing here"), (None, None), ("a/b/h.py", ""),
        ("top.py", "Licensed under CC BY-NC 4.0."), ("a/b/COPYING", "GNU General Public License Version 3, 29 June 2007"), ("q.py", "my driving license is in the car"), ("a/b/g.py", "x " * 20000 + "\nReleased under the MIT License."),
    ]
    out = lic.scan(spark.createDataFrame([(p, t, "x") for p, t in rows], "path string, text string, license string")).collect()
    got = sorted((str(r.path), str(r.license), str(r.license_from), str(r.inherited_from)) for r in out)
    assert got == sorted([
        ("a/LICENSE", "MIT", "file", "None"), ("a/b/c/f.py", "GPL-3.0", "inherited", "a/b"), ("a/b/g.py", "Apache-2.0", "header", "None"), ("x/f.py", "None", "None", "None"),
        ("None", "None", "None", "None"), ("a/b/h.py", "GPL-3.0", "inherited", "a/b"), ("top.py", "CC-BY-NC-4.0", "header", "None"), ("a/b/COPYING", "GPL-3.0", "file", "None"),
        ("q.py", "None", "None", "None"), ("a/b/g.py", "MIT", "header", "None"),
    ])
    assert lic.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_registered_license_query_inherits(spark, tmp_path):
    """Full rows of op9_license against plain Python: files of folders and of sources, the nearest first."""
    import zlib

    from factloom.llm import entry

    states = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0."]
    rng = random.Random(5)
    rows = [(i, f"plain words {i}" + (f"\n{rng.choice(states)}\nend" if rng.random() < 0.15 else ""), f"src{i % 3}") for i in range(600)] + [(900, None, "src0"), (901, "alone", "src9")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    names = {states[0]: "MIT", states[1]: "Apache-2.0", states[2]: "CC-BY-NC-4.0"}
    own = {i: next((n for s, n in names.items() if s in (t or "")), None) for i, t, _ in rows}
    files, rules = {}, {}
    for i, _, source in rows:
        turn = zlib.crc32(str(i).encode()) % 4 if own[i] else 9
        if turn < 2:
            files[i] = source if turn == 0 else f"{source}/{i // 100}"
            rules[files[i]] = min(rules.get(files[i], "Z"), own[i])
    want = {}
    for i, _, source in rows:
        folder = f"{source}/{i // 100}"
        place = None if own[i] else folder if folder in rules else source if source in rules else None
        want[i] = (own[i] or rules.get(place), "file" if i in files else "header" if own[i] else "inherited" if place else None, place)
    out = entry.op9_license(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.license, r.license_from, r.inherited_from) for r in out} == want and len(out) == len(rows)
    assert {"src0", "src1/2"} & {p for _, _, p in want.values()} and {f for _, f, _ in want.values()} == {"file", "header", "inherited", None}


def test_scores_equal_plain_cosine(spark):
    """Score and license of every document against all runs of lines and all templates, computed plainly: of the templates
    whose own words the run has, reserved rights last, the nearest."""
    rng = random.Random(9)
    vocabulary = [*lic.vocabulary(), *[f"other{i}" for i in range(60)]]
    statements = [line for group in lic.TEMPLATES.values() for line in group]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.6:
            some = rng.choice(statements).split()
            cut = rng.randint(1, len(some))
            lines[rng.randrange(len(lines)) : 0] = [" ".join(some[:cut]), " ".join(some[cut:] + rng.choices(vocabulary, k=rng.randint(0, 3)))]
        rows.append((i, f"d{i % 7}/f{i}" if i % 5 else f"d{i % 7}/LICENSE.{i}", "\n".join(lines)))
    rows += [(100, "x", None), (101, "y", "")]
    n = len(rows)
    df = {t: sum(t in lic.tokens(x or "") for _, _, x in rows) for t in lic.vocabulary()}
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in df}
    rare = math.log(1 + n) + 1

    def vector(words):
        return {t: words.count(t) * idf.get(t, rare) for t in set(words)}

    def cosine(a, b):
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        return sum(x * b.get(t, 0) for t, x in a.items()) / norm(a) / norm(b)

    templates = [(name, vector(lic.tokens(line))) for name, group in lic.TEMPLATES.items() for line in group]
    def told(name, said):
        needs, nevers = lic.TELLS[name]
        return all(re.search(x, said) for x in needs) and not any(re.search(x, said) for x in nevers)

    want = {}
    for i, path, text in rows:
        lines = (text or "").split("\n")
        clauses = "".join(mark for mark, x in ((" #second", lic.SECOND_CLAUSE), (" #third", lic.THIRD_CLAUSE)) if re.search(x, (text or "").lower()))
        runs = [lines[a : a + k] for a in range(len(lines)) for k in range(1, lic.WRAPPED + 1)] + ([lines] if "LICENSE" in path else [])
        found = [(name == lic.WEAKEST, -score, name) for r in runs if (w := lic.tokens(" ".join(r))) for name, v in templates if (score := round(cosine(vector(w), v), 6)) >= 0.7 and told(name, " ".join(w) + clauses)]
        want[i] = (-min(found)[1], min(found)[2]) if found else (None, None)
    out = lic.stated(spark.createDataFrame(rows, "id long, path string, text string")).collect()
    got = {r.id: (r.top and round(r.top, 6), r.own) for r in out}
    assert got == want and sum(x[0] is not None for x in want.values()) > 10


def test_wrapped_licenses(spark):
    """Statements over several lines, and licence files as whole texts, whose long template lines no run holds."""
    apache = lic.TEMPLATES["Apache-2.0"][1].split()
    rows = [
        ("a/f.py", "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files, to deal in the\n# Software without restriction\ncode"),
        ("b/f.py", "x\nGNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"), ("c/f.py", "This Source Code Form is subject to the\nterms of the Mozilla Public License, v. 2.0"),
        ("d/f.py", "all\nrights\nreserved"), ("e/LICENSE", "\n".join(apache)), ("e/f.py", "code"), ("g/f.py", "license plates\nof no kind\nhere"),
    ]
    other = [("x", f"plain text {i}") for i in range(300)]  # words of the templates are rare, as in a corpus
    out = lic.scan(spark.createDataFrame(rows + other, "path string, text string")).where("path <> 'x'").collect()
    got = {r.path: (r.license, r.license_from) for r in out}
    assert got == {"a/f.py": ("MIT", "header"), "b/f.py": ("GPL-3.0", "header"), "c/f.py": ("MPL-2.0", "header"), "d/f.py": ("Proprietary", "header"), "e/LICENSE": ("Apache-2.0", "file"), "e/f.py": ("Apache-2.0", "inherited"), "g/f.py": (None, None)}
    assert [round(r.license_score, 6) for r in out if r.path == "e/LICENSE"] == [1.0]


def vectors_with_hot_group(pairs=40, hot=60, size=32):
    rng = np.random.default_rng(8)
    center, base = rng.standard_normal((1, size)), rng.standard_normal((pairs, size))
    return np.concatenate([center + 0.1 * rng.standard_normal((hot, size)), base, base + 0.1 * rng.standard_normal((pairs, size))])


def test_audit_sees_lost_links_beside_a_hot_group(spark):
    x = vectors_with_hot_group()
    nodes = neighbours.prepared(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v")
    hot = [(0, i) for i in range(1, 60)]
    pairs = [(60 + i, 100 + i) for i in range(40)]
    dense = spark.createDataFrame([(0,)], "root long")

    def audited(links, dense):
        df = spark.createDataFrame(links, "a long, b long")
        return neighbours.audit(nodes, df, components(df), dense, len(x), 0.9, 0)

    assert audited(hot + pairs, dense) == (80.0, 80)
    assert audited(hot + pairs[:10], dense) == (20.0, 80)
    # a component that isn't compared as a whole has only the links that were found
    got, there = audited(hot + pairs, dense.where("false"))
    assert there == 140 and got < 85


def test_vectors_fall_back_to_exact(spark, monkeypatch):
    x = vectors_with_hot_group()
    monkeypatch.setattr(neighbours, "AGAIN", 0)
    monkeypatch.setattr(neighbours, "DENSE", 32)
    monkeypatch.setattr(neighbours, "start", lambda nodes, *_: nodes.sparkSession.createDataFrame([], neighbours.EDGE))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, [1.0, 0.0]), (501, [1.0, 0.01])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    roots = brute.roots(list(range(len(x))), [(int(a), int(b)) for a, b in zip(*np.nonzero(s), strict=True)])
    assert got == {i: (int(s[i].sum()), roots[i]) for i in range(len(x))} | {500: (1, 500), 501: (1, 500)}


def test_tables_grow_with_the_bits():
    assert neighbours.tables_for(0, 0.9) == neighbours.TABLES
    for bits in (6, 12, 17):
        assert 1 - (1 - 0.8564**bits) ** neighbours.tables_for(bits, 0.9) >= 0.979


@pytest.mark.parametrize("seed", range(2))
def test_vectors_that_share_a_key(spark, seed):
    """Rows of one key and different vectors are vectors of their own: full rows against all pairs."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((40, 6))
    rows = [(1, [1.0, 0, 0, 0, 0, 0]), (1, [0, 1.0, 0, 0, 0, 0]), (4, [0.05, 1.0, 0, 0, 0, 0]), (5, [1.0, 0.05, 0, 0, 0, 0])]
    rows += [(int(rng.integers(0, 60)), (base[rng.integers(0, 40)] + 0.2 * rng.standard_normal(6)).tolist()) for _ in range(300)]
    rows += rows[:20] + [(7, (2 * np.array(rows[30][1])).tolist())]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    root = brute.roots(list(range(len(rows))), [(int(a), int(b)) for a, b in np.argwhere(near)])
    least = {}
    for i, r in root.items():
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    want = sorted((rows[i][0], int(near[i].sum()), least[root[i]], rows[i][0] == least[root[i]]) for i in range(len(rows)))
    out = neighbours.near_vectors(spark.createDataFrame([(k, [float(c) for c in v], 0, "x") for k, v in rows], "vec_id long, embedding array<double>, first int, key_of_root string"))
    assert sorted(tuple(r) for r in out.collect()) == want


def test_long_texts_of_many_lines(spark):
    """Two copies of 20,000 lines, one with a line changed: what a chunk and a stretch carry doesn't grow with the text."""
    lines = [f"line {i} of a long text, word {i % 7}" if i % 50 else "" for i in range(20_000)]
    other = [*lines]
    other[9_000] = "another line altogether"
    rows = [(1, "\n".join(lines)), (2, "\n".join(other)), (3, "\n".join(lines[:3]))]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines.dedup(rows) and got[2][0].count("another line") == 1 and got[2][2] > 19_000


def test_hash_collisions_keep_their_places(spark, monkeypatch):
    """Chunks whose hashes are equal and whose bytes are not stay."""
    rows = [(i, "\n".join(f"w{k} " * 10 + f"end{k if i < 2 else k + i}" for k in range(6))) for i in range(4)]
    honest = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in honest if r.n_removed) == [1]
    real = linededup.chunk_table
    monkeypatch.setattr(linededup, "chunk_table", lambda *a: real(*a).withColumn("ck", F.lit("one")))
    lines = linededup.line_table

    def same(docs, key, text):
        return lines(docs, key, text).withColumn("lh", F.xxhash64("seq")).withColumn("lh2", F.col("lh"))

    monkeypatch.setattr(linededup, "line_table", same)
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_removed == 0 for r in out)
