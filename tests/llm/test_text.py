"""Token counts, packing, SentencePiece, language, quality: exact comparisons and edge cases."""

import random
import zlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest

from factloom.llm import language, packing, quality, sentpiece
from factloom.llm.pretokens import code_points
from factloom.llm.tokens import Encoder, library, token_counts, whole_tokens

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["I'll go, we've 'tis 's 'sam rock'n'roll", "a  b\n\n c\t d   ", "\n's", "x<|endoftext|>y", "", None, "日本語 テスト１２３ ⅷ", "éa​ b　c\x1c\x85e", "  ", "'re'Re'll", "a" * 5000, "word " * 4000]
CLASH = "doc_id long, text string, n_tokens int, kept string, score string, ids string"


def clash(rows):
    return [(i, t, 1, "x", "y", "z") for i, t in rows]


def test_code_points():
    import numpy as np

    text = "aé日𝔘\x00ÿ"
    _, point = code_points(np.frombuffer(text.encode(), np.uint8))
    assert point.tolist() == [ord(c) for c in text]


def test_token_counts_equal_library(spark):
    rows = [*enumerate(ODD), (3, "same"), (3, "same"), (None, "no key")]
    out = token_counts(spark.createDataFrame(clash(rows), CLASH).select("doc_id", "text", "n_tokens"), BPE).collect()
    want = Counter((i, len((t or "").encode()), len(library(BPE).encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in out)


def test_token_counts_empty(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), BPE).count() == 0


def test_every_code_point_encodes_as_the_library_does():
    encoder, lib = Encoder(BPE, whole_tokens(BPE)), library(BPE)
    points = [p for p in range(1, 0x110000, 7) if not 0xD800 <= p < 0xE000] + list(range(1, 0x3100))
    texts = [f"x{chr(p)}1{chr(p)}!{chr(p)} {chr(p)}x" for p in points]
    flat, counts = encoder.encode(pa.array(texts))
    assert flat.tolist() == [i for e in lib.encode_batch(texts, add_special_tokens=False) for i in e.ids]


def brute_best(sizes, capacity):
    """Fewest bins, by search."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for b in sorted(set(bins)):
            if b + sizes[k] <= capacity:
                i = bins.index(b)
                place(k + 1, [*bins[:i], b + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_completion_is_optimal(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(3, 60) for _ in range(11)]
    have = dict(Counter(sizes))
    plan = packing.complete(have, 100)
    used = Counter()
    for taken, times in plan:
        assert sum(taken) <= 100
        for s in taken:
            used[s] += times
    assert used == Counter(have)
    assert packing.least_sequences(have, 100) <= sum(n for _, n in plan) == brute_best(sizes, 100)
    assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(have, 100))


@pytest.mark.parametrize("seed", range(5))
def test_planted_triples_are_found(seed):
    rng = random.Random(seed)
    sizes = [x for _ in range(20) for a, b in [(rng.randint(100, 900), rng.randint(100, 900))] for x in (a, b, 2048 - a - b)]
    trace = packing.Trace()
    plan = packing.complete(dict(Counter(sizes)), 2048, trace=trace)
    assert sum(n for _, n in plan) == 20 < sum(n for _, n in packing.best_fit(Counter(sizes), 2048)) and trace.proven


def test_the_search_branches_and_prunes():
    total = packing.Trace()
    for seed in range(200):
        rng = random.Random(seed)
        trace = packing.Trace()
        packing.complete(dict(Counter(rng.randint(1, 30) for _ in range(10))), 30, trace=trace)
        total.branches, total.cut, total.dominated = total.branches + trace.branches, total.cut + trace.cut, total.dominated + trace.dominated
        assert trace.proven
    assert total.branches > 20 and total.cut > 5 and total.dominated > 20
    few = packing.Trace()
    assert sum(n for _, n in packing.complete({700: 40, 650: 40, 699: 40, 300: 3}, 2048, steps=50, trace=few)) > 0 and few.steps <= 51


def test_pack_round_trip(spark):
    rng = random.Random(5)
    rows = [*enumerate(ODD), (3, "same"), (3, "same"), (None, "no key")] + [(100 + i, "tok " * rng.randint(0, 900)) for i in range(60)]
    out = packing.pack(spark.createDataFrame(clash(rows), CLASH), BPE).collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    want, total = Counter(), 0
    for i, t in rows:
        ids = [*library(BPE).encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at, k, head = 0, 0, len(ids) % 2048 or 2048
        while at < len(ids):
            own = ids[at : at + head]
            want[i, k, at, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))] += 1
            at, k, head = at + len(own), k + 1, 2048
    assert pieces == want
    assert len(by) <= -(-total // 2048) + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BPE).count() == 0


def test_sentencepiece_equals_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=SP)
    rng = random.Random(2)
    texts = [*ODD, "\t▁x", " " * 40 + "x", "ab" * 400 + " y"] + ["".join(rng.choice("etaoin shrdlu,.\nÉß") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    raw = sentpiece.read_model(SP)
    df = spark.createDataFrame(clash(enumerate(texts)), CLASH)
    out = sentpiece.decode(sentpiece.encode(df, raw), raw).collect()
    for r in out:
        if texts[r.doc_id] is None:
            assert r.ids is None and r.decoded is None
        else:
            assert r.ids == lib.encode(texts[r.doc_id]) and r.decoded == lib.decode(r.ids)
    digest = {r.doc_id: r for r in sentpiece.digest(df, raw).collect()}
    assert all(digest[i].n_ids == len(lib.encode(t or "")) and digest[i].decoded_equal == ("▁" not in (t or "")) for i, t in enumerate(texts))
    assert sentpiece.encode(spark.createDataFrame([], "doc_id long, text string"), raw).count() == 0


def test_viterbi_on_a_unigram_model():
    """The same pieces under the other model type: the best segmentation, as the library's lattice has it."""
    import sentencepiece

    raw = sentpiece.read_model(SP)
    at = raw.index(b"tok_v0") + 6
    assert raw[at : at + 2] == b"\x18\x02"
    raw = raw[:at] + b"\x18\x01" + raw[at + 2 :]
    model, lib = sentpiece.Model(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    rng = random.Random(4)
    words = list({"".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 12))) for _ in range(300)})
    flat, counts = model.encode(pa.array(words))
    score = lambda ids: sum(float(model.scores[i]) for i in ids)
    at = 0
    for w, n in zip(words, counts.tolist(), strict=True):
        own = flat[at : at + n].tolist()
        at += n
        assert score(own) == pytest.approx(score(lib.nbest_encode(w, nbest_size=2)[0])), w


def test_language(spark):
    rng = random.Random(1)
    kinds = {"aa": ["lopo", "mipa", "tosk"], "bb": ["grun", "wezt", "hask"]}
    rows = [(i, " ".join(rng.choices(kinds[k], k=30)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame([*rows, (500, None, "aa"), (501, "12 !", "bb"), (502, "", None), (503, "Lopo mipas", None), (503, "Lopo mipas", None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    out = language.identify(docs, model).collect()
    for r in out:
        if r.doc_id < 500:
            assert r.lang_pred == r.lang and 0 <= r.score <= 1
    by = {r.doc_id: r.lang_pred for r in out}
    assert by[500] == by[501] == by[502] == "und" and by[503] == "aa" and len(out) == len(rows) + 5
    none = language.fit(docs.where("doc_id > 9999"))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def brute_scores(model_rows, languages, words):
    """Word first, then the longest known n-gram at each place, by dictionaries."""
    import math

    tables = []
    for n in range(5):
        counts = {}
        for text, lang in model_rows:
            for w in text.lower().split():
                for x in [w] if n == 0 else [f"_{w}_"[i : i + n] for i in range(len(w) + 3 - n)]:
                    counts.setdefault(x, Counter())[lang] += 1
        totals = {k: sum(c[k] for c in counts.values()) for k in languages}
        tables.append({x: [math.log((c[k] + 0.1) / (totals[k] + 100)) for k in languages] for x, c in counts.items()})
    out = {}
    for w in words:
        if w in tables[0]:
            out[w] = tables[0][w]
            continue
        padded, hits = f"_{w}_", []
        for i in range(len(padded)):
            hit = next((tables[n][padded[i : i + n]] for n in range(min(4, len(padded) - i), 0, -1) if padded[i : i + n] in tables[n]), None)
            hits += [hit] if hit else []
        out[w] = [sum(h[j] for h in hits) / len(hits) if hits else 0.0 for j in range(len(languages))]
    return out


def test_backoff_equals_dictionaries(spark):
    rng = random.Random(7)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word("abcdeé" if i % 2 else "dxyzñ") for _ in range(20)), "l1" if i % 2 else "l2") for i in range(60)]
    learned = [(t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 5]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    words = list({word("abcdeéxyzñqw") for _ in range(300)} | set(learned[0][0].split()) | {"w" * 5000})
    want = brute_scores(learned, ["l1", "l2"], words)
    got = model.words(pa.array([w.encode() for w in words], pa.large_binary()))
    assert model.languages == ["l1", "l2"]
    for w, g in zip(words, got, strict=True):
        assert g == pytest.approx(want[w], abs=1e-5), w


def test_held_out_accuracy_and_ties(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    out = [r for r in language.identify(docs, model).where("lang is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(out) > 100 and sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out) and all(0 <= r.score <= 1 for r in out)
    even = spark.createDataFrame([(i, "abc abc", k) for i in range(40) for k in ("q", "p")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(even, language.fit(even)).collect()} == {"p"}


def brute_quality(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality(spark):
    rng = random.Random(3)
    texts = [*ODD, "a b c d e a b c d e a b c d e", "x\nx\n \n \nx", "w1 w2 w3 w4", "\x0b\x0c hello\rworld"]
    texts += [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    good = "A plain sentence of words that ends as it should, with enough of them.\n" * 1
    texts += [good + "Another line, quite different from the first one, with a proper end.", good + "Home | About | Contact | Login | Help"]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(clash(enumerate(texts)), CLASH)).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t), repr(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    last = out[len(texts) - 1]
    assert last.kept and "Home" not in last.clean_text and out[len(texts) - 2].kept
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).where("kept").count() == 0


def test_length_of_short_lines_is_a_parameter(spark):
    """At the border: a line of just that many characters is prose whatever its ending, one character less is not."""
    line = "Word by word it goes on and on and on"
    rows = [(1, f"{line}\n" + "This is a whole sentence, as it should be. " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for short_line, stays in ((len(line), True), (len(line) + 1, False)):
        assert quality.judge(docs, short_line=short_line).collect()[0].clean_text.startswith(line) == stays
