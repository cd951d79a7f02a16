"""Columns of the input may be called like anything an operator uses inside."""

import public_tokenizers
import pytest

from factloom.llm import language, linededup, packing, quality, sentpiece, tokens, warc
from factloom.llm import license as lic

BPE = public_tokenizers.path("byte_bpe_50k.json")
NAMES = (
    "hot_key", "hot", "cold_key", "spread", "cold", "k", "h", "n", "m", "l", "x", "i", "w", "lo", "hi", "ck", "bad", "gone", "left", "marks", "again", "bag", "size", "hashes", "twice", "order",
    "places", "lines", "full", "left_lines", "enough", "text_hash", "all_lines", "body", "top", "own", "present", "bags", "best", "folder", "need", "rule", "rule_dir", "files", "depth",
    "text_again", "lang_pred", "score", "kept", "license", "_text", "_k", "_h", "_bucket", "length", "piece", "count", "first", "last", "home", "set_key", "sig", "rows", "component",
)
TEXT = "A plain line of words that ends as it should, with enough of them.\nReleased under the MIT License."


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, TEXT, "a/f.py"), (2, TEXT + "\nMore of it.", "a/LICENSE"), (3, None, None), (4, "", "b"), (1, TEXT, "a/f.py")]
    return spark.createDataFrame([(*r, *[f"own{i}" for i in range(len(NAMES))]) for r in rows], ["doc_id", "text", "path", *NAMES])


@pytest.mark.parametrize("operator", ["judge", "dedup_lines", "scan", "identify"])
def test_columns_come_back_untouched(spark, table, operator):
    model = language.Model([], [])
    run = {"judge": quality.judge, "dedup_lines": linededup.dedup_lines, "scan": lic.scan, "identify": lambda d: language.identify(d, model)}[operator]
    results = {"judge": {"kept"}, "dedup_lines": set(), "scan": {"license"}, "identify": {"lang_pred", "score"}}[operator]
    out = run(table).collect()
    assert len(out) == 5
    for r in out:
        assert all(r[name] == f"own{i}" for i, name in enumerate(NAMES) if name not in results)


def test_others_ignore_them(spark, table):
    assert packing.pack(table, BPE).count() == 5
    assert tokens.token_counts(table.select("doc_id", "text"), BPE).count() == 5
    assert sentpiece.encode(table, sentpiece.read_model(public_tokenizers.path("piece_bpe_32k.model"))).count() == 5
    pages = table.selectExpr("doc_id as page_id", "path as url", "text as html", *NAMES)
    assert warc.round_trip(spark, pages).count() == 5
