"""The pipeline's stages on a small table."""

from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    good = "This is a plain sentence number {i} with quite enough different words in it to be kept by all rules.\nIt has a second line {i} that ends well, too, as lines of prose should do."
    rows = [(i, good.format(i=f"x{i} y{i * 7} z{i * 13}"), "en", "s", 0) for i in range(20)]
    rows += [(30, "123 456", "en", "s", 0), (31, None, None, None, None), (32, "Home | About | Help | Login | More | Next | Last | Top | Up | On", "en", "s", 0), (33, rows[3][1], "en", "s", 0)]
    rows += [rows[5], (40, "A long line of words that goes on and on, number after number. " + " ".join(f"w{k}." for k in range(9000)), "en", "s", 0), (None, good.format(i="q1 q2 q3"), "en", "s", 0)]
    extra = ("kept", "score", "row", "n_removed", "text_hash", "gone_id", "clean_text")
    df = spark.createDataFrame([(*r, *[f"own {c}" for c in extra]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    out = docs.collect()
    kept = {r.doc_id for r in out}
    assert all(r[c] == f"own {c}" for r in out for c in extra) and sum(r.doc_id == 5 for r in out) == 2 and {40, None} <= kept
    assert set(range(20)) <= kept and not kept & {30, 31, 32, 33}
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == kept
    empty = docs.where("false")
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_near_copies_from_80_percent(spark, tmp_path):
    """A pair in [0.80, 0.85) is one group for the stage; a pair below 0.80 isn't."""
    import corpus_pipeline as pipeline

    rows = []
    for i in range(40):
        words = [f"w{i}x{k}" for k in range(104)]
        rows.append((2 * i, " ".join(words)))
        # 100 shingles; 10 of them lost on each side: 90 / 110 = 0.818, or 14: 86 / 114 = 0.754
        for at in (20, 60) if i < 30 else (20, 60, 100):
            words[at] += "y"
        rows.append((2 * i + 1, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.near_copies(spark, docs, str(tmp_path)).collect()}
    assert kept == {2 * i for i in range(40)} | {2 * i + 1 for i in range(30, 40)}


def test_run_equals_the_plain_pipeline(spark, tmp_path):
    """All rows of run() over generated documents and the smallest table, against plain versions of the five stages."""
    import random

    from factloom.llm.packing import CAPACITY, best_fit, least_sequences

    from . import plain_pipeline as plain
    from .test_groups import passages

    import corpus_pipeline as pipeline

    rng = random.Random(12)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    rows = [(r.doc_id, r.text, r.lang) for r in table]
    base = max(r[0] for r in rows) + 1
    prose = [t for _, t, _ in rows if t and 300 < len(t) < 3000 and "\n" not in t]
    for i in range(60):  # near copies around the bar, wrapped passages, navigation, noise
        words = rng.choice(prose).split(" ")
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(["sondern", "zwischen", "whereas", "pourtant"])
        text = " ".join(words)
        if i % 4 == 0:
            text += "\n" + rng.choice(["Home | About | Help", "!!!!", "SUBSCRIBE TO OUR NEWSLETTER TODAY AND SAVE MONEY", "It ends here."])
        rows.append((base + i, text, rng.choice(["en", "de", None])))
    rows += [(base + 100 + i, t, None) for i, t in passages(4)[:40]]
    spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    left = plain.kept(rows)
    assert 150 < len(left) < len(rows)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(plain.pieces(left))
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= CAPACITY
    have = {}
    for r in out:
        have[r.length] = have.get(r.length, 0) + 1
    assert least_sequences(have, CAPACITY) <= len(places) <= sum(n for _, n in best_fit(have, CAPACITY))
