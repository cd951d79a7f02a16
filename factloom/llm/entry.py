"""Queries of the corpus operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license import SECOND_CLAUSE, SIMILAR, TELLS, TEMPLATES, THIRD_CLAUSE, WEAKEST, WRAPPED
from .oracles import REPAIR_SQL, RESAMPLE_SQL
from .quality import ORACLE as QUALITY_SQL


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(spark, read(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentpiece import digest, read_model

    return digest(read(spark, sf_dir, "documents"), read_model(tokenizer("piece_bpe_32k.model")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "clean_text")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, held_out, identify

    docs = read(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import near_vectors

    return near_vectors(read(spark, sf_dir, "embeddings"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents")).drop("text_hash")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer())


def license_paths(docs: DataFrame) -> DataFrame:
    """doc_id, text, path. The table has no paths: a document stands as a file in a folder of a hundred below its source.

    Of the documents that speak of a license a quarter, by crc32 of doc_id, are licence files of their folder and a
    quarter licence files of their source, above the folders.
    """
    folder = F.concat_ws("/", "source", (F.col("doc_id") / 100).cast("long").cast("string"))
    name = F.col("doc_id").cast("string")
    turn = F.when(F.lower("text").contains("licen"), F.crc32(name) % 4)
    path = F.when(turn == 0, F.concat_ws("/LICENSE.", "source", name)).when(turn == 1, F.concat_ws("/LICENSE.", folder, name)).otherwise(F.concat_ws("/", folder, name))
    return docs.select("doc_id", "text", path.alias("path"))


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents state is stored without their text, so that inheritance doesn't score them again."""
    from .common import keep
    from .license import inherit, stated

    marked = keep(stated(license_paths(read(spark, sf_dir, "documents"))).drop("text"), "stated")
    return inherit(marked, marked.rows).select("doc_id", "license", "license_score", "license_from", "inherited_from")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(read(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import repaired_digests

    return repaired_digests(read(spark, sf_dir, "conversations"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_warc": op2_warc,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality": op4_quality,
    "op8_language": op8_language,
    "op5_neighbours": op5_neighbours,
    "op6_minhash": op6_minhash,
    "op7_token_counts": op7_token_counts,
    "op9_license": op9_license,
    "op10_lines": op10_lines,
    "op11_fingerprints": op11_fingerprints,
    "op12_conversations": op12_conversations,
    "op13_resample": op13_resample,
}
#: All pairs, then components by reachability: fit for the small tables of a comparison.
VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.node)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, root AS component_id, vec_id = root AS kept
FROM (SELECT node AS vec_id, min(root) AS root FROM c GROUP BY node)
"""
SHINGLES_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
c AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.node)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, root AS component_id, doc_id = root AS kept
FROM (SELECT node AS doc_id, min(root) AS root FROM c GROUP BY node) LEFT JOIN n USING (doc_id)
"""
#: Digests in base32, five hexadecimal digits at a time.
ARCHIVE_SQL = """
WITH h AS (SELECT page_id, coalesce(html, '') AS t FROM pages), d AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS x FROM h),
c AS (SELECT page_id, n, list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0],
  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, 5 * g + 1, 5) AS BIGINT) >> s) & 31) + 1 AS INTEGER), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, n) AS top FROM c)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m
"""
#: Whether the words of a run tell a license from its relatives.
_TOLD = "CASE name " + " ".join(f"WHEN '{name}' THEN " + " AND ".join([*(f"regexp_matches(said, '{x}')" for x in needs), *(f"NOT regexp_matches(said, '{x}')" for x in nevers)]) for name, (needs, nevers) in TELLS.items()) + " END"
#: All runs of lines against all templates; crc32 bit by bit.
LICENSE_SQL = rf"""
WITH t(i, name, line) AS (VALUES {", ".join(f"({i}, '{name}', '{line}')" for i, (name, line) in enumerate((n, x) for n, group in TEMPLATES.items() for x in group))}),
tw AS (SELECT i, name, w, count(*) AS n FROM (SELECT i, name, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS w FROM t) GROUP BY ALL),
d AS (SELECT doc_id, text, source, lower(text) LIKE '%licen%' AS speaks, CAST(doc_id AS VARCHAR) AS name FROM documents),
crc AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 AS turn FROM d),
p AS (SELECT d.*, coalesce(speaks AND turn < 2, false) AS is_file, source || CASE WHEN speaks AND turn = 0 THEN '' ELSE '/' || (doc_id // 100) END AS folder FROM d JOIN crc USING (doc_id)),
dw AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT v.w, ln((1 + n.n) / (1 + count(dw.doc_id))) + 1 AS x FROM (SELECT DISTINCT w FROM tw) v CROSS JOIN n LEFT JOIN dw USING (w) GROUP BY v.w, n.n),
tx AS (SELECT i, name, w, tw.n * x AS x FROM tw JOIN idf USING (w)),
tv AS (SELECT i, name, w, x / sqrt(sum(x * x) OVER (PARTITION BY i)) AS x FROM tx),
l AS (SELECT doc_id, k, regexp_extract_all(lower(s), '[a-z0-9]+') AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)),
a AS (SELECT doc_id, list(ws ORDER BY k) AS lines FROM l GROUP BY doc_id),
st AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, k, unnest(ws) AS w FROM l) WHERE w IN (SELECT w FROM idf)),
r AS (SELECT doc_id, k * 10 + m AS run, flatten(lines[k:k + m - 1]) AS ws FROM st JOIN a USING (doc_id), range(1, {WRAPPED + 1}) x(m)
  UNION ALL SELECT doc_id, 0, flatten(lines) FROM a JOIN p USING (doc_id) WHERE is_file),
rw AS (SELECT doc_id, run, w, count(*) AS n FROM (SELECT doc_id, run, unnest(ws) AS w FROM r) GROUP BY ALL),
rx AS (SELECT rw.*, rw.n * coalesce(idf.x, ln(1 + n.n) + 1) AS x FROM rw CROSS JOIN n LEFT JOIN idf USING (w)),
no AS (SELECT doc_id, run, sqrt(sum(x * x)) AS norm FROM rx GROUP BY ALL),
sc AS (SELECT doc_id, run, name, round(sum(rx.x * tv.x) / any_value(norm), 9) AS score FROM rx JOIN no USING (doc_id, run) JOIN tv USING (w) GROUP BY doc_id, run, i, name),
cl AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{SECOND_CLAUSE}') THEN ' #second' ELSE '' END || CASE WHEN regexp_matches(lower(text), '{THIRD_CLAUSE}') THEN ' #third' ELSE '' END AS c FROM documents),
be AS (SELECT sc.*, array_to_string(ws, ' ') || c AS said FROM sc JOIN r USING (doc_id, run) JOIN cl USING (doc_id) WHERE score >= {SIMILAR}),
own AS (SELECT doc_id, score, name AS own FROM be WHERE {_TOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY name = '{WEAKEST}', score DESC, name) = 1),
ru AS (SELECT folder AS place, min(own) AS rule FROM own JOIN p USING (doc_id) WHERE is_file GROUP BY folder)
SELECT p.doc_id, coalesce(own.own, near.rule, far.rule) AS license, own.score AS license_score, CASE WHEN own.own IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END WHEN coalesce(near.rule, far.rule) IS NOT NULL THEN 'inherited' END AS license_from,
  CASE WHEN own.own IS NULL THEN coalesce(near.place, far.place) END AS inherited_from
FROM p LEFT JOIN own USING (doc_id) LEFT JOIN ru near ON near.place = p.folder LEFT JOIN ru far ON far.place = p.source
"""
#: Least stretches of lines with 50 words, from each line on and up to each line, by their whole texts.
LINES_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i AS pos, x FROM (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM d)),
w AS (SELECT doc_id, pos, x, len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq
  FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
p AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY seq) AS c FROM w),
s AS (SELECT a.doc_id, a.seq AS f, min(b.seq) AS t FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.seq >= a.seq AND b.c >= a.c - a.n + 50 GROUP BY ALL
  UNION SELECT b.doc_id, max(a.seq), b.seq FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.seq >= a.seq AND b.c >= a.c - a.n + 50 GROUP BY b.doc_id, b.seq),
b AS (SELECT doc_id, list(x ORDER BY seq) AS xs FROM p GROUP BY doc_id),
k AS (SELECT doc_id, f, t, array_to_string(xs[f:t], chr(10)) AS k FROM s JOIN b USING (doc_id)),
h AS (SELECT k, min({'d': doc_id, 'f': f, 't': t}) AS h FROM k GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, seq FROM (SELECT doc_id, unnest(range(f, t + 1)) AS seq FROM k JOIN h USING (k) WHERE NOT (doc_id = h.d AND f <= h.t))),
z AS (SELECT g.doc_id, p.pos, coalesce(q.pos, p.pos + 1) AS upto FROM g JOIN p USING (doc_id, seq) LEFT JOIN g n ON n.doc_id = g.doc_id AND n.seq = g.seq + 1 LEFT JOIN p q ON q.doc_id = n.doc_id AND q.seq = n.seq),
r AS (SELECT DISTINCT doc_id, unnest(range(pos, upto)) AS pos FROM z),
o AS (SELECT l.doc_id, string_agg(x, chr(10) ORDER BY l.pos) AS kept FROM l ANTI JOIN r ON l.doc_id = r.doc_id AND l.pos = r.pos GROUP BY l.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN c.n IS NULL THEN text ELSE coalesce(kept, '') END AS text, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN c USING (doc_id)
"""
ORACLE: dict[str, str] = {
    "op2_warc": ARCHIVE_SQL,
    "op4_quality": QUALITY_SQL,
    "op5_neighbours": VECTORS_SQL,
    "op6_minhash": SHINGLES_SQL,
    "op9_license": LICENSE_SQL,
    "op10_lines": LINES_SQL,
    "op12_conversations": REPAIR_SQL,
    "op13_resample": RESAMPLE_SQL,
}
