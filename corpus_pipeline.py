"""From raw documents to packed training sequences: language, quality, repeated passages, near copies, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents, with n_chars brought up to date where the text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import free, keep
from factloom.llm.entry import read, tokenizer
from factloom.llm.language import UNKNOWN, fit, identify
from factloom.llm.linededup import dedup_lines
from factloom.llm.minhash import near_duplicates
from factloom.llm.packing import pack
from factloom.llm.quality import judge

#: A document stays if its language is told with at least this share; by chance the best of four languages has a quarter.
LEAST_SCORE = 0.3
#: Percent of common word shingles from which on two documents are near copies.
SIMILAR = 80


def _packed(docs: DataFrame, *also: str) -> DataFrame:
    """text, the columns named, and all others of docs inside one: an operator's results can't clash with any of them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("row"), *also, "text")


def _unpacked(rows: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns of documents again, with this text; n_chars is its length where it changed."""
    value = {"text": F.col(text).alias("text")}
    if text != "text":
        value["n_chars"] = F.length(text).cast("long").alias("n_chars")
    return rows.select(*[value.get(c, F.col(f"row.`{c}`").alias(c)) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose language can't be told.

    A null or empty text goes. Of equally likely languages the first in order of name counts. With no labelled row to
    learn from every text with a letter stays. Long texts are read whole, repeated rows judged alike; other columns may be
    called anything.
    """
    model = fit(docs.select("doc_id", "text", "lang"))
    told = identify(_packed(docs), model)
    # with nothing to learn from no language is told, and none is a reason to drop a text
    sure = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return _unpacked(told.where(sure if model.languages else F.col("text").rlike(r"\p{L}")), docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base or the line rules reject; the others lose their failing lines.

    A null or empty text goes. Long texts are judged whole, repeated rows alike; there are no ties. Other columns may be
    called anything.
    """
    return _unpacked(judge(_packed(docs)).where("kept"), docs.columns, "clean_text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out repeated passages; a document of which nothing is left goes.

    The first place by doc_id stays, a null doc_id before all. Null and empty texts stay as they are. Rows that repeat
    doc_id and text are treated alike. Long texts are handled whole; other columns may be called anything.
    """
    out = dedup_lines(_packed(docs, "doc_id")).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    # the text is another one only where lines went; the length of any other is kept as it is
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[F.col("text") if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies.

    Rows that repeat doc_id and text are one document and stay or go together; those that repeat doc_id alone are judged
    each. A null doc_id or text stays; so does a text without words. Long texts are hashed whole; other columns may be
    called anything.
    """
    gone_id, text_hash = free(docs.columns, "gone_id", "text_hash")
    gone = near_duplicates(docs, similar=SIMILAR).where("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(text_hash)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(gone_id)) & (F.xxhash64("text") == F.col(text_hash)), "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences (see factloom.llm.packing.pack).

    A null or empty text is a document of the end token alone. Very long texts are cut into pieces. A null doc_id is kept;
    rows that repeat a doc_id are documents of their own. Ties may be packed in any order. With no documents the result is
    empty. Other columns, whatever they are called, are left out.
    """
    return pack(docs, tokenizer())


STAGES = [("language", language), ("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("packing", packing)]
#: SQL has no tokenizer, no signatures and no search for fillings.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = keep(docs, name)
    return docs


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL}
