"""Extraction on streams. A sentence stands alone, so the batch operator runs unchanged and keeps no state."""

from __future__ import annotations

import json
import sys
import threading
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.store import scratch_path
from ..operators.extract import Configuration, extract, with_confidence


class Spool:
    """Lines of a pipe as numbered files of a folder that all executors see; a file appears whole, once it is written.

    The folder is the memory of an input that can't be read twice: a stream that reads it finds its place again by its
    own checkpoint, and a spool that is opened on it again numbers on.
    """

    def __init__(self, spark: SparkSession, folder: str, lines: int = 10_000, seconds: float = 0.5):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = jvm.org.apache.hadoop.fs.Path
        self.folder, self.lines, self.seconds = folder, lines, seconds
        self.files = self.path(folder).getFileSystem(conf)
        self.files.mkdirs(self.path(folder))
        names = [x.getPath().getName() for x in self.files.listStatus(self.path(folder))]
        ends = [int(x[:-5].split("-")[1]) for x in names if x.endswith(".json") and x[0] not in "._"]
        self.number, self.held, self.since = max(ends, default=-1) + 1, [], time.monotonic()

    def add(self, line: str) -> None:
        self.held.append(json.dumps({"sentence": line.rstrip("\r\n"), "number": self.number + len(self.held)}))
        if len(self.held) >= self.lines or time.monotonic() - self.since > self.seconds:
            self.flush()

    def flush(self) -> None:
        if self.held:
            name = f"{self.number:015d}-{self.number + len(self.held) - 1:015d}.json"
            hidden = self.path(self.folder, f".{name}")  # readers pass over hidden files
            out = self.files.create(hidden, True)
            out.write(bytearray(("\n".join(self.held) + "\n").encode()))
            out.close()
            self.files.rename(hidden, self.path(self.folder, name))
            self.number, self.held = self.number + len(self.held), []
        self.since = time.monotonic()

    def close(self) -> None:
        self.flush()


def sentence_stream(spark: SparkSession, folder: str) -> DataFrame:
    """sentence, number: what a spool's folder holds and what still comes, each line once for each checkpoint."""
    return spark.readStream.schema("sentence string, number long").json(folder).where(F.trim("sentence") != "")


def console(
    spark: SparkSession, answer: Callable[[DataFrame], DataFrame], stream: Iterable[str] | None = None, say: Callable[[str], None] = print, folder: str | None = None, checkpoint: str | None = None, prompt: str | None = None,
) -> StreamingQuery:
    """Answers the lines of a console as they come: ``answer`` makes lines (number, line) of each small batch of sentences
    (sentence, number), which are said in order of number. Returns the running query; it ends when the input does.

    With a folder and a checkpoint of its own a later call goes on where an earlier one stopped.
    """
    stream = sys.stdin if stream is None else stream
    folder = folder or scratch_path(spark, "console")
    spool = Spool(spark, folder, seconds=0.0)

    def turn(batch: DataFrame, _: int) -> None:
        for row in answer(batch).select("number", "line").orderBy("number", "line").toLocalIterator():
            say(row["line"])
        if prompt:
            say(prompt)

    query = sentence_stream(spark, folder).writeStream.foreachBatch(turn).option("checkpointLocation", checkpoint or scratch_path(spark, "console-checkpoint")).start()

    def feed() -> None:
        if prompt:
            say(prompt)
        for line in stream:
            spool.add(line)
        spool.close()
        query.processAllAvailable()
        query.stop()

    query.feeder = threading.Thread(target=feed, daemon=True)
    query.feeder.start()
    return query


def extract_stream(sentences: DataFrame, model: list[str] | None = None, config: Configuration | None = None, weights: dict[str, float] | None = None, threshold: float = 0.0) -> DataFrame:
    return with_confidence(extract(sentences, model, config), weights, threshold)


def relation_counts(extractions: DataFrame, ts: str, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Tumbling counts of relations; rows later than the watermark are dropped by the engine."""
    return extractions.withWatermark(ts, late).groupBy(F.window(ts, every), F.col("rel.text").alias("relation")).agg(F.count("*").alias("n"))
