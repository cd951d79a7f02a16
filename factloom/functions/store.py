"""Intermediate tables in the folder that all executors share, and names that no column of a table has."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each changed until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or the one that the session's checkpoints were set to. Where
    neither is set, a temporary folder is set on a local master, whose executor shares it; any other master raises."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="factloom-")
        shared_dir.own = place
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(place)
    return place if "://" in place else "file://" + os.path.abspath(place)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back. Lost executors don't undo it.

    The result's ``rows`` and ``digest`` (the exclusive or of the rows' hashes) are gathered while it is written.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    seen = Observation()
    hashed = [F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith("map")]
    writer = df.observe(seen, F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*hashed)).alias("digest")).write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path, out.rows, out.digest = path, seen.get["rows"], seen.get["digest"]
    return out


def forget(df: DataFrame) -> None:
    """Deletes what keep() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "scratch_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
