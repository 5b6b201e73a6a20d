"""Scored rows written in steps, each of which counts exactly once (S7), and a bucketed log.

A step's rows go to a folder of their own attempt; only then is one line of the manifest
written, which names the step and the attempt. Readers take the rows of the attempt that the
manifest names first for a step: what a writer left half done has no line, and of a step
that was written twice (a repeat, or two writers at once) one attempt counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField("step", T.StringType()), T.StructField("attempt", T.StringType()), T.StructField("at", T.LongType())])


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _manifest(spark: SparkSession, base: str) -> DataFrame:
    """The attempt that counts for every step: the earliest line, of equal times the smaller attempt."""
    path = f"{base.rstrip('/')}/manifest"
    if not _exists(spark, path):
        return spark.createDataFrame([], MANIFEST).select("step", "attempt")
    lines = spark.read.schema(MANIFEST).json(path)
    return lines.groupBy("step").agg(F.min_by("attempt", F.struct("at", "attempt")).alias("attempt"))


def committed_steps(spark: SparkSession, base: str) -> DataFrame:
    """``step`` of every step that counts."""
    return _manifest(spark, base).select("step")


def stage_step(df: DataFrame, base: str, step) -> str:
    """Write the rows of a step without committing them; the attempt's name."""
    attempt = uuid.uuid4().hex
    # a letter in front keeps Spark from reading the folder names as numbers
    df.write.parquet(f"{base.rstrip('/')}/parts/step=s{step}/attempt=a{attempt}")
    return attempt


def commit_step(spark: SparkSession, base: str, step, attempt: str) -> None:
    """Make a staged attempt count, unless one of its step already does."""
    line = spark.range(1).select(F.lit(f"s{step}").alias("step"), F.lit(f"a{attempt}").alias("attempt"),
                                 F.unix_micros(F.current_timestamp()).alias("at"))
    line.coalesce(1).write.mode("append").json(f"{base.rstrip('/')}/manifest")


def write_step(df: DataFrame, base: str, step) -> bool:
    """Append a step of scored rows; False, and nothing written, if the step is already there."""
    spark = df.sparkSession
    if _manifest(spark, base).where(F.col("step") == f"s{step}").limit(1).count():
        return False
    commit_step(spark, base, step, stage_step(df, base, step))
    return True


def read_steps(spark: SparkSession, base: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of all committed steps, each once.

    The manifest (one line per step) joins the folder columns of the parts, so attempts that do not
    count are pruned before a file is opened. ``schema`` is needed only where nothing may be written yet.
    """
    path = f"{base.rstrip('/')}/parts"
    if not _exists(spark, path):
        if schema is None:
            raise FileNotFoundError(f"no step was written under {base}")
        return spark.createDataFrame([], schema)
    parts = spark.read.parquet(path)
    return parts.join(_manifest(spark, base), ["step", "attempt"], "left_semi").drop("step", "attempt")


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store rows as a table bucketed and sorted by ``key``: a join on ``key`` moves the other side only."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)
