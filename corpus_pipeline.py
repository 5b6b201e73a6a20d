"""Corpus pipeline: the stages that documents go through, in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's documents:

* language: texts whose language cannot be told go;
* near_duplicates: one document of each group of near duplicates stays (the
  smallest id);
* repeats: passages of 100 bytes or more that also start earlier are cut out of
  the texts;
* decontamination: documents that contain a benchmark item go;
* pieces: sampled segmentations of every text that is left.

All but the last return the columns of ``documents``. Null ids, null and empty
texts, repeated rows and extra columns go through as each operator's docstring
says; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelspark.llm import decontam, jaccard, langid, spsample, suffixdedup
from labelspark.session import materialise
from labelspark.sources.tables import table_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_undetermined(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = tuple(c for c in docs.columns if c != "text")
    return suffixdedup.remove_repeats(docs, keep=others, kept_text="text").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(table_path(sf_dir, "benchmark")))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spsample.encode_samples(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("decontamination", decontamination),
    ("pieces", pieces),
]

# learned automata, sampled segmentations: not SQL; tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
