"""Thin queries of the numbered operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelspark.llm import (decontam, jaccard, langid, lm, quality, rulefit, runs, spsample, suffixdedup, tokenfile, toxicity, urlgraph,
                            vectorcode)
from labelspark.llm import textops as tx
from labelspark.sources.tables import table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), tx.fold("doc_id", 10) != 0)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spsample.encode_samples(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge_urls(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.encode_documents(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(runs.planted_copies(table(spark, sf_dir, "documents")))
    return found.drop("runs", "kept_text")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcode.compress(table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulefit.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f for f in (op1_lm_score, op2_jaccard_join, op3_suffix_dedup, op4_sample_pieces, op5_url_filter,
                            op6_decontaminate, op7_quality, op8_token_files, op9_language, op10_toxicity, op11_periodic_runs,
                            op12_vector_codes, op13_quality_rules)
}

ORACLES = {
    "op2_jaccard_join": jaccard.ORACLE,
    "op5_url_filter": urlgraph.oracle(),
    "op6_decontaminate": decontam.ORACLE,
    "op11_periodic_runs": runs.ORACLE,
    "op12_vector_codes": vectorcode.ORACLE,
}
