"""Derived input views (``fx_*``) built from the given tables.

The reference ships no data; these views derive equivalent inputs from
``documents`` and ``events`` so every branch of consensus, gating, dedup and
splitting is hit. They are written with the DataFrame API; the DuckDB oracle
builds the same views independently in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.operators.ordering import dense_positions
from labelspark.sources.tables import read_table

# fixed values
_L2_NAMES = ["IDEOLOGICAL-INEQUALITY", "STEREOTYPING-DOMINANCE", "OBJECTIFICATION",
             "SEXUAL-VIOLENCE", "MISOGYNY-NON-SEXUAL-VIOLENCE", "UNKNOWN"]


def _case_name(expr):
    out = None
    for i, name in enumerate(_L2_NAMES):
        out = F.when(expr == i, F.lit(name)) if out is None else out.when(expr == i, F.lit(name))
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def fx_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    sid = F.col("doc_id").cast("string")
    m8 = F.col("doc_id") % 8
    m5 = F.col("doc_id") % 5
    tweet = (F.when(m8 == 0, F.concat(F.lit("RT @user"), sid, F.lit(" "), F.col("text")))
             .when(m8 == 1, F.concat(F.lit("@ab_"), sid, F.lit("-x "), F.col("text"),
                                     F.lit(" https://t.co/a"), sid))
             .when(m8 == 2, F.concat(F.col("text"), F.lit(" &amp; &#39;x bit.ly/z"), sid,
                                     F.lit(" end")))
             .when(m8 == 3, F.concat(F.lit("<MENTION_1> <MENTION_0> "), F.col("text"),
                                     F.lit(" <URL>")))
             .when(m8 == 4, F.lit(None).cast("string"))
             .otherwise(F.col("text")))
    split = (F.when((F.col("lang") == "en") & (m5 == 0), "DEV_EN")
             .when(F.col("lang") == "en", "TRAIN_EN")
             .when((F.col("lang") == "es") & (m5 == 0), "DEV_ES")
             .when(F.col("lang") == "es", "TRAIN_ES").otherwise("OTHER"))
    # duplicate marks: one aggregate per text (partial aggregation, no window
    # holding a hot text in one task), joined back. Texts are grouped by their
    # SHA-256 digest: 32 bytes cross the shuffle instead of the whole text
    # (texts run to 20,000 words); a collision is not a practical concern.
    # Null texts are one group of copies, under an empty digest. Every row has
    # its group, so the join keeps all rows: as a left join it is dropped where
    # no duplicate mark is read.
    d = d.withColumn("_tk", F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")))
    dup = (d.groupBy("_tk").agg(F.count(F.lit(1)).alias("_n"),
                                F.min("doc_id").alias("_first")))
    duplicates = (F.when(F.col("_n") == 1, "no duplicates")
                  .when(F.col("doc_id") == F.col("_first"), "first duplicate")
                  .otherwise("duplicate"))
    return (d.join(dup, "_tk", "left")
            .select("doc_id", sid.alias("item_id"), F.col("text").alias("cleaned_text"),
                    "lang", "source", tweet.alias("tweet"), split.alias("split"),
                    F.when(F.col("doc_id") % 3 == 0, "post").otherwise("reply").alias("item_type"),
                    F.when(F.col("doc_id") % 4 == 0, "by_politician")
                     .otherwise("by_public").alias("author_type"),
                    F.when(m5.isin(0, 1), "Female").when(m5.isin(2, 3), "Male")
                     .alias("gender"),
                    duplicates.alias("duplicates")))


def fx_votes1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id").where(F.col("doc_id") % 29 != 0)
    a = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("annotator"))
    label = F.when((F.col("annotator") + F.col("doc_id")) % 6 < F.col("doc_id") % 7, "NO") \
             .otherwise("YES")
    return a.select("doc_id", "annotator", label.alias("label"))


def fx_votes2(spark: SparkSession, sf_dir: str) -> DataFrame:
    v1 = fx_votes1(spark, sf_dir)
    first = (F.col("doc_id") * 3 + F.col("annotator") % 3 * (F.col("doc_id") % 4)) % 6
    one = v1.select(
        "doc_id", "annotator",
        F.when((F.col("label") == "NO") & (F.col("doc_id") % 10 != 9), F.lit("-"))
         .otherwise(_case_name(first)).alias("label"))
    two = (v1.where((F.col("label") == "YES") & ((F.col("doc_id") + F.col("annotator")) % 3 == 0))
           .select("doc_id", "annotator", _case_name((F.col("doc_id") + 2) % 6).alias("label")))
    return one.unionByName(two)


def _grid(mult: int, add: int):
    return ((F.col("doc_id") * mult + add) % 101 - 50) / F.lit(20.0)


def fx_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id")
    b0 = _grid(37, 0)
    b1 = F.when(F.col("doc_id") % 50 == 7, b0).otherwise(_grid(59, 11))
    cats = [_grid(m, a).alias(f"c{i}") for i, (m, a) in
            enumerate([(41, 0), (55, 7), (69, 14), (83, 21), (97, 28), (111, 35)])]
    return d.select("doc_id", b0.alias("b0"), b1.alias("b1"), *cats)


def fx_scored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id")
    b = d.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("batch_id"))
    keep = (((F.col("batch_id") == 0) & (F.col("doc_id") % 3 == 0))
            | ((F.col("batch_id") == 1) & (F.col("doc_id") % 3 == 1))
            | ((F.col("batch_id") == 2) & (F.col("doc_id") % 12 == 0)))
    return b.where(keep).select("doc_id", "batch_id",
                                ((F.col("doc_id") * 7 + F.col("batch_id")) % 2).alias("pred_binary"))


def fx_metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One validation log per user id, checks numbered in event order.

    Numbered with ``dense_positions`` bucketed by hour (an hour holding too
    many events is split again by second), so a user holding a large share
    of events is still ranked in many small windows.
    """
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    # hour number straight from the wall-clock value (no time-zone shifts)
    hour = (F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint") * 24
            + F.hour("ts"))
    pos = dense_positions(e, ["ts", "event_id"], hour, group=["user_id"], out="_pos",
                          refine=[F.date_trunc("second", "ts")])
    return pos.select(F.col("user_id").alias("run_id"),
                      (F.col("_pos") + 1).cast("bigint").alias("check_no"),
                      F.col("value").alias("val_loss"))


FIXTURES = {
    "fx_posts": fx_posts, "fx_votes1": fx_votes1, "fx_votes2": fx_votes2,
    "fx_scores": fx_scores, "fx_scored_log": fx_scored_log, "fx_metric_log": fx_metric_log,
}
