"""Posts to score: column harmonising (S5), categorical filters (P3) and
integer surrogate ids (P7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.operators.ordering import PIECE_ROWS, hash_positions

ID_CANDIDATES = ("comment_id", "item_id", "data_id")
TEXT_CANDIDATES = ("cleaned_text", "tweet")


def harmonise_posts(df: DataFrame) -> DataFrame:
    """First present of ``comment_id``, ``item_id``, ``data_id`` becomes the
    string ``item_id``; ``cleaned_text`` (else ``tweet``) becomes ``text``.

    Chosen from the schema at plan time; no data is touched.
    """
    cols = df.columns
    id_col = next((c for c in ID_CANDIDATES if c in cols), None)
    if id_col is None:
        raise ValueError(f"no id column among {ID_CANDIDATES}; columns are {cols}")
    out = df
    if id_col != "item_id":
        if "item_id" in cols:
            out = out.drop("item_id")
        out = out.withColumnRenamed(id_col, "item_id")
    out = out.withColumn("item_id", F.col("item_id").cast("string"))
    if "text" not in cols:
        text_col = next((c for c in TEXT_CANDIDATES if c in cols), None)
        if text_col is not None:
            out = out.withColumnRenamed(text_col, "text")
    return out


def filter_posts(df: DataFrame, item_type: str = "reply", author_type: str = "by_public",
                 duplicates: Sequence[str] = ("no duplicates", "first duplicate")) -> DataFrame:
    """Conjunction of categorical predicates with one OR (P3); all of it
    reaches the scan as pushed filters when the input is stored data."""
    return df.where((F.col("item_type") == item_type) & (F.col("author_type") == author_type)
                    & F.col("duplicates").isin(*duplicates))


def surrogate_ids(df: DataFrame, key: str = "item_id", seed: int = 51, out: str = "data_id",
                  all_integers: bool | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Integer id per row.

    If every key parses as an integer, the parsed value is the id. Otherwise
    (a null key does not parse) every row gets a dense, deterministic id
    ``1..N`` in seeded hash order of the key, so rows with null or repeated
    keys keep ids of their own (the reference draws unique random integers;
    ours are unique and reproducible). The dense path ranks by levels of the
    hash (see ``ordering``), with no global sort.
    """
    parsed = F.col(key).cast("string").try_cast("bigint")
    if all_integers is None:
        all_integers = df.agg(F.count_if(parsed.isNull()).alias("bad")).first()["bad"] == 0
    if all_integers:
        return df.withColumn(out, parsed)
    pos = hash_positions(df, key, seed, out="_pos", piece_rows=piece_rows)
    return pos.withColumn(out, (F.col("_pos") + 1).cast("bigint")).drop("_pos")
