"""Dedup, seeded samples, stratified splits, shuffles and batches.

Reference draws come from numpy/pandas/sklearn generators and cannot be
reproduced bit for bit. Contract here: the same sizes and strata, rows
chosen by ascending ``md5(concat(seed, ':', key))`` with the key as
tie-break. No draw sorts the whole table or puts a whole stratum in one
task: exact cutoffs come from a bucketed hash histogram (``ordering``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspark.operators.ordering import (HASH_COL, PIECE_ROWS, TIE_COL, cutoff_select,
                                           hash_positions, row_hash, seeded_hash)
from labelspark.session import materialise


def dedup_first(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key by ``order``.

    ``min_by`` over a struct of the order columns is a partial aggregate, so
    a key repeated many times is reduced map-side before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordering).alias("_first"))
    return agg.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def _draw_seed(seed: int, draw: str) -> str:
    """Each kind of draw has its own hash order, so the rows one holds out are
    not the rows another samples under the same seed."""
    return f"{seed}:{draw}"


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42, strict: bool = False,
             piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Exactly ``min(n, N)`` rows, the ``n`` first in seeded hash order.

    A plain top-k would send ``n`` rows from every partition into one task;
    the cutoff select ranks only the bucket where the ``n``-th row falls.
    ``strict`` raises if there are fewer than ``n`` rows (the pandas
    behaviour)."""
    if strict and df.count() < n:
        raise ValueError(f"cannot draw {n} rows: the table has fewer")

    def take(counts):
        return counts.select(F.least(F.lit(int(n)).cast("bigint"), F.col("_c")).alias("n_take"))

    return cutoff_select(df, key, _draw_seed(seed, "sample_n"), take, flag="_taken",
                         piece_rows=piece_rows).where("_taken").drop("_taken")


def sample_frac(df: DataFrame, frac: float, key: str, seed: int = 42,
                piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Exactly ``round(frac * N)`` rows (round half to even, as Python's
    ``round``) in seeded hash order (D3)."""
    def take(counts):
        return counts.select(F.bround(F.lit(float(frac)) * F.col("_c"), 0).alias("n_take"))

    return cutoff_select(df, key, _draw_seed(seed, "sample_frac"), take, flag="_taken",
                         piece_rows=piece_rows).where("_taken").drop("_taken")


def split_sizes(counts: DataFrame, stratum: str, test_size: float) -> DataFrame:
    """Held-out rows per stratum for a stratified split.

    ``n_test = ceil(test_size * N)``; the training share ``N - n_test`` is
    spread over strata by largest remainder of ``count / N * n_train``
    (ties to the smaller stratum value); each stratum holds out the rest.
    ``counts`` holds the rows per stratum (``_c``). Strata are ranked in ranges of the
    order (remainder, stratum) of at most about ``PIECE_ROWS`` each, with the ranges' sizes as
    offsets, so no task holds all strata.
    """
    counts = materialise(counts.select(stratum, "_c"), "strata")
    told = counts.agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("strata")).first()
    total = told["n"] or 0
    n_train = F.lit(total) - F.ceil(F.lit(float(test_size)) * F.lit(total))
    cont = F.col("_c") / F.lit(total) * n_train if total else F.lit(0.0)
    alloc = counts.select(stratum, "_c", cont.alias("_cont"), n_train.alias("_n_train"))
    alloc = alloc.withColumn("_floor", F.floor("_cont")).withColumn(
        "_rem", F.col("_cont") - F.col("_floor"))
    order = [F.col("_rem").desc(), F.col(stratum)]
    ranges = 1 + 2 * told["strata"] // PIECE_ROWS
    if ranges > 1:
        # written with its range, which is then fixed however often the plan runs
        alloc = materialise(alloc.repartitionByRange(ranges, *order).withColumn("_p", F.spark_partition_id()), "strata-ranges")
    else:
        alloc = alloc.withColumn("_p", F.lit(0))
    sizes = alloc.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.sum("_floor").alias("_f"), F.max("_n_train").alias("_t"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    everything = Window.partitionBy(F.lit(0))
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                           (F.col("_t") - F.sum("_f").over(everything)).alias("_extra"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_off")
    alloc = alloc.join(offsets, "_p").withColumn("_train", F.col("_floor") + (rank <= F.col("_extra")).cast("bigint"))
    return alloc.select(stratum, (F.col("_c") - F.col("_train")).cast("bigint").alias("n_take"))


def stratified_split(df: DataFrame, stratum: str, test_size: float, key: str,
                     seed: int = 42, out: str = "part", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Stratified two-way split (D4): ``out`` is ``held_out`` or ``train``.

    The held-out rows of each stratum are the first ones in seeded hash
    order; exact per-stratum sizes, no stratum ranked in one task.
    """
    flagged = cutoff_select(df, key, _draw_seed(seed, "stratified_split"),
                            lambda counts: split_sizes(counts, stratum, test_size),
                            strata=[stratum], flag="_held", piece_rows=piece_rows)
    return flagged.withColumn(out, F.when(F.col("_held"), "held_out").otherwise("train")) \
                  .drop("_held")


def sample_per_group(df: DataFrame, group: str | Sequence[str], n: int, key: str,
                     seed: int = 42, strict: bool = False) -> DataFrame:
    """``n`` rows per group in seeded hash order.

    ``row_number() <= n`` lets Spark insert a partial window-group limit
    before the shuffle, so each map task sends at most ``n`` rows per group
    and a hot group never arrives whole. ``strict`` raises if a group has
    fewer than ``n`` rows (the pandas behaviour).
    """
    groups = [group] if isinstance(group, str) else list(group)
    if strict:
        short = df.groupBy(*groups).count().where(F.col("count") < n).limit(1).collect()
        if short:
            raise ValueError(f"group {short[0].asDict()} has fewer than {n} rows")
    w = Window.partitionBy(*groups).orderBy(HASH_COL, key, TIE_COL)
    return (df.withColumn(TIE_COL, row_hash(df)).withColumn(HASH_COL, seeded_hash(key, seed))
            .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
            .drop(HASH_COL, TIE_COL, "_rn"))


def shuffle_rows(df: DataFrame, key: str, seed: int = 42, out: str = "pos",
                 ordered: bool = False) -> DataFrame:
    """Seeded shuffle (D6): dense position in hash order; with ``ordered``
    the rows are also range-partitioned and sorted by that position."""
    pos = hash_positions(df, key, seed, out=out)
    if ordered:
        pos = pos.repartitionByRange(out).sortWithinPartitions(out)
    return pos


def batch_ids(df: DataFrame, key: str, batch_size: int, seed: int = 42,
              out: str = "batch_id", position: str | None = None) -> DataFrame:
    """Cut an ordered table into batches of ``batch_size`` (D7); the last
    batch is short. The order is the seeded shuffle (training loaders), or
    an existing dense 0-based ``position`` column, such as the file row
    index of ``attach_row_index`` (scoring keeps input order)."""
    if position is not None:
        return df.withColumn(out, F.floor(F.col(position) / F.lit(batch_size)).cast("bigint"))
    pos = hash_positions(df, key, seed, out="_pos")
    return pos.withColumn(out, F.floor(F.col("_pos") / F.lit(batch_size)).cast("bigint")).drop("_pos")
