"""Seeded hash order, dense positions and exact cutoff selection.

Every seeded draw in the library ranks rows by ascending
``md5(concat(seed, ':', key))`` with the key as tie-break (and a hash of the
whole row after that, so ties between duplicate keys resolve the same way on
every run). Ranking a whole table (or a whole stratum) in one window would put
it on one task, so rows are ranked by levels, each with at most 65,536 values
below one value of the level before: a histogram per level gives every piece
its offset, pieces of at most ``piece_rows`` rows are ranked, and only larger
ones go on to the next level. The levels are four hex digits of the hash, four
more, hash and key, then 16 bits at a time of the row hash and, for copies of
one row, of a row number written with the rows. A larger table needs one more
level about every 65,536-fold; a repeated key or a copied row goes down until
it is split, so no window holds more than a piece and no offset window more
than 65,536 rows (or the distinct keys of one piece).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_COL = "_h"
BUCKET_COL = "_b"
TIE_COL = "_t"
ROW_COL = "_r"
PIECE_ROWS = 1 << 16  # rows one ranking window may hold


def seeded_hash(key: Column | str, seed: int | str) -> Column:
    """``md5(concat(seed, ':', key))`` as lowercase hex; a null key hashes
    like the empty string (null keys are then ties, broken by the row hash)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"),
                          F.coalesce(key.cast("string"), F.lit(""))))


def hash_bucket(h: Column, digits: int = 4) -> Column:
    """Integer value of the first ``digits`` hex digits of a hash."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def row_hash(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    """64-bit hash of a row's columns: the last tie-break between rows with
    the same key. Rows equal in every column stay tied, and are
    interchangeable."""
    return F.xxhash64(*(cols if cols is not None else df.columns))


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _join_on(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` where null matches null (a null group or
    stratum is a group like any other); keeps one copy of each key column."""
    cols = list(cols)
    r = right.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(cols)],
                     *[c for c in right.columns if c not in cols])
    cond = None
    for i, c in enumerate(cols):
        e = left[c].eqNullSafe(r[f"_r{i}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"_r{i}" for i in range(len(cols))])


def dense_positions(df: DataFrame, order: Sequence[str | Column], bucket: Column,
                    group: Sequence[str] = (), out: str = "pos",
                    refine: Sequence[Column] = (), piece_rows: int = PIECE_ROWS,
                    bounded: bool = False) -> DataFrame:
    """Add a 0-based dense position by ``order`` (within ``group``).

    ``bucket`` and the columns of ``refine`` are the levels: within equal
    values of the ones before, none decreases along ``order``. Rows are ranked
    inside a piece (equal values of the levels so far) once it has at most
    ``piece_rows`` rows, or no level is left. ``df`` should be stored data: it
    is read once per level that is needed. ``bounded``: there are no groups and
    ``bucket`` has at most 65,536 values, so its offsets may be broadcast.
    """
    from labelspark.session import materialise

    group, levels = list(group), [bucket, *refine]
    names = [f"{BUCKET_COL}{k}" for k in range(len(levels))]
    left = df.withColumn("_off", F.lit(0).cast("bigint"))
    found = []
    for k, (name, level) in enumerate(zip(names, levels)):
        before = [*group, *names[:k]]
        left = left.withColumn(name, level)
        sizes = materialise(left.groupBy(*before, name).agg(F.count(F.lit(1)).alias("_n")), "positions")
        w = Window.partitionBy(*(before or [F.lit(0)])).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.withColumn("_skip", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        if bounded and k == 0 and not group:
            offsets = F.broadcast(offsets)
        placed = (_join_on(left, offsets, [*before, name])
                  .withColumn("_off", F.col("_off") + F.col("_skip")).drop("_skip"))
        last = k + 1 == len(levels) or not sizes.where(F.col("_n") > piece_rows).limit(1).count()
        small = placed if last else placed.where(F.col("_n") <= piece_rows)
        inside = Window.partitionBy(*before, name).orderBy(*_cols(order))
        found.append(small.withColumn(out, F.col("_off") + F.row_number().over(inside) - 1)
                     .drop("_n", "_off", *names[: k + 1]))
        if last:
            break
        left = placed.where(F.col("_n") > piece_rows).drop("_n")
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _hash_levels(key: str, digits: int = 4) -> list[Column]:
    """Levels of (hash, key, row hash, row number) after the first digits of the hash."""
    def bits(c: str, k: int) -> Column:
        value = F.shiftrightunsigned(F.col(c), 48 - 16 * k).bitwiseAND(F.lit(0xFFFF))
        # the row hash is signed: its top bits are ordered as signed
        return F.when(value >= 0x8000, value - 0x10000).otherwise(value) if k == 0 else value

    return [hash_bucket(F.substring(HASH_COL, digits + 1, 4)), F.struct(F.col(HASH_COL), F.col(key).alias("key")),
            *[bits(TIE_COL, k) for k in range(4)], *[bits(ROW_COL, k) for k in range(4)]]


def _with_order(df: DataFrame, key: str, seed: int | str) -> DataFrame:
    return df.withColumn(TIE_COL, row_hash(df)).withColumn(HASH_COL, seeded_hash(key, seed))


def hash_positions(df: DataFrame, key: str, seed: int | str, out: str = "pos",
                   digits: int = 4, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Dense 0-based position of each row in seeded hash order.

    The rows are written once, with their hashes and a row number, and ranked
    from there."""
    from labelspark.session import materialise

    stored = materialise(_with_order(df, key, seed).withColumn(ROW_COL, F.monotonically_increasing_id()), "ordered")
    return dense_positions(stored, [HASH_COL, key, TIE_COL, ROW_COL], hash_bucket(F.col(HASH_COL), digits), out=out,
                           refine=_hash_levels(key, digits), piece_rows=piece_rows,
                           bounded=digits <= 4).drop(HASH_COL, TIE_COL, ROW_COL)


def cutoff_select(df: DataFrame, key: str, seed: int | str,
                  n_take: Callable[[DataFrame], DataFrame], strata: Sequence[str] = (),
                  flag: str = "taken", digits: int = 4, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Flag the first ``n_take`` rows of each stratum in seeded hash order.

    ``n_take`` maps the row count per stratum (``strata`` columns and
    ``_c``; one row without strata) to the rows to take (``strata`` columns
    and ``n_take``), so the sizes come from the histogram, not from another
    pass over the input.

    No global sort and no whole stratum in one window. Pass 1 is the hash
    histogram, reduced to a small per-bucket status table that is written
    once; whole buckets below the cutoff are flagged by a join against it.
    Only the cutoff bucket of each stratum needs ranking: its rows (about
    ``rows / 16**digits`` per stratum) are written once to the shared
    checkpoint folder (pass 2) and ranked there by the levels of the hash
    order. Pass 3 streams every other row through.
    """
    from labelspark.session import materialise

    strata = list(strata)
    with_h = (_with_order(df, key, seed)
              .withColumn(BUCKET_COL, hash_bucket(F.col(HASH_COL), digits)))
    hist = with_h.groupBy(*strata, BUCKET_COL).agg(F.count(F.lit(1)).alias("_n"))
    counts = (hist.groupBy(*strata) if strata else hist).agg(F.sum("_n").alias("_c"))
    take_sel = n_take(counts).select(*strata, F.col("n_take").cast("bigint").alias("n_take"))
    w = (Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0)))
    w = w.orderBy(BUCKET_COL).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("_incl", F.sum("_n").over(w))
    cum = cum.withColumn("_before", F.col("_incl") - F.col("_n"))
    if strata:
        cum = _join_on(cum, take_sel, strata)
    else:
        # one row: a scalar subquery, evaluated once and inlined
        cum = cum.withColumn("n_take", take_sel.select("n_take").scalar())
    status = cum.select(
        *strata, BUCKET_COL,
        F.when(F.col("_incl") <= F.col("n_take"), F.lit("all"))
         .when(F.col("_before") >= F.col("n_take"), F.lit("none"))
         .otherwise(F.lit("part")).alias("_status"),
        (F.col("n_take") - F.col("_before")).alias("_rest"))
    # the bucket table (at most 16**digits rows per stratum) is written once,
    # so pass 1 runs once for both later passes, and the planner sees its
    # true size: without strata the bound is proven and it is broadcast;
    # with strata it is broadcast only if its measured size is small
    status = materialise(status, "cutoff-buckets")
    if not strata:
        status = F.broadcast(status)
    joined = _join_on(with_h, status, [*strata, BUCKET_COL])
    whole = (joined.where(F.col("_status") != "part")
             .withColumn(flag, F.col("_status") == "all"))
    part_rows = materialise(joined.where(F.col("_status") == "part").drop(BUCKET_COL)
                            .withColumn(ROW_COL, F.monotonically_increasing_id()), "cutoff")
    part = dense_positions(part_rows, [HASH_COL, key, TIE_COL, ROW_COL],
                           hash_bucket(F.col(HASH_COL), digits), group=strata, out="_rank",
                           refine=_hash_levels(key, digits), piece_rows=piece_rows)
    part = part.withColumn(flag, F.col("_rank") < F.col("_rest")).drop("_rank", ROW_COL)
    return whole.drop(BUCKET_COL).unionByName(part) \
                .drop(HASH_COL, TIE_COL, "_status", "_rest")
