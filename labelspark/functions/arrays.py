"""Small array helpers shared by operators and the query views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_ints(arr: Column | str, sep: str = ",") -> Column:
    """``[0, 1, 0]`` -> ``'0,1,0'`` (null stays null)."""
    return F.array_join(F.transform(as_col(arr), lambda x: x.cast("string")), sep)


def parse_int_list(col: Column | str) -> Column:
    """Stored list text ``'[1, 0, 0]'`` -> ``array<int>``."""
    return F.from_json(as_col(col), "array<int>")

