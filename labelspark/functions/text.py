"""Text cleaning (F1) and id normalisation (F3) as native column expressions.

Python's ``\\s`` and ``\\S`` on text are Unicode-aware and also count the
separators U+001C..U+001F as space; Java's are ASCII-only unless ``(?U)``
is set, and ``(?U)`` still leaves those four out. Each pattern is therefore
compiled with ``(?U)`` and ``\\s`` / ``\\S`` are spelled as explicit classes
that add them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[\s\x{1c}-\x{1f}]"
_NWS = r"[^\s\x{1c}-\x{1f}]"

# ---- fixed values: the cleaning patterns and their order ----------------
# retweet marks, handles, links, bit.ly links (the dot matches any
# character), entities, <MENTION_1..9> tags, <URL> tags
CLEANING_PATTERNS_PY = (
    r"(RT\s@[A-Za-z]+[A-Za-z0-9-_]+)",
    r"(@[A-Za-z0-9-_]+)",
    r"https?\S+",
    r"bit.ly/\S+",
    r"&[\S]+?;",
    r"<MENTION_[1-9]>",
    r"<URL>",
)
# --------------------------------------------------------------------------


def _to_java(pattern: str) -> str:
    """Spell a Python pattern for Java: ``(?U)`` plus the Python space set."""
    out = pattern.replace(r"[\S]", _NWS).replace(r"\S", _NWS).replace(r"\s", _WS)
    return "(?U)" + out


CLEANING_PATTERNS = tuple(_to_java(p) for p in CLEANING_PATTERNS_PY)


def clean_text(col: Column | str, strict: bool = False) -> Column:
    """Remove retweet marks, handles, links, entities and tags, in order.

    Nothing is trimmed or collapsed. Null in gives null out; with
    ``strict=True`` a null raises at run time, as the reference does.
    """
    c = F.col(col) if isinstance(col, str) else col
    if strict:
        c = F.when(c.isNull(), F.raise_error(F.lit("clean_text: expected a string, got null"))) \
             .otherwise(c)
    for pat in CLEANING_PATTERNS:
        c = F.regexp_replace(c, pat, "")
    return c


def normalise_id(col: Column | str) -> tuple[Column, Column]:
    """Ids printed as ``tensor(12)``.

    Removes every ``tensor(`` and ``)``, strips surrounding whitespace, and
    returns ``(as_bigint, as_string)``: the integer when the rest parses,
    else null, and the stripped string.
    """
    c = F.col(col) if isinstance(col, str) else col
    s = F.replace(F.replace(c.cast("string"), F.lit("tensor("), F.lit("")), F.lit(")"), F.lit(""))
    s = F.regexp_replace(s, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")
    return s.try_cast("bigint"), s
