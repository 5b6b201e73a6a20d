"""Run a registered query in Spark and its oracle in DuckDB, compare results.

Mirrors the driver's check: same row count, same column names and types,
same multiset of rows (columns sorted by name, doubles compared after
rounding to 6 places).
"""

from __future__ import annotations

import math

import duckdb

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "TINYINT",
                 "float": "FLOAT", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


STRICT = False  # compare doubles bit for bit instead of at 6 places


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0 if STRICT else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def compare(spark_df, con, sql: str) -> list[str]:
    problems = []
    s_cols = [f.name for f in spark_df.schema.fields]
    s_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    if sorted(s_cols) != sorted(d_cols):
        return [f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"]
    for c in s_cols:
        want = SPARK_TO_DUCK.get(s_types[c], s_types[c])
        if want != d_types[c]:
            problems.append(f"type of {c}: spark={s_types[c]} duck={d_types[c]}")
    cols = sorted(s_cols)
    s_rows = sorted((tuple(_norm(r[c]) for c in cols) for r in spark_df.select(*cols).collect()),
                    key=repr)
    d_rows = sorted((tuple(_norm(v) for v in row) for row in
                     con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall()),
                    key=repr)
    if len(s_rows) != len(d_rows):
        problems.append(f"row count: spark={len(s_rows)} duck={len(d_rows)}")
    if s_rows != d_rows:
        ss, dd = set(s_rows), set(d_rows)
        only_s = [r for r in s_rows if r not in dd][:3]
        only_d = [r for r in d_rows if r not in ss][:3]
        problems.append(f"values differ: spark-only={only_s} duck-only={only_d}")
    return problems
