"""Annotated sets (JSON keyed by id, JSON Lines, CSV, TSV), posts to score,
labelled-post sinks and stored-prediction caches (S1-S9, P6).

Schemas are declared. Label lists stored as text (CSV/TSV) are parsed with
``from_json``, which also accepts the single-quoted lists pandas writes.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from labelspark.scheme import scheme_for
from labelspark.sources import blocks

L1 = "labels_task1_1"
L2 = "labels_task1_3"

RECORD = T.StructType([
    T.StructField("tweet", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField(L1, T.ArrayType(T.StringType())),
    T.StructField(L2, T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("split", T.StringType()),
])


def _text_first(df: DataFrame) -> DataFrame:
    """``tweet`` becomes ``text`` (``text`` wins when both are present)."""
    if "tweet" in df.columns:
        if "text" in df.columns:
            return df.withColumn("text", F.coalesce("text", "tweet")).drop("tweet")
        return df.withColumnRenamed("tweet", "text")
    return df


def read_annotated_json(spark: SparkSession, path: str, id_col: str = "id",
                        whole_file: bool = True) -> DataFrame:
    """JSON objects keyed by row id (S1); the key becomes ``id_col``.

    ``whole_file``: one object per file, as the annotated sets ship; a large file is
    read in blocks by many tasks (``sources.blocks``). Otherwise one keyed object
    per line, which splits like any text file. Keys stay strings.
    """
    if whole_file:
        rows = blocks.read_keyed_json(spark, path, RECORD, id_col)
    else:
        rows = spark.read.text(path).select(F.explode(F.from_json("value", T.MapType(T.StringType(), RECORD))).alias(id_col, "_r"))
    return _text_first(rows.select(id_col, "_r.*"))


def read_annotated_jsonl(spark: SparkSession, path: str, id_col: str = "id") -> DataFrame:
    """JSON Lines with an id field: splittable, for large annotated sets."""
    schema = T.StructType([T.StructField(id_col, T.StringType())] + RECORD.fields)
    return _text_first(spark.read.schema(schema).json(path))


def read_annotated_csv(spark: SparkSession, path: str, id_col: str = "id",
                       multi_line: bool = False) -> DataFrame:
    """CSV or TSV by extension (S2); label columns parsed from list text.

    ``multi_line``: quoted fields may hold line ends; the file is read in blocks by
    many tasks (``sources.blocks``). Without it every line is a row.

    Without an id column, the row position in the file becomes the id (P6).
    """
    sep = "\t" if path.endswith(".tsv") else ","
    position = "_position"
    if multi_line:
        raw = blocks.read_quoted_csv(spark, path, sep, position)
    else:
        raw = spark.read.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    cols = [c for c in raw.columns if c != position]
    out = raw
    for c in cols:
        out = out.withColumn(c, F.col(c).cast("string"))
    if L1 in cols:
        out = out.withColumn(L1, F.from_json(L1, "array<string>", {"allowSingleQuotes": "true"}))
    if L2 in cols:
        out = out.withColumn(L2, F.from_json(L2, "array<array<string>>",
                                             {"allowSingleQuotes": "true"}))
    if id_col not in cols:
        unnamed = [c for c in cols if c in ("", "_c0", "Unnamed: 0")]
        if unnamed:
            out = out.withColumnRenamed(unnamed[0], id_col)
        elif multi_line:
            out = out.withColumn(id_col, F.col(position).cast("string"))
        else:
            out = attach_row_index(out, id_col).withColumn(id_col, F.col(id_col).cast("string"))
    return _text_first(out.drop(position))


def write_annotated_json(df: DataFrame, path: str, files: int, id_col: str = "id") -> str:
    """Write annotated rows as ``files`` files, each one object keyed by id."""
    record = F.struct(*[F.col(f.name) for f in RECORD.fields if f.name in df.columns])
    text = F.to_json(F.create_map(F.col(id_col).cast("string"), record))
    members = df.select(F.substring(text, 2, F.length(text) - 2).alias("value"))

    def one_object(batches):
        mark = "{"
        for batch in batches:
            values = [mark + v if k == 0 else "," + v for k, v in enumerate(batch.column(0).to_pylist())]
            mark = "," if values else mark
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["}" if mark == "," else "{}"], pa.string())], ["value"])

    members.repartition(files).mapInArrow(one_object, "value string").write.text(path)
    return path


def write_annotated_json_lines(df: DataFrame, path: str, id_col: str = "id") -> str:
    """Write annotated rows as one ``{"<id>": {record}}`` object per line."""
    record = F.struct(*[F.col(f.name) for f in RECORD.fields if f.name in df.columns])
    df.select(F.to_json(F.create_map(F.col(id_col).cast("string"), record)).alias("value")) \
      .write.text(path)
    return path


def read_annotated(spark: SparkSession, path: str, dataset: str = "EXIST",
                   id_col: str = "id", multi_line: bool = False) -> DataFrame:
    """Dispatch on extension (S3): ``.json``, ``.keyed.jsonl``, ``.jsonl``,
    ``.csv``, ``.tsv``.

    ``.json`` is one object keyed by id, ``.keyed.jsonl`` one keyed object per line (as
    ``write_annotated_json_lines`` writes them). All of them are read by many tasks.

    Unknown extensions and dataset names fail at plan time.
    """
    scheme_for(dataset)
    if path.endswith(".json"):
        return read_annotated_json(spark, path, id_col)
    if path.endswith(".keyed.jsonl"):
        return read_annotated_json(spark, path, id_col, whole_file=False)
    if path.endswith(".jsonl"):
        return read_annotated_jsonl(spark, path, id_col)
    if path.endswith(".csv") or path.endswith(".tsv"):
        return read_annotated_csv(spark, path, id_col, multi_line)
    raise ValueError(f"unsupported file format: {path}; use .json, .jsonl, .csv or .tsv")


def annotated_votes(df: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Long vote tables ``(id, annotator, label)`` for both levels; level 2
    is flattened (an annotator may give several labels)."""
    v1 = df.select(id_col, F.posexplode(L1).alias("annotator", "label"))
    per_ann = df.select(id_col, F.posexplode(L2).alias("annotator", "_labels"))
    v2 = per_ann.select(id_col, "annotator", F.explode("_labels").alias("label"))
    return v1, v2


def attach_row_index(df: DataFrame, out: str = "row_index") -> DataFrame:
    """Dense 0-based row position (P6): files by name, rows as they stand.

    ``monotonically_increasing_id`` numbers the rows of a task in read order.
    Rows per file split (a table bounded by the number of splits) give each
    split its offset in the order of file name and place in the file, however
    Spark packed the splits into tasks. A frame that is no file scan has no
    files; its rows are numbered by partition.
    """
    mid = F.monotonically_increasing_id()
    try:
        marked = df.select("*", F.col("_metadata.file_path").alias("_file"),
                           F.col("_metadata.file_block_start").alias("_at"), mid.alias("_mid"))
    except AnalysisException:
        marked = df.withColumns({"_mid": mid, "_file": F.lit("")}).withColumn("_at", F.shiftright("_mid", 33))
    parts = marked.groupBy("_file", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(F.lit(0)).orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_file", "_at", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (marked.join(offsets, ["_file", "_at"])
            .withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint"))
            .drop("_mid", "_file", "_at", "_first", "_off"))


def read_posts(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Posts to score (S4): CSV read as text (ids keep leading zeros and
    never become numbers); parquet id columns cast to string. ``multi_line``
    as for annotated CSV."""
    if path.endswith(".csv") or path.endswith(".tsv"):
        sep = "\t" if path.endswith(".tsv") else ","
        if multi_line:
            return blocks.read_quoted_csv(spark, path, sep)
        return (spark.read.option("header", True).option("sep", sep)
                .option("escape", '"').option("inferSchema", False).csv(path))
    df = spark.read.parquet(path)
    for c in ("comment_id", "item_id", "data_id"):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("string"))
    return df


def labelled_path(base: str, stem: str, fmt: str = "parquet") -> str:
    return f"{base.rstrip('/')}/{stem}_predictions.{fmt}"


def write_labelled(df: DataFrame, base: str, stem: str, fmt: str = "parquet",
                   mode: str = "overwrite") -> str:
    """Write labelled posts named after the input stem (S6). CSV has no
    arrays, so array columns are written as JSON text."""
    path = labelled_path(base, stem, fmt)
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "csv":
        out = df
        for f in df.schema.fields:
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
                out = out.withColumn(f.name, F.to_json(f.name))
        out.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return path


def append_scored(df: DataFrame, path: str) -> None:
    """Append scored rows as new files (S7). A repeated call repeats its rows: where steps may be
    repeated, use ``steps.write_step``, which counts every step once."""
    df.write.mode("append").parquet(path)


def cached_or_compute(spark: SparkSession, path: str,
                      compute: Callable[[], DataFrame]) -> DataFrame:
    """Stored predictions if they are complete (``_SUCCESS`` is there), else
    compute, store and read back (S9); a half-written set is replaced."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def store_annotated(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write an annotated set as parquet partitioned by ``split``, so a split
    filter prunes whole directories before any file is opened."""
    df.write.mode(mode).partitionBy("split").parquet(path)
    return path
