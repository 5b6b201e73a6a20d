"""Annotated-set readers, posts reader, labelled sinks and caches."""

import json
import os

import pytest

from labelspark.plans.prepare import load_processed_data
from labelspark.sources import annotated as A

RECORDS = {
    "100": {"tweet": "some text @x", "split": "TRAIN_EN",
            "labels_task1_1": ["YES", "YES", "NO", "YES", "NO", "YES"],
            "labels_task1_3": [["OBJECTIFICATION"], ["OBJECTIFICATION", "UNKNOWN"], ["-"],
                               ["STEREOTYPING-DOMINANCE"], ["-"], ["SEXUAL-VIOLENCE"]]},
    "101": {"tweet": "other", "split": "DEV_EN",
            "labels_task1_1": ["NO"] * 4 + ["YES"] * 2,
            "labels_task1_3": [["-"]] * 4 + [["OBJECTIFICATION"]] * 2},
    "102": {"tweet": "tied", "split": "TRAIN_ES",
            "labels_task1_1": ["NO"] * 3 + ["YES"] * 3,
            "labels_task1_3": [["-"]] * 3 + [["OBJECTIFICATION"]] * 3},
}


def write_json(tmp_dir):
    path = os.path.join(tmp_dir, "exist.json")
    with open(path, "w") as f:
        json.dump(RECORDS, f, indent=1)
    return path


def write_csv(tmp_dir, sep, ext):
    path = os.path.join(tmp_dir, f"exist.{ext}")
    with open(path, "w") as f:
        f.write(sep.join(["id", "tweet", "labels_task1_1", "labels_task1_3", "split"]) + "\n")
        for k, r in RECORDS.items():
            # list text as pandas writes it: Python repr with single quotes
            cells = [k, r["tweet"], repr(r["labels_task1_1"]), repr(r["labels_task1_3"]), r["split"]]
            if sep == ",":
                cells = ['"' + c.replace('"', '""') + '"' for c in cells]
            f.write(sep.join(cells) + "\n")
    return path


@pytest.mark.parametrize("kind", ["json", "csv", "tsv"])
def test_load_processed_data_formats(spark, tmp_dir, kind):
    path = (write_json(tmp_dir) if kind == "json"
            else write_csv(tmp_dir, "," if kind == "csv" else "\t", kind))
    kept, report = load_processed_data(spark, path, split="train", multilingual=True, clean=True)
    rows = {r["id"]: r for r in kept.collect()}
    assert set(rows) == {"100"}
    assert rows["100"]["text"] == "some text "
    assert rows["100"]["category_labels"] == [0, 0, 0, 1, 0, 0]
    r = report.first()
    assert (r["rows_in"], r["binary_ties"], r["category_ties"]) == (2, 1, 0)


def test_jsonl_and_split_filters(spark, tmp_dir):
    path = os.path.join(tmp_dir, "exist.jsonl")
    with open(path, "w") as f:
        for k, r in RECORDS.items():
            f.write(json.dumps({"id": k, **r}) + "\n")
    df = A.read_annotated(spark, path)
    assert sorted(r["id"] for r in df.collect()) == ["100", "101", "102"]
    kept, _ = load_processed_data(spark, path, split="test")
    assert [r["id"] for r in kept.collect()] == ["101"]


def test_bad_extension_and_dataset(spark, tmp_dir):
    with pytest.raises(ValueError):
        A.read_annotated(spark, os.path.join(tmp_dir, "x.xml"))
    with pytest.raises(ValueError):
        A.read_annotated(spark, write_json(tmp_dir), dataset="OTHER")


def test_csv_without_id_gets_row_position(spark, tmp_dir):
    path = os.path.join(tmp_dir, "noid.csv")
    with open(path, "w") as f:
        f.write("tweet,split\n")
        for i in range(25):
            f.write(f"t{i},TRAIN_EN\n")
    df = A.read_annotated_csv(spark, path)
    got = {r["text"]: r["id"] for r in df.collect()}
    assert got == {f"t{i}": str(i) for i in range(25)}


def test_read_posts_keeps_ids_as_text(spark, tmp_dir):
    path = os.path.join(tmp_dir, "posts.csv")
    with open(path, "w") as f:
        f.write("comment_id,cleaned_text\n007,hello\n12,world\n")
    from labelspark.operators.posts import harmonise_posts
    df = harmonise_posts(A.read_posts(spark, path))
    assert sorted((r["item_id"], r["text"]) for r in df.collect()) == [("007", "hello"), ("12", "world")]


def test_write_labelled_csv_round_trip_and_parse(spark, tmp_dir):
    from labelspark.functions.arrays import parse_int_list
    df = spark.createDataFrame([("a", [1, 0, 0], "-")], "data_id string, pred_category array<int>, p string")
    path = A.write_labelled(df, tmp_dir, "posts", fmt="csv")
    back = spark.read.option("header", True).csv(path)
    r = back.select(parse_int_list("pred_category").alias("c")).first()
    assert r["c"] == [1, 0, 0]
    assert A.write_labelled(df, tmp_dir, "posts").endswith("posts_predictions.parquet")


def test_cached_or_compute_and_append(spark, tmp_dir):
    path = os.path.join(tmp_dir, "cache.parquet")
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert A.cached_or_compute(spark, path, compute).count() == 3
    assert A.cached_or_compute(spark, path, compute).count() == 3
    assert len(calls) == 1
    log = os.path.join(tmp_dir, "log.parquet")
    A.append_scored(spark.range(2), log)
    A.append_scored(spark.range(5), log)
    assert spark.read.parquet(log).count() == 7
