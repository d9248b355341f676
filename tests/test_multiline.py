"""Parallel CSV with line breaks inside values."""

import random

import pytest
from conftest import SF001

from cadence.session import scratch_path
from cadence.sources import files, ingest, multiline
from cadence.sources.tables import load


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "60k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() == b.count()


def test_more_tasks_than_files_and_the_same_rows(spark, small_splits):
    docs = load(spark, SF001, "documents")
    path = scratch_path(spark, "ml")
    files.write_csv(docs.coalesce(1), path)
    lines = spark.read.text(path)
    assert len(lines.inputFiles()) == 1 and lines.rdd.getNumPartitions() > 10
    assert same(multiline.read_csv_multiline(spark, path, docs.schema), docs)


def test_partition_columns_and_round_trip(spark, small_splits):
    docs = load(spark, SF001, "documents")
    assert same(ingest.csv_parquet_round_trip(docs, docs.schema, ["lang"], multiline="parallel").select(*docs.columns), docs)


def test_every_kind_of_value(spark, small_splits):
    rng = random.Random(2)
    marks = ['"', "\n", ",", "\r\n", " ", "\\", "x", "ü", "\n\n", '""']
    rows = [(i, "".join(rng.choice(marks) for _ in range(rng.randrange(0, 12))) if i % 9 else None, rng.choice(["", None, "y\nz"])) for i in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string")
    path = scratch_path(spark, "ml")
    files.write_csv(df.coalesce(2), path)
    assert same(multiline.read_csv_multiline(spark, path, df.schema), df)
    # Spark's own one-task reader agrees
    assert same(files.read_csv(spark, path, df.schema, multiline=True), df)


def test_no_header_crlf_corrupt_and_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'1,"p\nq"\r\n\r\n2,r\r\nno number,s\r\n')
    (tmp_path / "b.csv").write_bytes(b"")
    out = multiline.read_csv_multiline(spark, str(tmp_path), spark.createDataFrame([], "id bigint, t string").schema, header=False, corrupt_column="bad")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "p\nq", None), (2, "r", None), (None, "s", "no number,s")], key=str)
