"""CSV with line breaks inside quoted values, read in parallel.

Spark's ``multiLine`` option reads a file in one task, since a split can't tell
whether it begins inside a quoted value.  Quote parity tells: with quotes doubled
inside quotes, a line begins inside a value exactly if an odd number of quotes
stands before it in its file.

1.  Files are read as lines, split by size.  Inside a split every line gets its
    number, the number of quotes before it and of its own, and how many lines
    before it begin after an even number (one vectorised pass, no shuffle).
2.  One row per split: running sums over a file's splits give the parity with
    which each split begins, and from it the number of records that begin before.
3.  A line that begins and ends outside quotes is a record, and never moves.  The
    other lines are brought together by (file, record) and joined in order: only
    values with line breaks go through a shuffle.
4.  Records are parsed by Spark's own CSV parser, which gets whole records.

A quote character must only stand around values, doubled inside them (RFC 4180,
what ``files.write_csv`` writes); an unbalanced one shifts all records after it
in its file, as it does for any reader.  Blank lines outside values are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.plans.lineage import cut_lineage
from cadence.session import ship_package
from cadence.sources.files import CSV_READ


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each line of a split its number, the quotes before it and in it,
    and the number of lines before it that have an even number of quotes before
    them.  A split's lines come in a row, in order."""
    split, line, quotes, even = None, 0, 0, 0
    for batch in batches:
        files, blocks = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        own = pc.count_substring(batch.column(2), '"').to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])])) if len(own) else []
        columns = [np.empty(len(own), np.int64) for _ in range(3)]
        for a, e in zip(new, [*new[1:], len(own)]):
            here = (files[int(a)].as_py(), int(blocks[a]))
            if here != split:
                split, line, quotes, even = here, 0, 0, 0
            before = quotes + np.cumsum(own[a:e]) - own[a:e]
            is_even = before % 2 == 0
            columns[0][a:e] = line + np.arange(e - a)
            columns[1][a:e] = before
            columns[2][a:e] = even + np.cumsum(is_even) - is_even
            line, quotes, even = line + int(e - a), int(before[-1] + own[e - 1]), even + int(is_even.sum())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(c) for c in columns), pa.array(own)], [*batch.schema.names, "line", "before", "even", "own"]
        )


def read_records(spark: SparkSession, path: str, partition_columns: Sequence[T.StructField] = ()) -> DataFrame:
    """One row per record of the CSV files under ``path``: ``record`` (its text,
    line breaks inside values kept), ``file``, ``record_no`` (from 0 in its file)
    and the partition columns."""
    ship_package(spark)
    kinds = T.StructType([T.StructField("value", T.StringType()), *partition_columns])
    raw = spark.read.schema(kinds).option("lineSep", "\n").text(path)
    extra = [f.name for f in partition_columns]
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", *[F.col(f"`{c}`") for c in extra])
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields] + ["line bigint", "before bigint", "even bigint", "own bigint"])
    lines = cut_lineage(lines.mapInArrow(_numbered, fields), "table")
    splits = lines.groupBy("file", "block").agg(
        F.sum("own").alias("quotes"), F.count(F.lit(1)).alias("n"), F.sum((F.col("before") % 2 == 0).cast("bigint")).alias("n_even")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("odd", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    begun = F.when(F.col("odd") == 0, F.col("n_even")).otherwise(F.col("n") - F.col("n_even"))
    splits = splits.withColumn("first", F.coalesce(F.sum(begun).over(earlier), F.lit(0))).select("file", "block", "odd", "first")
    placed = lines.join(cut_lineage(splits, "table"), ["file", "block"])
    begins = (F.col("odd") + F.col("before")) % 2 == 0
    number = F.col("first") + F.when(F.col("odd") == 0, F.col("even")).otherwise(F.col("line") - F.col("even")) + F.when(begins, 0).otherwise(-1)
    placed = placed.withColumn("record_no", number).withColumn("whole", begins & (F.col("own") % 2 == 0))
    keys = ["file", "record_no", *extra]
    keys = [F.col(f"`{c}`") for c in keys]
    single = placed.where("whole").select(*keys, F.col("value").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    joined = placed.where("NOT whole").groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p.value), "\n").alias("record"))
    every = single.unionByName(joined)
    # a line break written as two characters leaves its first one outside the quotes
    text = F.regexp_replace("record", "\r$", "")
    return every.withColumn("record", text).where(F.col("record") != "")


def read_csv_multiline(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    header: bool = True,
    partition_by: Sequence[str] = (),
    corrupt_column: str | None = None,
) -> DataFrame:
    """``files.read_csv(multiline=True)`` with as many tasks as the files have
    splits.  With ``header`` the first line of every file is its header.  ``schema`` has all columns; those of ``partition_by`` come from the
    folder names and, as in Spark's own reader, last."""
    parted = [f for f in schema.fields if f.name in partition_by]
    data = [f for f in schema.fields if f.name not in partition_by]
    records = read_records(spark, path, parted)
    if header:
        records = records.where(F.col("record_no") > 0)
    options = {**CSV_READ, "mode": "PERMISSIVE"}
    kind = T.StructType(data)
    if corrupt_column:
        kind = kind.add(T.StructField(corrupt_column, T.StringType()))
        options["columnNameOfCorruptRecord"] = corrupt_column
    row = F.from_csv("record", kind.simpleString(), options)
    parsed = records.select(row.alias("row"), *[F.col(f"`{f.name}`") for f in parted])
    return parsed.select(*[F.col(f"row.`{f.name}`") for f in kind.fields], *[F.col(f"`{f.name}`") for f in parted])
