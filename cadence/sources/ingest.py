"""Ingestion with error capture and format conversion round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.session import scratch_path
from cadence.sources.files import read_csv, read_parquet, write_csv, write_parquet
from cadence.sources.multiline import read_csv_multiline

CORRUPT = "_corrupt_record"


def read_csv_capturing_errors(spark, path: str, schema: T.StructType, multiline: bool = False, header: bool = True) -> DataFrame:
    """PERMISSIVE CSV read that keeps malformed lines in ``_corrupt_record``
    instead of failing the job or dropping them silently.

    Every declared column is parsed, whichever of them a query uses: with
    column pruning the parser would not look at the rest of a line and would
    call a cut line good."""
    df = (
        spark.read.format("csv")
        .option("columnPruning", False)
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("multiLine", multiline)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .schema(T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)]))
        .load(path)
    )
    return df


def ingest_report(df: DataFrame, key: str) -> DataFrame:
    """``(status, rows, keyed_rows)`` of a capturing read: ``corrupt`` (the
    line did not parse), ``no_key`` (parsed, but ``key`` is null) or ``ok``;
    ``keyed_rows`` counts rows whose ``key`` parsed.  The status itself reads
    ``key``: Spark refuses plans over raw CSV that keep only the corrupt
    column, which column pruning would otherwise produce for a bare count."""
    status = (
        F.when(F.col(CORRUPT).isNotNull(), F.lit("corrupt"))
        .when(F.col(key).isNull(), F.lit("no_key"))
        .otherwise(F.lit("ok"))
    )
    return df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("rows"), F.count(key).alias("keyed_rows"))


def csv_parquet_round_trip(df: DataFrame, schema: T.StructType, partition_by: list[str], multiline: bool | str = False) -> DataFrame:
    """Write ``df`` as partitioned CSV (with header), convert that CSV to
    partitioned Parquet, and return the Parquet reader — the reference's
    switch of storage format, on the shared folder.  ``multiline="parallel"``
    reads values with line breaks split by split."""
    spark = df.sparkSession
    csv_path, pq_path = scratch_path(spark, "csv"), scratch_path(spark, "parquet")
    write_csv(df, csv_path, partition_by)
    if multiline == "parallel":
        source = read_csv_multiline(spark, csv_path, schema, partition_by=partition_by)
    else:
        source = read_csv(spark, csv_path, schema, multiline=bool(multiline))
    write_parquet(source, pq_path, partition_by)
    return read_parquet(spark, pq_path, schema)
