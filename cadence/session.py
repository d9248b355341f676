"""Session builder and the shared folder used for lineage cuts and temp tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC so epoch seconds and dates agree with the
# SQL oracle, AQE on for runtime coalescing / join switching / skew splitting.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


PARTITION_BYTES = 128 << 20  # of input per shuffle partition


def shuffle_partitions_for(input_bytes: int, least: int = 200) -> int:
    """Initial shuffle partitions for a job over ``input_bytes``: AQE merges
    partitions that are too small but never adds any."""
    return max(least, -(-input_bytes // PARTITION_BYTES))


def build_session(
    master: str | None = None,
    app_name: str = "cadence",
    shuffle_partitions: int | None = None,
    max_partition_bytes: str | None = None,
    adaptive: bool = True,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a SparkSession with the engine defaults.

    ``shuffle_partitions`` and ``max_partition_bytes`` are the knobs the
    reference tunes by hand (35 partitions, 64 MB splits); for large inputs
    take the former from ``shuffle_partitions_for``.  ``adaptive``
    switches adaptive query execution (on by default; the reference turns it
    off once to show the plain sort-merge plan).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.adaptive.enabled"] = str(adaptive).lower()
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if max_partition_bytes is not None:
        conf["spark.sql.files.maxPartitionBytes"] = max_partition_bytes
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    """Whether all executors are on this machine (``local``, ``local-cluster``)."""
    try:
        return spark.sparkContext.master.startswith("local")
    except Exception:  # Spark Connect: no SparkContext on the client
        return False


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, for checkpoints and written tables.

    Taken from ``spark.checkpoint.dir`` (the cluster names it).  Only a
    session on one machine, as in tests, gets a fresh folder of its own when
    it has none; on a cluster that would scatter files over the machines, so a
    missing setting is an error there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    jdir = sc._jsc.sc().getCheckpointDir() if sc is not None else None
    if sc is not None:
        d = d or sc.getConf().get("spark.checkpoint.dir", None)
        if not d and jdir.isDefined():
            d = jdir.get()
    if not d:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="cadence-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if jdir is not None and not jdir.isDefined():
        sc.setCheckpointDir(d)
    return d


_scratch_paths: list[str] = []
_scratch_tables: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (see ``clean_scratch``)."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _scratch_paths.append(path)
    return path


def scratch_table(spark: SparkSession, prefix: str) -> str:
    """A fresh, unique table name (see ``clean_scratch``)."""
    name = f"{prefix}_{uuid.uuid4().hex[:12]}"
    _scratch_tables.append(name)
    return name


def clean_scratch(spark: SparkSession) -> None:
    """Drop the tables and remove the folders that this process has made under
    the shared folder; results that still read them must be written by then."""
    while _scratch_tables:
        spark.sql(f"DROP TABLE IF EXISTS {_scratch_tables.pop()}")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _scratch_paths:
        path = jvm.org.apache.hadoop.fs.Path(_scratch_paths.pop())
        path.getFileSystem(conf).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers.

    The driver zips its own copy once per session and hands it to Spark, which
    serves it to every executor (what ``--py-files`` does at submit time).
    """
    sc = spark.sparkContext
    if getattr(sc, "_cadence_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="cadence-code-"), "cadence_code")
    sc.addPyFile(shutil.make_archive(base, "zip", root, os.path.basename(os.path.dirname(os.path.abspath(__file__)))))
    sc._cadence_shipped = True


def local_test_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session used by tests and the bench: local mode, small shuffle count."""
    os.environ.setdefault("PYSPARK_PYTHON", "python")
    return build_session(
        master=f"local[{cores}]",
        shuffle_partitions=shuffle_partitions,
        extra_conf={"spark.driver.memory": "8g", "spark.sql.execution.arrow.pyspark.enabled": "true"},
    )
