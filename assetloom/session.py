"""Session defaults and the one lineage-cutting helper."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("assetloom")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # generated methods beyond HotSpot's compile limit would run interpreted
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # plan building records a Python call site per column operation unless told not to
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


_local_folder: tempfile.TemporaryDirectory | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    global _local_folder
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    folder = folder or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if _local_folder is None:
        _local_folder = tempfile.TemporaryDirectory(prefix="assetloom-")
    return _local_folder.name


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the queries run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


# writer's options for large tables of numbers that are written to be read once
PACKED = {"compression": "zstd"}


def materialize(df: DataFrame, options: Mapping[str, str] | None = None) -> DataFrame:
    """Write a reduced table that several later steps read, and continue from the files.

    Cuts lineage (a lost executor costs a re-read, not a recomputation from raw
    data), keeps column pruning, and gives the planner real sizes, so joins
    broadcast a side only when it is measured to be small. What the write has shuffled
    leaves the disk when it ends: the files stand for it. ``options`` are the writer's.
    """
    path = f"{shared_folder(df.sparkSession)}/assetloom-{uuid.uuid4().hex}"
    # else shuffle files stay until the driver happens to collect its garbage
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
