"""Session and scratch-space helpers shared by the whole library."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pathshade")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. Taken from ``spark.checkpoint.dir``; where the
    session names none, a temporary folder does in a single JVM, and is an error elsewhere."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor sees")
        path = tempfile.mkdtemp(prefix="pathshade-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Lists that ``scratch`` has open in this thread.
_kept: ContextVar[tuple[list[str], ...]] = ContextVar("kept", default=())


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths that ``written`` makes in this thread while it is open, in order."""
    mine: list[str] = []
    token = _kept.set((*_kept.get(), mine))
    try:
        yield mine
    finally:
        _kept.reset(token)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it
    back. Lost executors cost a reread, not a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    for kept in _kept.get():
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_count(df: DataFrame, name: str = "table") -> tuple[DataFrame, int]:
    """As ``written``, and the number of rows, in one job."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote with ``written``. DataFrames that
    still read it must be done with."""
    delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
