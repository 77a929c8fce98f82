"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the library is designed for; all are plain Spark settings and may be overridden.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split a hot join key even where that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Documents are large rows: bound an Arrow batch by bytes, not by row count alone.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

BATCHES = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")


def build_session(app_name: str = "folioflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bounded(spark: SparkSession | None) -> None:
    """Arrow batches of ``spark`` no larger than the defaults here say; smaller ones stay.

    A Python worker holds a batch several times, as Arrow data, as Python text and as results, and an executor has workers for
    every core.  Spark's own bound of 64 MB lets them grow with the documents.
    """
    for name in BATCHES if spark is not None else ():
        held = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(name).strip().lower())
        now = int(held[1]) * 1024 ** " kmgtp".index(held[2] or " ") if held else 0
        if now <= 0 or now > int(DEFAULTS[name]):
            spark.conf.set(name, DEFAULTS[name])


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder; on a cluster a
    machine-local folder would lose data with its executor, so that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", None) or ""
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    fallback = tempfile.mkdtemp(prefix="folioflow-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


#: Where a run keeps what it writes for itself, while :func:`run_folder` is open.
RUN_FOLDER = "spark.folioflow.run.dir"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the run's folder or the shared one; no run ever reuses or clears another run's path."""
    folder = spark.conf.get(RUN_FOLDER, "") or f"{shared_dir(spark)}/folioflow"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """A folder of the caller's own for all that is materialised inside the block; it goes at the end of the block.

    Results must have been written elsewhere, or collected, by then.
    """
    before = spark.conf.get(RUN_FOLDER, "")
    path = new_path(spark, name)
    spark.conf.set(RUN_FOLDER, path)
    try:
        yield path
    finally:
        spark.conf.set(RUN_FOLDER, before)
        held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(held, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    Used where one result feeds several outputs and must not be computed twice (extraction above
    all).  The written table survives the loss of executors.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
