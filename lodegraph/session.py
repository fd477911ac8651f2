"""Session helper with the settings the engine is designed for."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution on; extra settings override the defaults."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName("lodegraph").config(map=settings)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode where the session names none."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read again, so that long loops keep short plans and survive lost executors."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the library wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = ":".join(p for p in (root, known.get("PYTHONPATH", "")) if p)


def spread(frame: DataFrame) -> DataFrame:
    """The frame over at least as many partitions as there are cores: an input of one small file would keep all but one idle.

    Larger inputs have more partitions by themselves and stay as they are; filters and column selections still reach the scan.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame
