"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, and its class in a pattern.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where the body is a lambda that runs often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; none for a null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where the session names none."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[str] = []


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    _made.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def purge(spark: SparkSession) -> int:
    """Deletes what operators of this process have written below the shared folder, once results have been written elsewhere."""
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def unused(columns: list[str], *stems: str) -> list[str]:
    """Column names that begin with ``stems`` and that no column has, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(frame: DataFrame, what: str) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again: a cut of the lineage that outlives executors."""
    spark = frame.sparkSession
    path = fresh_dir(spark, what)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Rows of a batch that goes to a Python worker at once.
BATCH_ROWS = 512
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def trim() -> None:
    """Gives back what a worker no longer needs; it lives on after its task and would keep what it once held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def _trimmed(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        trim()

    return run


def map_batches(frame: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with small batches, so that a worker's memory is bounded by few texts and not by a whole partition.

    Lowers the session's rows per Arrow batch to BATCH_ROWS if they are more.
    """
    conf = frame.sparkSession.conf
    if not 0 < int(conf.get(_ROWS_SETTING, "10000")) <= BATCH_ROWS:
        conf.set(_ROWS_SETTING, str(BATCH_ROWS))
    return frame.mapInArrow(_trimmed(function), schema)
