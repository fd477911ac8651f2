"""Sinks: partitioned tables, upserts, deletions, logs, Markdown and YAML exports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.session import cut


def save(frame: DataFrame, path: str, *partitions: str) -> None:
    frame.write.mode("overwrite").partitionBy(*partitions).parquet(path)


class VersionedTable:
    """A Parquet table in versions below one folder; readers see the version that was committed last.

    A new version is written whole under its own name, then named in the log of commits, so a failed write leaves the old
    one as it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema("number long, name string").json(f"{self.path}/_commits")
        except AnalysisException:
            return None

    def read(self) -> DataFrame | None:
        log = self._log()
        last = log.orderBy(F.col("number").desc()).first() if log is not None else None
        return self.spark.read.parquet(f"{self.path}/{last['name']}") if last else None

    def replace(self, frame: DataFrame, *partitions: str) -> None:
        log = self._log()
        number = (log.agg(F.max("number")).first()[0] or 0) + 1 if log is not None else 1
        name = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
        frame.write.partitionBy(*partitions).parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(number, name)], "number long, name string").coalesce(1).write.mode("append").json(f"{self.path}/_commits")

    def upsert(self, rows: DataFrame, key: list[str], *partitions: str) -> None:
        """Rows replace those of the same key; of equal keys in ``rows`` one stays."""
        new = rows.dropDuplicates(key)
        old = self.read()
        self.replace(new if old is None else old.join(new.select(*key), key, "left_anti").unionByName(new), *partitions)

    def delete(self, keys: DataFrame, key: list[str], *partitions: str) -> None:
        old = self.read()
        if old is not None:
            self.replace(old.join(keys.select(*key).distinct(), key, "left_anti"), *partitions)


class ConcurrentChange(RuntimeError):
    """Another writer has changed a bucket since it was read."""


class BucketStore:
    """A table whose buckets are folders of their own; a change reads and writes the buckets it touches and no other.

    ``_log`` holds one file a commit: the folder of every bucket, and the last batch of each stream. A commit creates the
    file of the next number, which fails if another writer was first; then it is tried again, unless that writer changed
    the same bucket. New folders are written before the commit, so readers see all of a change or nothing. Rows have a
    column ``bucket`` (null counts as ''); of a bucket's rows one stays per key.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def state(self) -> tuple[int, dict[str, str], dict[str, int]]:
        """(number, folder by bucket, last batch by stream) of the last whole commit."""
        files, log = self._at(f"{self.path}/_log")
        names = sorted((f.getPath().getName() for f in files.listStatus(log)), reverse=True) if files.exists(log) else []
        for name in names:
            try:
                text = self.spark.read.text(f"{self.path}/_log/{name}", wholetext=True).first()
                found = json.loads(text[0] if text else "")
                return int(name.split(".")[0]), found["folders"], found["batches"]
            except json.JSONDecodeError:
                continue  # a commit that was never finished
        return 0, {}, {}

    def _commit(self, base: dict[str, str], changes: dict[str, str | None], batch: tuple[str, int] | None = None) -> None:
        while True:
            number, folders, batches = self.state()
            if any(folders.get(b) != base.get(b) for b in changes):
                raise ConcurrentChange(", ".join(sorted(b for b in changes if folders.get(b) != base.get(b))))
            folders = {b: f for b, f in (folders | changes).items() if f is not None}
            text = json.dumps({"folders": folders, "batches": batches | ({batch[0]: batch[1]} if batch else {})})
            files, where = self._at(f"{self.path}/_log/{number + 1:012d}.json")
            try:
                out = files.create(where, False)
            except Py4JJavaError as error:
                if "FileAlreadyExists" in str(error.java_exception):
                    if files.getFileStatus(where).getLen() == 0:
                        raise ConcurrentChange(f"commit {number + 1} was begun and not finished") from error
                    continue
                raise
            out.write(bytearray(text.encode()))
            out.close()
            return

    def _frame(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*folders) if folders else None

    def read(self, *buckets: str) -> DataFrame | None:
        """The rows of the given buckets, or of all; None where there are none."""
        _, folders, _ = self.state()
        return self._frame([f for b, f in sorted(folders.items()) if not buckets or b in buckets])

    def _rewrite(self, rows: DataFrame, base: dict[str, str], touched: list[str], batch: tuple[str, int] | None = None) -> None:
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        parts = self.spark.createDataFrame(list(zip(touched, range(len(touched)))), "bucket string, part int")  # as many rows as buckets
        rows.join(F.broadcast(parts), "bucket").write.partitionBy("part").parquet(folder)
        files, _ = self._at(folder)
        made = {b: f"{folder}/part={i}" for i, b in enumerate(touched)}
        self._commit(base, {b: f if files.exists(self._at(f)[1]) else None for b, f in made.items()}, batch)

    def upsert(self, rows: DataFrame, key: list[str], batch: tuple[str, int] | None = None) -> None:
        """Rows replace those of the same bucket and key; of equal keys in ``rows`` one stays.

        ``batch``: a stream's name and the number of its batch; a batch that was committed before is left out.
        """
        _, base, batches = self.state()
        if batch and batches.get(batch[0], -1) >= batch[1]:
            return
        new = cut(rows.withColumn("bucket", F.coalesce("bucket", F.lit(""))).dropDuplicates(["bucket", *key]))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]
        old = self._frame([base[b] for b in touched if b in base])
        self._rewrite(new if old is None else old.join(new.select("bucket", *key), ["bucket", *key], "left_anti").unionByName(new), base, touched, batch)

    def delete(self, keys: DataFrame, key: list[str]) -> None:
        """Rows of the given buckets and keys go."""
        _, base, _ = self.state()
        gone = cut(keys.select(F.coalesce("bucket", F.lit("")).alias("bucket"), *key).distinct())
        touched = [r[0] for r in gone.select("bucket").distinct().collect() if r[0] in base]
        if touched:
            self._rewrite(self._frame([base[b] for b in touched]).join(gone, ["bucket", *key], "left_anti"), base, touched)

    def clear(self, bucket: str) -> None:
        """The bucket's rows go; nothing is read or written but the commit."""
        _, base, _ = self.state()
        if bucket in base:
            self._commit(base, {bucket: None})


def upserting(store: BucketStore, key: list[str], name: str):
    """For ``foreachBatch``: each batch is upserted once, also when a stream that has failed runs it again."""
    return lambda rows, number: store.upsert(rows, key, (name, number))


def append_lines(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").json(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    save(nodes, f"{path}/nodes", "type")
    save(edges, f"{path}/edges", "rel")


def markdown_blocks(rows: DataFrame, group: str, title: str, text: str) -> DataFrame:
    """(group, pos, block): a heading per group, a bullet per row; blocks stay rows, in order of pos."""
    head = rows.select(group).distinct().select(group, F.lit(0).cast("long").alias("pos"), F.concat(F.lit("## "), F.col(group).cast("string")).alias("block"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(group).orderBy(title)).cast("long")
    body = rows.select(group, n.alias("pos"), F.concat(F.lit("- **"), F.col(title).cast("string"), F.lit("** "), F.col(text)).alias("block"))
    return head.unionByName(body)


def yaml_rows(rows: DataFrame) -> DataFrame:
    """One YAML list entry a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            yield pd.DataFrame({"entry": [yaml.safe_dump([r], allow_unicode=True, sort_keys=False) for r in batch.to_dict("records")]})

    return rows.mapInPandas(run, "entry string")
