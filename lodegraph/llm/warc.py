"""Deterministic sharded WARC writer, and a reader.

Records are range-sorted by page_id into shards whose bounds come from exact histograms of bytes, so the same table gives the
same files whatever the cluster. Each shard is one task's sorted run: it is written record by record as gzip members,
rolled to the next file once ``roll_bytes`` are reached, under a temporary name that is renamed when the file is whole.
Headers, digests and record ids are made anew from the payload alone. Each finished shard adds its files to a manifest
that the driver's job commits last; only files of a committed manifest are read back, so a retried task, which writes the
same bytes under the same names, does no harm.

Of records with equal payloads (of at least ``least_revisit_bytes``) the one with the largest page_id is the response,
others are revisits that refer to it and carry no payload; smaller ones are all responses.

Defined results: a null html is the empty payload; a null url becomes ``urn:page:<id>``; a null page_id sorts first and is
smaller than every id; of repeated rows with the largest id the first by url is the response and the others revisit its
page_id; extra columns are ignored; an empty table gives no shards and an empty result. Payloads are read whole, one at a
time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, map_batches, saved

SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
LEAST_REVISIT_BYTES = 0
#: Cells of the histograms that the driver holds at once.
CELLS = 1 << 14
#: Compressed bytes that a task reads back.
READ_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
#: Profile of revisits whose payload is the same.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 3
RECORD_BYTES = 700  # headers of a record, for the balance of shards

MANIFEST = "shard long, file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, digest_ok boolean, file string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    target = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if url is None:
        headers.append(("X-No-Url", "1"))
    if is_revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
        if refers_to is not None:
            headers.append(("X-Refers-To-Page-Id", str(refers_to)))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    made = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return made.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + made.flush()


class ShardWriter:
    """Rolls the files of one shard."""

    def __init__(self, folder: str, shard: int, attempt: int, roll_bytes: int):
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.shard, self.attempt, self.roll_bytes = shard, attempt, roll_bytes
        self.part, self.out, self.manifest = 0, None, []

    def write(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{self.attempt}.tmp"
            self.out = self.system.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.digest = 0, 0, hashlib.sha256()
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        final = f"{self.folder}/{self.name}"
        if not isinstance(self.system, (fs.LocalFileSystem,)) and self.system.get_file_info(final).type == fs.FileType.File:
            self.system.delete_file(final)  # a rename over a file works on local disks only
        self.system.move(self.temporary, final)
        self.manifest.append((self.shard, self.name, self.records, self.size, self.digest.hexdigest()))
        self.out, self.part = None, self.part + 1


def _shard_writer(folder: str, roll_bytes: int, least: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        plan, used = None, False  # the decision for the payload at hand; whether its response is written
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                shard, page_id, sha1, kind, winner, url, html = row
                if writer is None or writer.shard != shard:
                    if writer:
                        writer.close()
                        yield _manifest(writer)
                    writer = ShardWriter(folder, shard, TaskContext.get().taskAttemptId(), roll_bytes)
                if kind == 0:
                    plan, used = (page_id, sha1, winner), False
                    continue
                payload = (html or "").encode("utf-8", "surrogatepass")
                same = plan is not None and plan[:2] == (page_id, sha1)
                first = same and plan[2] == page_id and not used
                revisit = same and len(payload) >= least and not first
                used = used or first
                writer.write(record_bytes(page_id, url, payload, base32_sha1(payload), plan[2] if revisit else None, revisit))
        if writer:
            writer.close()
            yield _manifest(writer)

    return write


def _manifest(writer: ShardWriter) -> pa.RecordBatch:
    columns = list(zip(*writer.manifest))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["shard", "file", "records", "bytes", "sha256"])


def _place(starts: list[int], key: Column) -> Column:
    """The number of sorted ``starts`` at or below a key, by halving."""
    array = F.array(*(F.lit(s) for s in starts)) if len(starts) <= 64 else F.from_json(F.lit(json.dumps(starts)), "array<long>")
    place, step = F.lit(0), 1 << (len(starts) - 1).bit_length()
    while step:
        further = F.get(array, place + (step - 1))
        place = F.when(further <= key, place + step).otherwise(place)
        step >>= 1
    return place


def shard_starts(rows: DataFrame, shard_bytes: int) -> list[int]:
    """The least page_id of each shard but the first, from exact histograms of bytes.

    Ranges of page_id with more than a shard's bytes are cut finer, round by round, down to single ids, so ids far apart do
    no harm. Rounds are at most the ids' digits to the base of the cells of a range.
    """
    low, high = rows.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return []
    known = rows.where("page_id IS NOT NULL")
    done: list[tuple[int, int]] = []  # the first id of a range and its bytes
    wide = [(low, high)]
    while wide:
        cells = max(2, CELLS // len(wide))
        firsts, widths = [a for a, _ in wide], [max(1, -(-(b - a + 1) // cells)) for a, b in wide]
        at = (_place(firsts, F.col("page_id")) - 1).cast("int")
        of = lambda values: F.get(F.from_json(F.lit(json.dumps(values)), "array<decimal(20,0)>"), at)
        inside = F.col("page_id") <= of([b for _, b in wide])
        cell = F.floor((F.col("page_id").cast("decimal(20,0)") - of(firsts)) / of(widths)).cast("long")
        found = known.where((at >= 0) & inside).groupBy(at.alias("at"), cell.alias("cell")).agg(F.sum("size").alias("bytes")).collect()
        again = []
        for r in found:
            a, width = firsts[r["at"]] + r["cell"] * widths[r["at"]], widths[r["at"]]
            if r["bytes"] > shard_bytes and width > 1:
                again.append((a, min(a + width - 1, wide[r["at"]][1])))
            else:
                done.append((a, r["bytes"]))
        wide = sorted(again)
    starts, full = [], 0
    for first, size in sorted(done):
        if full + size > shard_bytes and full:
            starts.append(first)
            full = 0
        full += size
    return starts


def shard_plan(rows: DataFrame, shard_bytes: int) -> tuple[Column, int]:
    """The shard of a page_id as a column, and the number of shards; rows without an id are in the first one."""
    starts = shard_starts(rows, shard_bytes)
    if not starts:
        return F.lit(0).cast("long"), 1
    return F.coalesce(_place(starts, F.col("page_id")), F.lit(0)).cast("long"), len(starts) + 1


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_revisit_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Writes ``pages`` below ``folder`` (a URI that every executor reaches) and returns the committed manifest."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    base = base.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    keys = saved(base.select("page_id", "sha1", (F.octet_length("html") + RECORD_BYTES).cast("long").alias("size")), "warc-keys")
    shard, n_shards = shard_plan(keys, shard_bytes)
    groups = keys.groupBy("sha1").agg(F.max("page_id").alias("winner"))
    decisions = keys.select("page_id", "sha1").distinct().join(groups, "sha1")
    info = decisions.select(shard.alias("shard"), "page_id", "sha1", F.lit(0).alias("kind"), "winner", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    body = base.select(shard.alias("shard"), "page_id", "sha1", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("winner"), "url", "html")
    spark = pages.sparkSession
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    dealt = info.unionByName(body).repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "sha1", "kind", "url")
    written = map_batches(dealt, _shard_writer(folder, roll_bytes, least_revisit_bytes), MANIFEST)
    written.write.json(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a decompressed WARC stream."""
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
            headers[name] = value
        yield headers, stream.read(int(headers["Content-Length"]))


def _record_row(headers: dict[str, str], block: bytes, file: str) -> tuple:
    number = lambda k: int(headers[k]) if k in headers else None
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    ok = base32_sha1(block) == headers["WARC-Block-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        ok = ok and base32_sha1(payload) == digest and len(payload) == number("X-Payload-Length")
    url = None if "X-No-Url" in headers else headers["WARC-Target-URI"]
    return (number("X-Page-Id"), url, headers["WARC-Type"], number("X-Payload-Length"), digest, number("X-Refers-To-Page-Id"), ok, file)


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the committed files; digest_ok: the record's digests are those of its bytes."""
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string())
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        for files in batches:
            for name in files.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw)) as stream:
                    for headers, block in parse_records(stream):
                        rows.append(_record_row(headers, block, name))
                        if len(rows) == 5000:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    total = manifest.agg(F.sum("bytes"), F.count("*")).first()
    files = manifest.select("file").repartition(max(1, min(total[1], max(8, -(-(total[0] or 0) // READ_BYTES)))), "file")
    return map_batches(files, read, RECORDS)


def op8_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    manifest = write_warc(pages, folder)
    return read_warc(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
