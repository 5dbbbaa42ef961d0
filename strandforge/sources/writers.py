"""Sinks: ordered text files, plain or compressed, and block-compressed binary files.

Where records go is computed from counts of their keys, so nothing is sampled and no record is
made twice: partition after partition holds the next rows in order, and the order of part names is
the order of records. Executors write the parts. One file, where it is wanted, is the parts joined
through the file system (gzip, bzip2 and block-compressed parts stay valid when joined). A stream gets
each part as soon as it and all before it are there, while later ones are still made.
"""

from __future__ import annotations

import bz2
import hashlib
import re
import struct
import threading
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import InheritableThread, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from strandforge.sources.storage import file_system, new_path, remove

# The empty block that ends a block-compressed file, and the most that a block holds.
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_BYTES = 0xFF00
SUFFIX = {"none": "", "gzip": ".gz", "bzip2": ".bz2"}
#: Records of a part, about; buckets of ids as long as a part, and buckets of a run.
PART_ROWS, BUCKETS, FAN = 1_000_000, 16, 4096
#: Bytes copied to a stream at once.
CHUNK = 1 << 20
#: Bytes of a compressed file that are unpacked at once.
READ_BYTES = 1 << 17
#: Buckets that are sent to all tasks, at most.
SENT_BUCKETS = 200_000
_GROUP = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


def block(data: bytes, level: int = 6) -> bytes:
    """One block-compressed member."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = struct.pack("<4BI2BH2BHH", 0x1F, 0x8B, 8, 4, 0, 0, 0xFF, 6, 0x42, 0x43, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocks(data: bytes) -> bytes:
    return b"".join(block(data[i : i + BLOCK_BYTES]) for i in range(0, len(data), BLOCK_BYTES))


def bucket_of(row_id: Column, part_rows: int = PART_ROWS) -> Column:
    """The bucket of ids that a row is counted in; BUCKETS of them hold as many ids as a part has rows."""
    return F.floor(row_id / max(1, part_rows // BUCKETS)).cast("long")


def placed_buckets(histogram: DataFrame, part_rows: int = PART_ROWS) -> tuple[DataFrame, int]:
    """(stage, group_no, bucket, part of each bucket of the histogram, number of parts).

    A part ends with the bucket that fills it, so parts differ by a bucket, whatever gaps the ids have. The
    running count is kept in two levels: over runs of FAN buckets, and inside each run.
    """
    h = histogram.withColumn("run", F.floor(F.col("bucket") / FAN))
    runs = h.groupBy("stage", "group_no", "run").agg(F.sum("n_rows").alias("n"))
    order = Window.orderBy("stage", "group_no", "run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each FAN buckets
    runs = runs.select(F.col("stage").alias("_s"), F.col("group_no").alias("_g"), F.col("run").alias("_r"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("stage", "group_no", "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("inner", F.coalesce(F.sum("n_rows").over(inside), F.lit(0)))
    h = h.join(runs, (F.col("stage") == F.col("_s")) & (F.col("group_no") == F.col("_g")) & (F.col("run") == F.col("_r")))
    n = max(1, -(-(histogram.agg(F.sum("n_rows")).first()[0] or 0) // part_rows))
    part = F.least(F.floor((F.col("before") + F.col("inner")) / part_rows), F.lit(n - 1)).cast("int")
    return h.select("stage", "group_no", "bucket", "n_rows", part.alias("part")), n


def ordered(records: DataFrame, order: list[str], histogram: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """A total order (stage, group_no, row_id, ...); no task sees all rows.

    histogram: stage, group_no, bucket, n_rows of the keys. Consecutive buckets make a part; keys of no
    bucket (headers) come first.
    """
    buckets, n = placed_buckets(histogram, part_rows)
    # a part has BUCKETS of them unless ids have wide gaps; sent to all tasks, so that records move once, to their parts
    buckets = F.broadcast(buckets) if histogram.limit(SENT_BUCKETS + 1).count() <= SENT_BUCKETS else buckets
    to = buckets.select(F.col("stage").alias("_s"), F.col("group_no").alias("_g"), F.col("bucket").alias("_b"), F.col("part").alias("_part"))
    same = (F.col("stage") == F.col("_s")) & (F.col("group_no") == F.col("_g")) & (bucket_of(F.col("row_id"), part_rows) == F.col("_b"))
    placed = records.join(to, same, "left").withColumn("_part", F.coalesce("_part", F.lit(0)))
    return placed.repartitionById(n, "_part").sortWithinPartitions(*order).select(*records.columns)


def write_text(records: DataFrame, path: str, order: list[str], histogram: DataFrame, compression: str = "none", part_rows: int = PART_ROWS) -> None:
    """A folder of parts with a record a line (records may span lines)."""
    ordered(records, order, histogram, part_rows).select("record").write.mode("overwrite").option("compression", compression).text(path)


def _place(name: str) -> tuple[float, str]:
    """Parts sort by number, what ends a file last."""
    m = re.match(r"part-(\d+)", name)
    return (int(m[1]) if m else float("inf"), name)


def join_parts(spark: SparkSession, folder: str, target: str) -> None:
    """The parts of a folder as one file; streamed through the file system, never held whole."""
    jvm = spark._jvm
    where, fs = file_system(spark, folder)
    out_path, out_fs = file_system(spark, target)
    out = out_fs.create(out_path, True)
    try:
        for name in sorted((x.getPath().getName() for x in fs.listStatus(where) if x.getPath().getName().startswith("part-")), key=_place):
            source = fs.open(jvm.org.apache.hadoop.fs.Path(where, name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 18, False)
            source.close()
    finally:
        out.close()


def write_text_file(records: DataFrame, target: str, order: list[str], histogram: DataFrame, compression: str = "none", part_rows: int = PART_ROWS) -> None:
    """One file of the records in order."""
    if compression != "none":
        write_parts_file(records, target, order, histogram, compression, part_rows)
        return
    folder = f"{target}.parts-{uuid.uuid4().hex}"
    write_text(records, folder, order, histogram, compression, part_rows)
    join_parts(records.sparkSession, folder, target)
    remove(records.sparkSession, folder)


class Plain:
    """Bytes as they are; the others compress them."""

    def more(self, data: bytes) -> bytes:
        return data

    def end(self) -> bytes:
        return b""


class Compressed(Plain):
    """One gzip or bzip2 member a part."""

    def __init__(self, kind: str):
        self.of = zlib.compressobj(6, zlib.DEFLATED, 31) if kind == "gzip" else bz2.BZ2Compressor()

    def more(self, data: bytes) -> bytes:
        return self.of.compress(data)

    def end(self) -> bytes:
        return self.of.flush()


class Blocks(Plain):
    """Members of BLOCK_BYTES, the last one of a part shorter."""

    def __init__(self) -> None:
        self.held = bytearray()

    def more(self, data: bytes) -> bytes:
        self.held += data
        full = len(self.held) - len(self.held) % BLOCK_BYTES
        out = blocks(bytes(self.held[:full]))
        del self.held[:full]
        return out

    def end(self) -> bytes:
        return blocks(bytes(self.held))


@dataclass
class PartDone(WriterCommitMessage):
    name: str


class PartWriter(DataSourceArrowWriter):
    """Each task writes its rows to a part of its own and publishes it when it is whole; the driver only learns names.

    kind: none, gzip or bzip2 for lines of text, bam for bytes of binary records.
    """

    def __init__(self, folder: str, kind: str):
        self.folder, self.kind = folder, kind

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        storage, root = self._open()
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}"
        own = f"{root}/_try-{name}-{task.taskAttemptId()}"
        encoding = Blocks() if self.kind == "bam" else Plain() if self.kind == "none" else Compressed(self.kind)
        # attempts write apart, so one that is lost or overtaken leaves no half of a part
        with storage.open_output_stream(own) as out:
            for b in iterator:
                raw = b.column(0).cast(pa.binary()).to_pylist()
                out.write(encoding.more(b"".join(raw) if self.kind == "bam" else b"".join(x + b"\n" for x in raw)))
            out.write(encoding.end())
        self._publish(storage, own, f"{root}/{name}")
        return PartDone(name)

    @staticmethod
    def _publish(storage, own: str, target: str) -> None:
        """By renaming; attempts of one task have the same bytes, so whichever is first may stay."""
        from pyarrow import fs

        try:
            storage.move(own, target)
        except OSError:
            if storage.get_file_info(target).type == fs.FileType.NotFound:
                raise

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        storage, root = self._open()
        if self.kind == "bam":
            with storage.open_output_stream(f"{root}/part-end") as out:
                out.write(END_BLOCK)
        self._clear(storage, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*self._open())

    def _clear(self, storage, root: str) -> None:
        from pyarrow import fs

        for x in storage.get_file_info(fs.FileSelector(root)):
            if x.base_name.startswith("_try-"):
                storage.delete_file(x.path)


class PartSource(DataSource):
    """The sink of one column of texts or bytes: ``df.write.format("strandforge_parts").option("kind", ...).save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "strandforge_parts"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PartWriter(self.options["path"], self.options.get("kind", "none"))


def write_parts(records: DataFrame, folder: str, order: list[str], histogram: DataFrame, kind: str, part_rows: int = PART_ROWS) -> None:
    """A folder of parts; joined, they are a file."""
    spark = records.sparkSession
    spark.dataSource.register(PartSource)
    where, fs = file_system(spark, folder)
    fs.delete(where, True)
    fs.mkdirs(where)
    uri = fs.makeQualified(where).toUri()
    full = f"file://{uri.getPath()}" if uri.getScheme() == "file" else uri.toString()
    ordered(records, order, histogram, part_rows).select(F.col("record").alias("data")).write.format("strandforge_parts").option("kind", kind).mode("append").save(full)


def write_parts_file(records: DataFrame, target: str, order: list[str], histogram: DataFrame, kind: str, part_rows: int = PART_ROWS) -> None:
    """One file of parts."""
    folder = f"{target}.parts-{uuid.uuid4().hex}"
    write_parts(records, folder, order, histogram, kind, part_rows)
    join_parts(records.sparkSession, folder, target)
    remove(records.sparkSession, folder)


def stream_parts(records: DataFrame, out, order: list[str], histogram: DataFrame, kind: str, part_rows: int = PART_ROWS, wait: float = 0.05) -> None:
    """The records to an open binary stream, in order: the bytes that write_parts_file gives.

    One job makes the parts. A part is copied, CHUNK bytes at a time, and deleted as soon as it and all before it are
    whole. A reader that goes away ends the job.
    """
    spark, sc = records.sparkSession, records.sparkSession.sparkContext
    folder, group = new_path(spark, "stream"), f"stream-{uuid.uuid4().hex}"
    n = placed_buckets(histogram, part_rows)[1]
    ended, failed = threading.Event(), []

    def copy() -> None:
        for name in [*(f"part-{i:05d}" for i in range(n)), *(["part-end"] if kind == "bam" else [])]:
            where, fs = file_system(spark, f"{folder}/{name}")
            pause = wait
            while not fs.exists(where):
                if ended.wait(pause) and not fs.exists(where):
                    return  # the job failed, and its thread says why
                pause = min(1.0, 2 * pause)
            source = fs.open(where)
            while data := bytes(source.readNBytes(CHUNK)):
                out.write(data)
            source.close()
            fs.delete(where, False)
        out.flush()

    def copied() -> None:
        try:
            copy()
        except BaseException as e:  # noqa: BLE001  raised again by the thread that runs the job
            failed.append(e)
            sc.cancelJobGroup(group)

    reader, before = InheritableThread(target=copied, daemon=True), [sc.getLocalProperty(k) for k in _GROUP]
    sc.setJobGroup(group, "records to a stream", True)
    reader.start()
    try:
        write_parts(records, folder, order, histogram, kind, part_rows)
    except Exception:
        if not failed:
            raise
    finally:
        ended.set()
        reader.join()
        for k, v in zip(_GROUP, before, strict=True):
            sc.setLocalProperty(k, v)
        remove(spark, folder)
    if failed:
        raise failed[0]


def write_bam(records: DataFrame, folder: str, order: list[str], histogram: DataFrame, part_rows: int = PART_ROWS) -> None:
    """A folder of block-compressed parts of binary records, ended by the empty block."""
    write_parts(records, folder, order, histogram, "bam", part_rows)


def write_bam_file(records: DataFrame, target: str, order: list[str], histogram: DataFrame, part_rows: int = PART_ROWS) -> None:
    """One block-compressed file."""
    write_parts_file(records, target, order, histogram, "bam", part_rows)


def unpacked(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What the gzip members hold that follow each other in chunks of a file, piece by piece."""
    of, begun = zlib.decompressobj(31), False
    for data in chunks:
        while data:
            begun = True
            yield of.decompress(data)
            data = of.unused_data
            if of.eof:
                of, begun = zlib.decompressobj(31), False
    if begun:
        raise EOFError("the last member is cut short")


def content_digest(spark: SparkSession, path: str) -> DataFrame:
    """n_bytes, sha256 of what a block-compressed file holds.

    The digest of a file needs its bytes one after the other, so one task reads it, READ_BYTES at a time, and keeps no more.
    """
    where, fs = file_system(spark, path)
    uri = fs.makeQualified(where).toUri()
    full = f"file://{uri.getPath()}" if uri.getScheme() == "file" else uri.toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as storages

        for b in batches:
            for name in b.column(0).to_pylist():
                storage, at = storages.FileSystem.from_uri(name)
                digest, n = hashlib.sha256(), 0
                with storage.open_input_stream(at, compression=None) as source:
                    for data in unpacked(iter(lambda: source.read(READ_BYTES), b"")):
                        digest.update(data)
                        n += len(data)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names=["n_bytes", "sha256"])

    return spark.range(1, numPartitions=1).select(F.lit(full).alias("path")).mapInArrow(run, "n_bytes long, sha256 string")
