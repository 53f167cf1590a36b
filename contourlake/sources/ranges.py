"""Large single files in many tasks: records of fixed length, entries of zip archives, numbered lines, and files that tasks write in parts.

Readers are Python data sources whose partitions are byte ranges or ranges of archive entries. Paths are opened through pyarrow's file systems (local or mounted paths, hdfs, s3, gs), so every task reads its own range; other schemes raise.
"""

from __future__ import annotations

import os
import uuid
import zipfile
from functools import partial

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..operators.common import cut, shared_dir

#: Bytes of a range, of a batch, and entries of an archive's range.
RANGE, BATCH, ENTRIES = 64 << 20, 4 << 20, 2000


def opened(path: str) -> tuple[pf.FileSystem, str]:
    """The file system and the path inside it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pf.LocalFileSystem(), os.path.abspath(path)
    return pf.FileSystem.from_uri(path)


class _Range(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class _Records(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.header, self.record, self.range = options["path"], int(options["header"]), int(options["record"]), int(options["range"])

    def partitions(self):
        fs, path = opened(self.path)
        n = -(-max(fs.get_file_info(path).size - self.header, 0) // self.record)
        step = max(1, self.range // self.record)
        return [_Range(at, min(step, n - at)) for at in range(0, n, step)] or [_Range(0, 0)]

    def read(self, partition):
        fs, path = opened(self.path)
        schema = pa.schema([("record_no", pa.int64()), ("content", pa.binary())])
        with fs.open_input_file(path) as f:
            step = max(1, BATCH // self.record)
            for at in range(partition.first, partition.first + partition.count, step):
                n = min(step, partition.first + partition.count - at)
                data = f.read_at(n * self.record, self.header + at * self.record)
                own = [data[i : i + self.record] for i in range(0, len(data), self.record)]
                yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(own)), pa.int64()), pa.array(own, pa.binary())], schema=schema)


class RecordFile(DataSource):
    """Options path, header (bytes to skip), record (bytes of each; the last may be shorter), range (bytes of a partition)."""

    @classmethod
    def name(cls):
        return "fixed_records"

    def schema(self):
        return "record_no long, content binary"

    def reader(self, schema):
        return _Records(self.options)


def read_at(path: str, size: int, at: int = 0) -> bytes:
    """Some bytes of a file; fewer, or none, at its end."""
    fs, inside = opened(path)
    with fs.open_input_file(inside) as f:
        return f.read_at(max(0, min(size, f.size() - at)), min(at, f.size()))


def fixed_records(spark: SparkSession, path: str, record: int, header: int = 0, size: int | None = None) -> DataFrame:
    """record_no, content of a file of equally long records; ``size``: bytes of a partition."""
    spark.dataSource.register(RecordFile)
    return spark.read.format("fixed_records").options(path=path, header=header, record=record, range=size or RANGE).load()


class _Entries(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.entries, self.only = options["path"], int(options["entries"]), options.get("only")

    def _own(self, archive):
        return [x for x in archive.infolist() if not x.is_dir() and self.only in (None, x.filename)]

    def partitions(self):
        fs, path = opened(self.path)
        with fs.open_input_file(path) as f:  # the directory at its end only
            n = len(self._own(zipfile.ZipFile(f)))
        return [_Range(at, min(self.entries, n - at)) for at in range(0, n, self.entries)] or [_Range(0, 0)]

    def read(self, partition):
        fs, path = opened(self.path)
        schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            for entry in self._own(archive)[partition.first : partition.first + partition.count]:
                yield pa.RecordBatch.from_arrays([pa.array([entry.filename]), pa.array([archive.read(entry)], pa.binary())], schema=schema)


class ZipEntries(DataSource):
    """Options path, entries (of a partition), only (the name of one entry)."""

    @classmethod
    def name(cls):
        return "zip_entries"

    def schema(self):
        return "path string, content binary"

    def reader(self, schema):
        return _Entries(self.options)


def zip_entries(spark: SparkSession, path: str, entries: int | None = None, name: str | None = None) -> DataFrame:
    """path, content of the files in an archive, or of the one of a name; tasks read the directory at its end and their own entries."""
    spark.dataSource.register(ZipEntries)
    only = {} if name is None else {"only": name}
    return spark.read.format("zip_entries").options(path=path, entries=entries or ENTRIES, **only).load()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (long, from 0), line of one text file, in file order, however many splits it has.

    Rows of a split keep their order and know where it begins, so a line's number is its place in the split and the counts of the splits before it.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", r"\r\z", "").alias("line"))
    rows = cut(rows, "lines")
    # A row for each split.
    splits = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_file", "_start", (before - F.col("_first")).alias("_base"))
    return rows.join(F.broadcast(splits), ["_file", "_start"]).select((F.col("_at") + F.col("_base")).alias("line_no"), "line")


def _write_part(batches, folder: str):
    """One file of a task's contents, under a name of its own: only what a finished task names is used."""
    from pyspark import TaskContext

    fs, inside = opened(folder)
    name, rows, length = f"{uuid.uuid4().hex}.part", 0, -1
    with fs.open_output_stream(f"{inside}/{name}") as f:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                f.write(content)
                rows, length = rows + 1, len(content) if length < 0 else length
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([rows]), pa.array([length])], names=["part", "name", "rows", "length"])


def write_records(df: DataFrame, order: list, path: str, header=None) -> int:
    """One file of df's ``content`` (binary) in the order given; returns the number of records.

    Tasks write parts of a range of the order to the shared folder; the driver's JVM then copies their bytes one after the other. ``header(records, length of the first)`` gives the bytes in front.
    """
    spark = df.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    folder = f"{shared_dir(spark)}/contourlake/parts-{uuid.uuid4().hex}"
    store = hadoop.fs.Path(folder).getFileSystem(conf)
    store.mkdirs(hadoop.fs.Path(folder))
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).select("content")
    # A row for each task.
    parts = sorted_.mapInArrow(partial(_write_part, folder=folder), "part int, name string, rows long, length long").orderBy("part").collect()
    n, length = sum(p["rows"] for p in parts), next((p["length"] for p in parts if p["rows"]), 0)
    target = hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        if header:
            out.write(bytearray(header(n, length)))
        for p in parts:
            source = store.open(hadoop.fs.Path(f"{folder}/{p['name']}"))
            hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
    finally:
        out.close()
    store.delete(hadoop.fs.Path(folder), True)
    return n
