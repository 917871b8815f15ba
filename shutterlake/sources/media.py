"""File trees as DataFrames."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shutterlake.functions.files import file_class, is_media_file, split_path
from shutterlake.session import cut_lineage

ALGORITHMS = ("md5", "sha1")
CHUNK_BYTES = 4 << 20
ENTRIES_AT_ONCE = 5000
ENTRY_SCHEMA = "path string, length long, folder boolean"
BINARY_STREAM_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def media_file_scan(spark: SparkSession, directory: str, media_only: bool = False,
                    checksum: str | None = None) -> DataFrame:
    """Recursive listing: path, dir, name, extension, size, type (and hash when asked for).

    Hidden folders (``.x``, ``_x``) and empty files are skipped by the file source. The scan itself touches file
    status alone. Checksums of files on local or mounted folders are computed in chunks, so files
    have no size limit there; on other file systems Spark reads ``content`` as a cell of at most 2 GB.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(directory)
    )
    return describe_files(raw, media_only, checksum, chunked=is_mounted(spark, directory))


def walk_files(spark: SparkSession, directory: str, media_only: bool = False,
               checksum: str | None = None) -> DataFrame:
    """The listing of ``media_file_scan`` for a local or mounted folder, made by the tasks.

    Each round reads all folders of one depth in parallel and writes what it finds to the shared
    folder, so neither the driver nor a task ever holds a tree, and a lost round's rows are read back.
    Folders that start with ``.`` or ``_`` are skipped; files of such names and empty files are
    listed. Links are neither followed nor listed. A folder that goes away meanwhile has no entries.
    """
    if not is_mounted(spark, directory):
        raise ValueError(f"tasks cannot open {directory!r} by its path")
    top = "/" + re.sub("^file:", "", directory).strip("/")
    tasks = spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([(top,)], "path string")
    found = []
    while not level.isEmpty():
        entries = cut_lineage(level.repartition(tasks, "path").mapInArrow(read_folders, ENTRY_SCHEMA))
        found.append(entries.filter("NOT folder").select("path", "length"))
        level = entries.filter("folder").select("path")
    return describe_files(reduce(DataFrame.unionByName, found), media_only, checksum, chunked=True)


def read_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries (path, length, folder) of the folders in column 0, some thousand at a time."""
    entries: list[tuple[str, int, bool]] = []

    def made() -> pa.RecordBatch:
        rows = [{"path": p, "length": n, "folder": f} for p, n, f in entries]
        entries.clear()
        return pa.RecordBatch.from_pylist(rows, pa.schema(
            [("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_())]))

    for batch in batches:
        for folder in batch.column(0).to_pylist():
            try:
                with os.scandir(folder) as inside:
                    for entry in inside:
                        if entry.is_dir(follow_symlinks=False):
                            if not entry.name.startswith((".", "_")):
                                entries.append((entry.path, 0, True))
                        elif entry.is_file(follow_symlinks=False):
                            entries.append((entry.path, entry.stat(follow_symlinks=False).st_size, False))
                        if len(entries) >= ENTRIES_AT_ONCE:
                            yield made()
            except FileNotFoundError:
                continue
    yield made()


def is_mounted(spark: SparkSession, directory: str) -> bool:
    """Whether tasks can open the files of a folder by their paths."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return (urlsplit(directory).scheme or urlsplit(default).scheme) == "file"


def describe_files(raw: DataFrame, media_only: bool = False, checksum: str | None = None,
                   chunked: bool = False) -> DataFrame:
    """Batch or streaming binaryFile rows -> the columns of a file listing.

    With ``chunked`` the checksum is that of the file at the path, read in pieces by the task that
    lists it, and ``content`` is not read.
    """
    parts = split_path(F.col("path"))
    columns = [
        F.regexp_replace("path", "^[a-z0-9]+:/+", "/").alias("path"),
        parts["dir"].alias("dir"),
        parts["name"].alias("name"),
        parts["extension"].alias("extension"),
        F.col("length").alias("size"),
    ]
    if checksum and not chunked:
        columns.append(content_checksum(checksum).alias("hash"))
    listed = raw.select(*columns)
    if media_only:
        listed = listed.filter(is_media_file(F.col("extension")))
    if checksum and chunked:
        listed = add_file_checksum(listed, checksum)
    return listed.withColumn("type", file_class(F.col("extension")))


def content_checksum(algorithm: str = "md5"):
    if algorithm == "md5":
        return F.md5("content")
    if algorithm == "sha1":
        return F.sha1("content")
    raise ValueError(f"unknown checksum {algorithm!r}")


def add_file_checksum(files: DataFrame, algorithm: str = "md5", path: str = "path",
                      name: str = "hash") -> DataFrame:
    """``files`` and the checksum of the file at each ``path``; null for no path or a file that is gone.

    A task holds one chunk of one file. No shuffle: a listing's partitions are balanced by file size.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown checksum {algorithm!r}")
    at = files.columns.index(path)
    schema = StructType([*files.schema.fields, StructField(name, StringType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [file_checksum(p, algorithm) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=schema.names)

    return files.mapInArrow(compute, schema)


def file_checksum(path: str | None, algorithm: str) -> str | None:
    """Hex digest of a file, read in chunks."""
    if path is None:
        return None
    digest, chunk = hashlib.new(algorithm), bytearray(CHUNK_BYTES)
    try:
        with open(path, "rb", buffering=0) as file:
            while count := file.readinto(chunk):
                digest.update(memoryview(chunk)[:count])
    except FileNotFoundError:
        return None
    return digest.hexdigest()


def image_pixels(spark: SparkSession, directory: str) -> DataFrame:
    """Decoded images: path, width, height, channels, data (BGR bytes, row by row).

    Files that are no images are dropped.
    """
    images = (
        spark.read.format("image")
        .option("recursiveFileLookup", True)
        .option("dropInvalid", True)
        .load(directory)
    )
    return images.select(
        F.regexp_replace("image.origin", "^[a-z0-9]+:/+", "/").alias("path"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )


def media_file_stream(spark: SparkSession, directory: str, files_per_batch: int | None = None) -> DataFrame:
    """Newly arriving files; the query's checkpoint remembers what it has seen."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_STREAM_SCHEMA).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(directory)
