"""What the operators share: reading, Arrow batches with computed columns, ASCII lower-casing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from shutterlake.session import shared_dir, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TEXTS_AT_ONCE = 256  # texts turned into Python objects at a time
BATCH_ROWS = 1000    # rows of an Arrow batch: ten thousand long texts would not fit a task
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ships the package to the workers and bounds the session's Arrow batches."""
    ship_package(spark)
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has, for columns that are dropped again."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def byte_texts(column: pa.Array) -> Iterator[list[bytes | None]]:
    """The UTF-8 bytes of a text column, some hundred rows at a time."""
    for start in range(0, len(column), TEXTS_AT_ONCE):
        yield column.slice(start, TEXTS_AT_ONCE).cast(pa.binary()).to_pylist()


def word_table(word: Callable[[int], bool]) -> bytes:
    """For bytes.translate: A-Z lower-cased, bytes outside words turned into spaces."""
    lowered = bytes(range(256)).lower()
    return bytes(b if word(b) else 0x20 for b in lowered)


def release_memory() -> None:
    """Returns what Arrow and the C allocator keep for later to the system, where they can."""
    pa.default_memory_pool().release_unused()
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # another C library
        return
    trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow, whose caches do not stay with the idle Python worker after the task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return tidied


def with_columns_from_text(
    df: DataFrame, text: str, fields: list[StructField], prepare: Callable[[], Callable]
) -> DataFrame:
    """``df`` and further columns, computed row by row from one text column.

    ``prepare`` runs once per task and returns a function from the text's bytes (or None) to one
    tuple with a value per field. The other columns go through untouched, whatever their names.
    """
    at = df.columns.index(text)
    schema = StructType([*df.schema.fields, *fields])
    names = [f.name for f in schema.fields]
    count = len(fields)
    types = [_arrow_type(f) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = prepare()
        for batch in batches:
            made: list[list] = [[] for _ in range(count)]
            for texts in byte_texts(batch.column(at)):
                for data in texts:
                    for column, value in zip(made, compute(data)):
                        column.append(value)
            arrays = [pa.array(column, type=kind) for column, kind in zip(made, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    return df.mapInArrow(tidy(run), schema)


def _arrow_type(field: StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a table given in DDL; on the driver only."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


class GrowingTable:
    """A table in the shared folder that gains rows round by round and is read by one scan."""

    def __init__(self, spark: SparkSession, ddl: str):
        self._spark = spark
        self._schema = StructType.fromDDL(ddl)
        self._folder = f"{shared_dir(spark).rstrip('/')}/kept/{uuid.uuid4().hex}"
        self._parts: list[str] = []

    def add(self, rows: DataFrame) -> None:
        path = f"{self._folder}/{len(self._parts)}"
        rows.select(*self._schema.names).write.parquet(path)
        self._parts.append(path)

    def read(self) -> DataFrame:
        if not self._parts:
            return self._spark.createDataFrame([], self._schema)
        return self._spark.read.schema(self._schema).parquet(*self._parts)


def code_point_offsets(data: bytes, offsets: list[int]) -> list[int]:
    """Code-point positions of ascending byte offsets in UTF-8 bytes."""
    out, seen, at = [], 0, 0
    for offset in offsets:
        seen += len(data[at:offset].decode("utf-8", "replace"))
        at = offset
        out.append(seen)
    return out
