"""Catalogue tables on storage: versioned parquet snapshots and append-only logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.scalars import iso_timestamp
from shutterlake.schema import table_schema

LOG = "media_log"


class TableStore:
    """Tables under one root; every write of a table makes a new version folder.

    Parquet has no merge and a job cannot overwrite the folder it reads, so a new state goes to
    ``root/name/v=<n>`` and readers take the highest version that has a ``_SUCCESS`` mark. A writer
    that dies half-way leaves a version no reader looks at.

    Audit rows are appended beside the versions of ``media_log`` without rewriting it: batches go to
    ``media_log/after=<version>`` and are part of the table until a later version, which holds them
    already, replaces it. One writer at a time makes versions of a table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def finished(self, folder: str, prefix: str) -> list[str]:
        """What follows ``prefix`` in the names of the finished folders inside ``folder``."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = []
        for status in fs.listStatus(path):
            text = status.getPath().getName()
            done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if text.startswith(prefix) and fs.exists(done):
                found.append(text[len(prefix):])
        return found

    def _versions(self, name: str) -> list[int]:
        return sorted(int(n) for n in self.finished(name, "v="))

    def has(self, name: str) -> bool:
        """Whether anything was written to the table."""
        return bool(self.version(name) or name == LOG and self.finished(f"{LOG}/after=0", "batch="))

    def version(self, name: str) -> int:
        return max(self._versions(name), default=0)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The newest (or a given) version; an empty table when nothing was written yet."""
        schema = table_schema(name)
        number = version or self.version(name)
        folders = [f"{self.root}/{name}/v={number}"] if number else []
        if name == LOG and version is None:
            after = f"{LOG}/after={number}"
            folders += [f"{self.root}/{after}/batch={b}" for b in self.finished(after, "batch=")]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def write(self, name: str, df: DataFrame) -> int:
        schema = table_schema(name)
        shaped = df.select(
            *[
                (F.col(f.name) if f.name in df.columns else F.lit(None))
                .cast(f.dataType)
                .alias(f.name)
                for f in schema
            ]
        )
        number = self.version(name) + 1
        shaped.write.mode("overwrite").parquet(f"{self.root}/{name}/v={number}")
        return number

    def append_log(self, rows: DataFrame, batch: str | None = None) -> None:
        """Adds audit rows to the media log; never rewrites it.

        A named batch is written once: a replay overwrites it, or does nothing when a version of the
        table holds it already.
        """
        name = batch or uuid.uuid4().hex
        current = self.version(LOG)
        if any(name in self.finished(f"{LOG}/after={v}", "batch=") for v in range(current)):
            return
        shaped = rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table_schema(LOG)
        ])
        shaped.write.mode("overwrite").parquet(f"{self.root}/{LOG}/after={current}/batch={name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lists one catalogue table with its declared schema."""
    return TableStore(spark, root).read(name)


def log_rows(changes: DataFrame, at: Column | None = None) -> DataFrame:
    """Audit rows from (item_id, action[, user_id]); user 1 unless given, time now unless given."""
    user = F.coalesce(F.col("user_id"), F.lit(1)) if "user_id" in changes.columns else F.lit(1)
    return changes.select(
        F.col("item_id").cast("bigint").alias("item_id"),
        user.cast("bigint").alias("user_id"),
        iso_timestamp(F.current_timestamp() if at is None else at).alias("date"),
        F.col("action").alias("action"),
    )
