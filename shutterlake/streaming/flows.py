"""Streams whose sinks are keyed parquet folders, so that replayed batches change nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from shutterlake.operators.neardup import DEFAULT_DISTANCE, PAIR_SCHEMA, canonical_match_insert
from shutterlake.operators.stats import change_message
from shutterlake.sources.media import describe_files
from shutterlake.sources.tables import TableStore, log_rows
from shutterlake.streaming.matching import CATALOGUE, HashPool

FLUSH_EVERY = "2 minutes"


def minute_windows(events: DataFrame, ts: str = "ts", user: str = "user_id") -> DataFrame:
    """(user_id, window_start, count) per minute."""
    minute = F.date_trunc("minute", F.col(ts).cast("timestamp"))
    return events.groupBy(F.col(user).alias("user_id"), minute.alias("window_start")).agg(
        F.count("*").alias("count")
    )


def _start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str,
           once: bool, every: str) -> StreamingQuery:
    writer = (
        df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return writer.trigger(**trigger).start()


def _keep_batch(out: str) -> Callable[[DataFrame, int], None]:
    """Each batch owns the folder named after it and overwrites it when replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("seen_in", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}"
        )

    return write


def stream_activity(events: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Per-minute counters, flushed every two minutes; each flush holds what its own events add.

    The stream keeps no state and has no watermark, so an event counts however late it comes, and a
    replayed batch overwrites its own folder. ``stream_activity_state`` adds the flushes up.
    """
    keep = _keep_batch(out)
    return _start(events, lambda batch, n: keep(minute_windows(batch), n), checkpoint, "append", once, FLUSH_EVERY)


def latest_per_window(flushed: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in flushed.columns if c not in (*keys, "seen_in", "batch")]
    return flushed.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "seen_in").alias("v")
    ).select(*keys, "v.*")


def stream_activity_state(flushed: DataFrame) -> DataFrame:
    """(user_id, hour, minute, count) from the flushed windows."""
    return flushed.groupBy(
        "user_id", F.hour("window_start").alias("hour"), F.minute("window_start").alias("minute")
    ).agg(F.sum("count").alias("count"))


def stream_changes(changes: DataFrame, out: str, checkpoint: str, once: bool = False,
                   log: TableStore | None = None, stream_name: str = "changes") -> StreamingQuery:
    """Change feed as messages; media changes also go to the audit log, in batches named after the stream.

    ``changes`` has action, source, id, user_id, phase, processed, total, ts.
    """
    message = change_message(
        F.col("action"), F.col("source"), F.col("id"), F.col("user_id"), F.col("phase"),
        F.col("processed"), F.col("total"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("action", "source", "ts", message.alias("message")).write.mode(
            "overwrite"
        ).parquet(f"{out}/batch={batch_id}")
        if log is not None:
            media = batch.filter((F.col("source") == "mediaItem") & (F.col("action") != "progress"))
            rows = media.select(F.col("id").alias("item_id"), "action", "user_id", "ts")
            log.append_log(log_rows(rows, F.col("ts")), f"{stream_name}-{batch_id}")

    return _start(changes, write, checkpoint, "append", once, "1 second")


def progress_state(changes: DataFrame) -> DataFrame:
    """(source, phase, processed, total): the furthest progress per source."""
    return changes.filter("action = 'progress'").groupBy("source").agg(
        F.max_by(F.struct("phase", "processed", "total"), F.struct("ts", "processed")).alias("p")
    ).select("source", "p.phase", "p.processed", "p.total")


def stream_progress(changes: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    return _start(progress_state(changes), _keep_batch(out), checkpoint, "update", once, "1 second")


def stream_ingest(files: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str,
                  once: bool = False, mounted: bool = False) -> StreamingQuery:
    """New files -> ``apply(listing, batch_id)`` with md5 hashes, media files only.

    ``apply`` writes new table versions, as ``plans.indexing.index_listing`` does. With ``mounted`` (files
    that tasks can open by path, see ``sources.media.is_mounted``) files are hashed in chunks.
    """
    listing = describe_files(files, media_only=True, checksum="md5", chunked=mounted)
    return _start(listing, apply, checkpoint, "append", once, "10 seconds")


def stream_match(arrivals: DataFrame, match: Callable[[DataFrame, DataFrame], DataFrame], out: str,
                 pool: str, checkpoint: str, once: bool = False,
                 catalogued: DataFrame | None = None) -> StreamingQuery:
    """New items or faces compared with everything catalogued, with earlier arrivals and with each other.

    ``match(batch, known)`` returns the new match rows (``streaming.matching``). Each batch joins the
    folder ``pool`` and is compared with ``catalogued`` and the batches before it, so a replayed batch
    sees and writes what it did the first time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{pool}/batch={batch_id}")
        spark = batch.sparkSession
        schema = StructType([*batch.schema.fields, StructField("batch", LongType())])
        whole = spark.read.schema(schema).parquet(pool)
        own = whole.filter(F.col("batch") == batch_id).drop("batch")
        known = whole.filter(F.col("batch") < batch_id).drop("batch")
        if catalogued is not None:
            known = catalogued.select(*known.columns).unionByName(known)
        match(own, known).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(arrivals, write, checkpoint, "append", once, "10 seconds")


def stream_item_match(arrivals: DataFrame, root: str, checkpoint: str, threshold: int = DEFAULT_DISTANCE,
                      once: bool = False, catalogued: DataFrame | None = None) -> StreamingQuery:
    """New ``arrivals(id, hash)`` matched with all items catalogued or seen before; links stored once.

    ``root/index`` keeps the hashes (``matching.HashPool``), of ``catalogued`` from the first start on, and
    ``root/matches`` the links, lower id first: a pair stored by an earlier batch is not stored again, in either
    order. ``stored_matches`` reads them.
    """
    spark = arrivals.sparkSession
    pool = HashPool(spark, f"{root}/index", threshold)
    pool.build(catalogued)
    spark.createDataFrame([], PAIR_SCHEMA).write.mode("overwrite").parquet(f"{root}/matches/batch={CATALOGUE}")

    def write(batch: DataFrame, batch_id: int) -> None:
        own = f"{root}/arrivals/batch={batch_id}"
        batch.select(F.col("id").cast("bigint").alias("id"), "hash").write.mode("overwrite").parquet(own)
        items = batch.sparkSession.read.schema("id BIGINT, hash STRING").parquet(own)
        before = stored_matches(batch.sparkSession, root, batch_id)
        found = pool.match(items, batch_id)
        canonical_match_insert(before, found, "media_item_id", "matching_item_id").write.mode(
            "overwrite").parquet(f"{root}/matches/batch={batch_id}")

    return _start(arrivals, write, checkpoint, "append", once, "10 seconds")


def stored_matches(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The links stored by ``stream_item_match``, all or those of earlier batches."""
    stored = spark.read.schema(f"{PAIR_SCHEMA}, batch BIGINT").parquet(f"{root}/matches")
    return (stored if before is None else stored.filter(F.col("batch") < before)).drop("batch")
