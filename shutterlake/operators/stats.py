"""Library statistics and change messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(what, rows): each count is its own small aggregate, answered from file statistics."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("what"), "rows")
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


def library_stats(t: dict[str, DataFrame]) -> DataFrame:
    """(what, rows) for the twelve dashboard figures."""
    by_type = t["media_item"].agg(
        F.count("*").alias("media_items"),
        F.count_if(F.col("type") == "image").alias("images"),
        F.count_if(F.col("type") == "video").alias("videos"),
    )
    typed = by_type.select(
        F.expr("stack(3, 'media_items', media_items, 'images', images, 'videos', videos) AS (what, rows)")
    )
    rest = table_counts({
        "paths": t["path"], "files": t["file"], "features": t["feature"],
        "matches": t["media_match"], "people": t["person"], "places": t["place"],
        "keywords": t["keyword"], "users": t["user"], "face_rejections": t["face_rejection"],
    })
    return typed.unionByName(rest)


def path_file_counts(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(id, dir, file_count), zero included; files are counted before they meet the paths."""
    counts = files.groupBy("path_id").agg(F.count("*").alias("file_count"))
    return paths.join(counts, F.col("id") == F.col("path_id"), "left").select(
        "id", "dir", F.coalesce("file_count", F.lit(0)).alias("file_count")
    )


def reindex_roots(paths: DataFrame) -> DataFrame:
    """Distinct parent folders of the registered ones; ``/`` for top-level folders."""
    parent = F.regexp_replace("dir", "/?[^/]*$", "")
    return paths.select(F.when(parent == "", "/").otherwise(parent).alias("dir")).distinct()


def phase_profile(timings: DataFrame) -> DataFrame:
    """(phase, count, total_ms, min_ms, max_ms, mean_ms) from (phase, ms); list by total_ms desc."""
    return timings.groupBy("phase").agg(
        F.count("*").alias("count"), F.sum("ms").alias("total_ms"), F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"), F.avg("ms").alias("mean_ms"),
    )


def wall_time(timings: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row: wall_ms from the first start to the last end."""
    micros = F.unix_micros(F.max(end)) - F.unix_micros(F.min(start))
    return timings.agg((micros / 1000).alias("wall_ms"))


def change_message(action: Column, source: Column, item_id: Column, user_id: Column,
                   phase: Column, processed: Column, total: Column) -> Column:
    """``action,source,id,userId``; progress: ``progress,source,phase:processed/total,``."""
    def text(value: Column, default: str = "") -> Column:
        return F.coalesce(value.cast("string"), F.lit(default))

    progress = F.concat(
        F.lit("progress,"), source, F.lit(","), text(phase), F.lit(":"), text(processed, "0"),
        F.lit("/"), text(total, "0"), F.lit(","),
    )
    change = F.concat(action, F.lit(","), source, F.lit(","), text(item_id), F.lit(","), text(user_id))
    return F.when(action == "progress", progress).otherwise(change)

