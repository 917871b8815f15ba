"""Plans for moving files: which, under what names, and whether the copies are good."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.scalars import date_stem
from shutterlake.operators.keyed import find_or_create, number_within


def items_in_dirs(dirs: DataFrame, paths: DataFrame, files: DataFrame, links: DataFrame,
                  items: DataFrame) -> DataFrame:
    """Items with any file in the directories ``dirs(dir)``; a chain of semi-joins."""
    where = paths.join(dirs.select("dir"), "dir", "left_semi").select(F.col("id").alias("path_id"))
    inside = files.join(where, "path_id", "left_semi").select(F.col("id").alias("file_id"))
    holding = links.join(inside, "file_id", "left_semi").select(F.col("media_item_id").alias("id"))
    return items.join(holding, "id", "left_semi").select("id", "start_date")


def move_candidates(items: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """(item_id, file_id, extension, path_id, stem): files of dated items, named by date."""
    dated = items.filter("start_date IS NOT NULL AND start_date <> ''").select(
        F.col("id").alias("media_item_id"),
        F.concat(F.lit("IMG_"), date_stem(F.col("start_date"))).alias("stem"),
    )
    held = files.select(F.col("id").alias("file_id"), "extension", "path_id")
    return dated.join(links.select("media_item_id", "file_id"), "media_item_id").join(
        held, "file_id"
    ).select(F.col("media_item_id").alias("item_id"), "file_id", "extension", "path_id", "stem")


def unique_names(candidates: DataFrame) -> DataFrame:
    """Adds ``new_name``: the stem, then stem(2), stem(3)… for further files of one name.

    Names clash regardless of case, per extension, in item then file order. The numbering is exact
    also when a third of all files share a stem (``number_within``).
    """
    suffix = F.when(F.length("extension") > 0, F.concat(F.lit("."), F.col("extension"))).otherwise("")
    keyed = candidates.withColumn("_key", F.lower(F.concat("stem", suffix)))
    numbered = number_within(keyed, ["_key"], "item_id", ["file_id"], "_n")
    name = F.when(F.col("_n") == 1, F.col("stem")).otherwise(
        F.concat("stem", F.lit("("), F.col("_n").cast("string"), F.lit(")"))
    )
    return numbered.withColumn("new_name", name).drop("_key", "_n")


def move_report(items: DataFrame, links: DataFrame) -> DataFrame:
    """One row: moved and skipped items; items without a date or without files are skipped."""
    with_files = links.select(F.col("media_item_id").alias("id"), F.lit(True).alias("_f")).distinct()
    ready = F.coalesce(F.length("start_date") > 0, F.lit(False)) & F.col("_f").isNotNull()
    return items.join(with_files, "id", "left").agg(
        F.count_if(ready).alias("moved"), F.count_if(~ready).alias("skipped")
    )


def checksum_audit(source: DataFrame, copy: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict) comparing hashes of originals and copies: ok, mismatch, missing_copy or
    missing_source."""
    both = source.select(*keys, F.col("hash").alias("_s"), F.lit(True).alias("_hs")).join(
        copy.select(*keys, F.col("hash").alias("_c"), F.lit(True).alias("_hc")), keys, "full_outer"
    )
    verdict = (
        F.when(F.col("_hs").isNull(), "missing_source")
        .when(F.col("_hc").isNull(), "missing_copy")
        .when(F.col("_s") == F.col("_c"), "ok")
        .otherwise("mismatch")
    )
    return both.select(*keys, verdict.alias("verdict"))


def repoint_files(files: DataFrame, paths: DataFrame,
                  moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, paths) after moves (file_id, dir[, new_name]); new directories are registered.

    A new directory belongs to the host of the directory its first file came from.
    """
    host = paths.select(F.col("id").alias("path_id"), "host_id")
    located = moves.join(
        files.select(F.col("id").alias("file_id"), "path_id"), "file_id"
    ).join(host, "path_id").drop("path_id")
    all_paths = find_or_create(paths, located.select("dir", "host_id"), ["dir", "host_id"])
    target = located.join(
        all_paths.select(F.col("id").alias("_path"), "dir", "host_id"), ["dir", "host_id"]
    )
    name = F.col("new_name") if "new_name" in moves.columns else F.lit(None).cast("string")
    target = target.select(F.col("file_id").alias("id"), "_path", name.alias("_name"))
    moved = files.join(target, "id", "left").withColumns({
        "path_id": F.coalesce("_path", "path_id"), "name": F.coalesce("_name", "name"),
    })
    return moved.select(*files.columns), all_paths
