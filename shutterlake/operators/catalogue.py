"""Directory listing -> catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.files import file_class, full_path, group_name, primary_rank
from shutterlake.functions.tags import item_info
from shutterlake.operators.graph import folder_chains
from shutterlake.operators.keyed import assign_ids, dense_number, find_or_create, upsert
from shutterlake.session import cut_lineage


def register_paths(paths: DataFrame, listing: DataFrame, host_id: int = 1) -> DataFrame:
    """The path table with every listed directory; known (dir, host) rows keep their id."""
    wanted = listing.select("dir").withColumn("host_id", F.lit(host_id).cast("bigint"))
    return find_or_create(paths, wanted, ["dir", "host_id"])


def register_files(files: DataFrame, listing: DataFrame, paths: DataFrame) -> DataFrame:
    """The file table after a scan: known files get the new size and hash, others are added.

    ``listing`` has dir, name, extension, size, hash.
    """
    keys = ["path_id", "name", "extension"]
    seen = listing.join(paths.select(F.col("id").alias("path_id"), "dir"), "dir").select(
        *keys, "size", "hash", file_class(F.col("extension")).alias("type")
    )
    extended = find_or_create(files, seen, keys)
    refreshed = upsert(extended, seen, keys)
    return refreshed.withColumn("size", F.col("size").cast("bigint"))


def group_files(listing: DataFrame) -> DataFrame:
    """Adds base_name, so that (dir, base_name) names the group a file belongs to."""
    return listing.withColumn("base_name", group_name(F.col("name")))


def file_groups(listing: DataFrame) -> DataFrame:
    """(dir, base_name, files, primary_name, primary_extension): size and primary of every group.

    The primary is the lowest (rank, path): a plain minimum, combined before the shuffle, so a
    directory or group of any size is fine.
    """
    grouped = group_files(listing)
    rank = F.struct(
        primary_rank(F.col("extension"), F.col("size")).alias("rank"),
        full_path(F.col("dir"), F.col("name"), F.col("extension")).alias("path"),
        F.col("name"), F.col("extension"),
    )
    return (
        grouped.groupBy("dir", "base_name")
        .agg(F.count("*").alias("files"), F.min(rank).alias("p"))
        .select(
            "dir", "base_name", "files", F.col("p.name").alias("primary_name"),
            F.col("p.extension").alias("primary_extension"),
        )
    )


def pick_primary(listing: DataFrame) -> DataFrame:
    """The listing with base_name and is_primary."""
    groups = file_groups(listing).select("dir", "base_name", "primary_name", "primary_extension")
    return (
        group_files(listing)
        .join(groups, ["dir", "base_name"])
        .withColumn(
            "is_primary",
            (F.col("name") == F.col("primary_name"))
            & F.col("extension").eqNullSafe(F.col("primary_extension")),
        )
        .drop("primary_name", "primary_extension")
    )


def split_new_existing(grouped_files: DataFrame, links: DataFrame) -> DataFrame:
    """(dir, base_name, media_item_id): the item a group belongs to already, null for new groups.

    ``grouped_files`` has dir, base_name, file_id.
    """
    known = links.select("file_id", "media_item_id")
    return (
        grouped_files.join(known, "file_id", "left")
        .groupBy("dir", "base_name")
        .agg(F.min("media_item_id").alias("media_item_id"))
    )


def build_item_info(metadata: DataFrame) -> DataFrame:
    """Adds the info struct assembled from the metadata columns."""
    parts = ["camera", "exposure", "iptc", "gps", "duration", "frameRate", "width", "height"]
    return metadata.withColumn("info", item_info(F.struct(*parts)))


def link_item_files(links: DataFrame, grouped_files: DataFrame) -> DataFrame:
    """The link table plus one row per file of each item (media_item_id, file_id, is_primary).

    A link that exists takes over whether its file is the primary.
    """
    wanted = grouped_files.select("media_item_id", "file_id", "is_primary")
    return upsert(links, wanted, ["media_item_id", "file_id"])


def folder_paths(directories: DataFrame, root: str | None = None) -> DataFrame:
    """(path, name, parent_path): every prefix of every directory, the root's basename on top.

    ``directories(dir)``. Prefixes are made per distinct directory and de-duplicated.
    """
    distinct = directories.select("dir").distinct()
    if root is not None:
        top = root.rstrip("/").rsplit("/", 1)[-1]
        relative = F.regexp_replace(F.expr(f"substring(dir, {len(root.rstrip('/')) + 1})"), "^/", "")
        distinct = distinct.select(
            F.concat_ws("/", F.lit(top), F.when(relative != "", relative)).alias("dir")
        )
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    split = distinct.select(parts.alias("p")).filter(F.size("p") > 0)
    prefixes = split.select(
        F.explode(
            F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.slice(F.col("p"), 1, n))
        ).alias("q")
    )
    return prefixes.select(
        F.array_join("q", "/").alias("path"),
        F.element_at("q", -1).alias("name"),
        F.when(F.size("q") > 1, F.array_join(F.slice("q", 1, F.size("q") - 1), "/")).alias(
            "parent_path"
        ),
    ).distinct()


def build_folder_tree(directories: DataFrame, root: str | None = None,
                      existing: DataFrame | None = None) -> DataFrame:
    """(id, name, parent_id, path) of the folder tree; folders already known keep their id.

    Folders are recognised by their full path, so a nested folder never stands in for the root.
    """
    wanted = folder_paths(directories, root)
    if existing is None:
        numbered = dense_number(wanted, ["path"], "id")
    else:
        known = folder_chains(existing).select("id", "path")
        fresh = wanted.join(known, "path", "left_anti")
        numbered = wanted.join(known, "path").unionByName(assign_ids(existing, fresh, ["path"]))
    parents = numbered.select(F.col("id").alias("parent_id"), F.col("path").alias("parent_path"))
    return numbered.join(parents, "parent_path", "left").select("id", "name", "parent_id", "path")


def ordinals(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Zero-based position of each row in the order of ``keys``, over the whole table.

    Range-partitioned sort, written out so that positions stay what they are; each partition is
    shifted by the sizes of those before it (one row per partition, so that window is bounded).
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut_lineage(
        ordered.withColumns({
            "_part": F.spark_partition_id(),
            "_pos": F.monotonically_increasing_id(),
        }).withColumn("_pos", F.col("_pos") - F.shiftleft(F.col("_part").cast("bigint"), 33))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .drop("_part", "_pos", "_offset")
    )


def build_folder_entries(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """folder_entry rows: existing ones first, then (folder_id, item_id, index = group ordinal).

    ``groups`` has folder_id, item_id, dir, base_name.
    """
    placed = ordinals(groups, ["dir", "base_name"], "index")
    return upsert(
        entries, placed.select("folder_id", "item_id", "index"), ["folder_id", "item_id"],
        mode="ignore",
    )


# --- differences between disk and catalogue ---------------------------------------------------

def catalogue_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(file_id, path): where every catalogued file should be."""
    where = paths.select(F.col("id").alias("path_id"), "dir")
    return files.join(where, "path_id", "left").select(
        F.col("id").alias("file_id"),
        full_path(F.coalesce("dir", F.lit("")), F.col("name"), F.col("extension")).alias("path"),
    )


def orphan_files(files: DataFrame, paths: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(file_id, path) of catalogued files that are not in the scan ``on_disk(path)``."""
    return catalogue_paths(files, paths).join(on_disk.select("path"), "path", "left_anti")


def items_without_files(items: DataFrame, links: DataFrame) -> DataFrame:
    return items.select("id").join(
        links.select(F.col("media_item_id").alias("id")), "id", "left_anti"
    )


def paths_without_files(paths: DataFrame, files: DataFrame) -> DataFrame:
    return paths.select("id", "dir").join(
        files.select(F.col("path_id").alias("id")), "id", "left_anti"
    )


def prune_empty_folders(folders: DataFrame, entries: DataFrame) -> DataFrame:
    """Folders that hold no entry anywhere below them: what repeated deletion of empty leaves removes."""
    used = entries.select(F.col("folder_id").alias("id")).distinct()
    chains = folder_chains(folders)
    kept = chains.join(used, "id", "left_semi").select(F.explode("chain").alias("id")).distinct()
    return chains.select("id", "name", "path").join(kept, "id", "left_anti")


def index_summary(**tables: DataFrame) -> DataFrame:
    """(what, rows) for the tables given by name."""
    from shutterlake.operators.stats import table_counts

    return table_counts(tables)


def split_orphans(files: DataFrame, paths: DataFrame, links: DataFrame, items: DataFrame,
                  on_disk: DataFrame) -> dict[str, DataFrame]:
    """Ids to delete after a scan: files gone from disk, then items and paths left without files."""
    gone = orphan_files(files, paths, on_disk).select(F.col("file_id").alias("id"))
    left_files = files.join(gone, "id", "left_anti")
    left_links = links.join(gone.withColumnRenamed("id", "file_id"), "file_id", "left_anti")
    return {
        "file": gone,
        "media_item": items_without_files(items, left_links),
        "path": paths_without_files(paths, left_files).select("id"),
    }
