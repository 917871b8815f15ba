"""Directory listing -> new versions of the catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.files import file_class
from shutterlake.operators import catalogue, keyed
from shutterlake.schema import DELETE_RULES
from shutterlake.session import cut_lineage
from shutterlake.sources.tables import TableStore


def index_listing(store: TableStore, listing: DataFrame, root: str, host_id: int = 1,
                  metadata: DataFrame | None = None, hashes: DataFrame | None = None) -> dict[str, int]:
    """Registers a scan (dir, name, extension, size, hash) and writes the tables it changes.

    Known files get their new size and hash, groups of known files refresh their item, the rest
    become new items. A scan may hold part of a group only: files of the same group that are known
    already take part in the choice of the primary, so ingest in pieces ends like ingest at once.
    ``metadata`` (dir, name, extension and the columns of ``metadata_by_type``)
    supplies dates and info, ``hashes`` (dir, name, extension, phash) perceptual hashes of primary
    files. Returns the versions written. Running it twice on one scan changes nothing.
    """
    scan = cut_lineage(listing.select("dir", "name", "extension", "size", "hash"))
    paths = catalogue.register_paths(store.read("path"), scan, host_id)
    written = {"path": store.write("path", paths)}
    paths = store.read("path")
    written["file"] = store.write("file", catalogue.register_files(store.read("file"), scan, paths))
    files = store.read("file")

    known = files.join(paths.select(F.col("id").alias("path_id"), "dir"), "path_id")
    touched = catalogue.group_files(scan).select("dir", "base_name").distinct()
    whole = cut_lineage(
        catalogue.group_files(known).join(touched, ["dir", "base_name"], "left_semi")
        .select(F.col("id").alias("file_id"), "dir", "name", "extension", "size", "hash")
    )
    grouped = cut_lineage(catalogue.pick_primary(whole).select(
        "dir", "base_name", "name", "extension", "file_id", "is_primary"))
    links = store.read("media_item_file")
    items = store.read("media_item")
    owners = catalogue.split_new_existing(grouped, links)
    fresh = _new_item_ids(items, owners)
    owned = cut_lineage(owners.filter("media_item_id IS NOT NULL").unionByName(fresh))
    primary = grouped.filter("is_primary").join(owned, ["dir", "base_name"])
    described = _describe(primary, metadata, hashes)
    written["media_item"] = store.write("media_item", keyed.upsert(items, described, ["id"]))

    member = grouped.join(owned, ["dir", "base_name"])
    written["media_item_file"] = store.write(
        "media_item_file", catalogue.link_item_files(links, member)
    )
    old_folders = store.read("folder")
    tree = catalogue.build_folder_tree(scan, root, old_folders if store.version("folder") else None)
    tree = cut_lineage(tree)
    written["folder"] = store.write(
        "folder", keyed.upsert(old_folders, tree.select("id", "name", "parent_id"), ["id"])
    )
    top = root.rstrip("/")
    parent = top.rsplit("/", 1)[0]
    where = tree.select(
        F.col("id").alias("folder_id"), F.concat(F.lit(f"{parent}/"), "path").alias("dir")
    )
    placed = owned.join(where, "dir").select(
        "folder_id", F.col("media_item_id").alias("item_id"), "dir", "base_name"
    )
    entries = store.read("folder_entry")
    merged = catalogue.build_folder_entries(entries, placed)
    known = merged.filter("id IS NOT NULL")
    numbered = keyed.assign_ids(
        entries, merged.filter("id IS NULL").drop("id"), ["folder_id", "item_id"]
    )
    written["folder_entry"] = store.write(
        "folder_entry", known.unionByName(numbered, allowMissingColumns=True)
    )
    return written


def _new_item_ids(items: DataFrame, owners: DataFrame) -> DataFrame:
    new = owners.filter("media_item_id IS NULL").select("dir", "base_name")
    return keyed.assign_ids(items, new, ["dir", "base_name"]).withColumnRenamed(
        "id", "media_item_id"
    ).select("dir", "base_name", "media_item_id")


def _describe(primary: DataFrame, metadata: DataFrame | None, hashes: DataFrame | None) -> DataFrame:
    """media_item columns of each group from its primary file."""
    key = ["dir", "name", "extension"]
    rows = primary
    start, info = F.lit(None).cast("string"), F.lit(None).cast("string")
    if metadata is not None:
        built = catalogue.build_item_info(metadata).select(
            *key, F.col("date.date").alias("_date"), F.to_json("info").alias("_info")
        )
        rows = rows.join(built, key, "left")
        start, info = F.col("_date"), F.col("_info")
    phash = F.lit(None).cast("string")
    if hashes is not None:
        rows = rows.join(hashes.select(*key, "phash"), key, "left")
        phash = F.col("phash")
    kind = file_class(F.col("extension"))
    return rows.select(
        F.col("media_item_id").alias("id"),
        F.col("base_name").alias("name"),
        F.when(kind == "video", kind).otherwise("image").alias("type"),
        start.alias("start_date"), start.alias("end_date"), phash.alias("hash"), info.alias("info"),
    )


def remove_orphans(store: TableStore, on_disk: DataFrame) -> dict[str, int]:
    """Deletes files gone from disk, then items, paths and folders left with nothing.

    Child rows go with their parents; returns how many parents of each kind were removed.
    """
    names = ["file", "media_item", "path", "folder"]
    for parent in names:  # grows while it is walked: every table that a removed row can reach
        names += [child for child, _, above, _ in DELETE_RULES if above == parent and child not in names]
    tables = {n: store.read(n) for n in names if store.has(n) or n in ("folder_entry", "media_item_file")}
    gone = catalogue.split_orphans(
        tables["file"], tables["path"], tables["media_item_file"], tables["media_item"], on_disk
    )
    removed = {}
    for table, ids in gone.items():
        kept = cut_lineage(ids)
        removed[table] = kept.count()
        tables = keyed.cascade_delete(tables, table, kept)
    if "folder" in tables:
        empty = cut_lineage(
            catalogue.prune_empty_folders(tables["folder"], tables["folder_entry"]).select("id")
        )
        removed["folder"] = empty.count()
        tables = keyed.cascade_delete(tables, "folder", empty)
    for name, df in tables.items():
        store.write(name, df)
    return removed
