"""Search, folders, item details, map, thumbnails, tagging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.files import full_path
from shutterlake.functions.geo import pixel_x, pixel_y
from shutterlake.functions.scalars import contains_ignore_case, normal_word
from shutterlake.operators.graph import folder_chains
from shutterlake.operators.keyed import find_or_create, page

# Bounding boxes of the thumbnail tiers, largest first.
THUMBNAIL_TIERS = [(1920, 1080), (1280, 720), (640, 480), (300, 300), (150, 100)]
SMALL_TIER = 300
CLUSTER_PIXELS = 50


# --- search and keywords ----------------------------------------------------------------------

def search_media(items: DataFrame, q: str | None = None, keyword: str | None = None,
                 media_type: str | None = None, date_from: str | None = None,
                 date_to: str | None = None, keywords: DataFrame | None = None,
                 tags: DataFrame | None = None) -> DataFrame:
    """Items that satisfy every given predicate; all are plain columns, so they reach the scan."""
    found = items
    if q:
        found = found.filter(contains_ignore_case(F.col("name"), q))
    if media_type:
        found = found.filter(F.col("type") == media_type)
    found = date_range(found, date_from, date_to)
    if keyword:
        found = keyword_semi_join(found, keywords, tags, keyword)
    return found


def date_range(items: DataFrame, date_from: str | None, date_to: str | None) -> DataFrame:
    """Inclusive comparison of date texts: a bare day as upper bound leaves out later times."""
    if date_from:
        items = items.filter(F.col("start_date") >= date_from)
    if date_to:
        items = items.filter(F.col("start_date") <= date_to)
    return items


def keyword_semi_join(items: DataFrame, keywords: DataFrame, tags: DataFrame,
                      word: str) -> DataFrame:
    """Items tagged with the word; none for an unknown word."""
    wanted = keywords.filter(F.col("word") == normal_word(F.lit(word))).select(
        F.col("id").alias("keyword_id")
    )
    tagged = tags.join(wanted, "keyword_id", "left_semi").select(F.col("media_item_id").alias("id"))
    return items.join(tagged, "id", "left_semi")


def keyword_counts(keywords: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, word, item_count), zero included. Links are counted before they meet the words."""
    counts = tags.groupBy("keyword_id").agg(F.count("*").alias("item_count"))
    return keywords.join(counts, F.col("id") == F.col("keyword_id"), "left").select(
        "id", "word", F.coalesce("item_count", F.lit(0)).alias("item_count")
    )


def items_for_keyword(items: DataFrame, tags: DataFrame,
                      keyword_ids: DataFrame | None = None) -> DataFrame:
    """(keyword_id, id, name, type, start_date); order pages by start_date, id."""
    wanted = tags if keyword_ids is None else tags.join(
        keyword_ids.select(F.col("id").alias("keyword_id")), "keyword_id", "left_semi"
    )
    return items.select("id", "name", "type", "start_date").join(
        wanted.select(F.col("media_item_id").alias("id"), "keyword_id"), "id"
    )


def keywords_for_item(keywords: DataFrame, tags: DataFrame,
                      items: DataFrame | None = None) -> DataFrame:
    """(media_item_id, keyword_id, word)."""
    wanted = tags if items is None else tags.join(
        items.select(F.col("id").alias("media_item_id")), "media_item_id", "left_semi"
    )
    return wanted.join(keywords.select(F.col("id").alias("keyword_id"), "word"), "keyword_id")


def with_total(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``total``: rows per key. Counts combine before the shuffle."""
    totals = rows.groupBy(key).agg(F.count("*").alias("total"))
    return rows.join(totals, key)


def apply_tags(keywords: DataFrame, tags: DataFrame,
               batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tags items with words: (keywords, links, outcome).

    ``batch(media_item_id, word)``; words are trimmed and lower-cased, unseen ones are created,
    links are idempotent. The outcome has already_tagged per (item, word).
    """
    clean = (
        batch.select("media_item_id", normal_word(F.col("word")).alias("word"))
        .filter(F.length("word") > 0)
        .distinct()
    )
    words = find_or_create(keywords, clean, ["word"])
    wanted = clean.join(words.select(F.col("id").alias("keyword_id"), "word"), "word")
    known = tags.select("media_item_id", "keyword_id").withColumn("_known", F.lit(True))
    outcome = wanted.join(known, ["media_item_id", "keyword_id"], "left").select(
        "media_item_id", "keyword_id", "word",
        F.coalesce("_known", F.lit(False)).alias("already_tagged"),
    )
    fresh = outcome.filter(~F.col("already_tagged")).select("media_item_id", "keyword_id")
    return words, tags.select("media_item_id", "keyword_id").unionByName(fresh), outcome


def apply_untags(tags: DataFrame, batch: DataFrame) -> DataFrame:
    """Removes links (media_item_id, keyword_id); keywords stay."""
    keys = ["media_item_id", "keyword_id"]
    return tags.join(batch.select(*keys), keys, "left_anti")


# --- folders ----------------------------------------------------------------------------------

def child_folders(folders: DataFrame, parents: DataFrame | None = None,
                  roots: bool = False) -> DataFrame:
    """(parent_id, id, name): children of the given parents, of all, or the roots."""
    rows = folders.select("parent_id", "id", "name")
    if roots:
        return rows.filter("parent_id IS NULL")
    if parents is None:
        return rows
    return rows.join(parents.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")


def resolve_folder_paths(folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, id) of the wanted path texts; missing ones are absent."""
    clean = wanted.select(F.regexp_replace("path", "^/+|/+$", "").alias("path")).distinct()
    return folder_chains(folders).select("path", "id").join(clean, "path", "left_semi")


def folder_items(entries: DataFrame, items: DataFrame,
                 folders: DataFrame | None = None) -> DataFrame:
    """(folder_id, index, id, name, type, start_date)."""
    rows = entries if folders is None else entries.join(
        folders.select(F.col("id").alias("folder_id")), "folder_id", "left_semi"
    )
    return rows.select("folder_id", F.col("item_id").alias("id"), "index").join(
        items.select("id", "name", "type", "start_date"), "id"
    )


def descend(folders: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(folder_id, descendant_id): each folder with itself and everything below it."""
    pairs = folder_chains(folders).select(
        F.explode("chain").alias("folder_id"), F.col("id").alias("descendant_id")
    )
    if start is None:
        return pairs
    return pairs.join(start.select(F.col("id").alias("folder_id")), "folder_id", "left_semi")


def items_below(folders: DataFrame, entries: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(folder_id, item_id): each item once per folder it lies under."""
    where = entries.select(F.col("folder_id").alias("descendant_id"), "item_id")
    return descend(folders, start).join(where, "descendant_id").select(
        "folder_id", "item_id"
    ).distinct()


def folder_full_path(folders: DataFrame) -> DataFrame:
    return folder_chains(folders).select("id", "name", "path", "depth")


def browse_rows(folders: DataFrame, entries: DataFrame, items: DataFrame) -> DataFrame:
    """Listing rows of every folder: sub-folders (kind 0) by name, then items (kind 1) by index.

    (folder_id, kind, ordinal, label, id); page by folder_id, kind, ordinal, label, id.
    """
    subs = folders.filter("parent_id IS NOT NULL").select(
        F.col("parent_id").alias("folder_id"), F.lit(0).alias("kind"),
        F.lit(0).cast("bigint").alias("ordinal"), F.col("name").alias("label"), "id",
    )
    media = folder_items(entries, items).select(
        "folder_id", F.lit(1).alias("kind"), F.col("index").cast("bigint").alias("ordinal"),
        F.col("name").alias("label"), "id",
    )
    return subs.unionByName(media)


BROWSE_ORDER = ["folder_id", "kind", "ordinal", "label", "id"]


def item_details(items: DataFrame, entries: DataFrame, folders: DataFrame) -> DataFrame:
    """Item projection with the path of its first folder entry."""
    first = entries.groupBy("item_id").agg(F.min_by("folder_id", "id").alias("folder_id"))
    paths = folder_chains(folders).select(F.col("id").alias("folder_id"), F.col("path").alias("folder_path"))
    placed = first.join(paths, "folder_id", "left").select(
        F.col("item_id").alias("id"), "folder_id", "folder_path"
    )
    return items.join(placed, "id", "left")


def features_of_item(features: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Face rows without the binary thumbnail."""
    rows = features.select(*[c for c in features.columns if c not in ("thumbnail", "embedding")])
    if items is None:
        return rows
    return rows.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi")


# --- files and thumbnails ---------------------------------------------------------------------

def primary_file_of_item(links: DataFrame, files: DataFrame, paths: DataFrame) -> DataFrame:
    """(media_item_id, file_id, path)."""
    located = files.select("id", "name", "extension", "path_id").join(
        paths.select(F.col("id").alias("path_id"), "dir"), "path_id"
    )
    primary = links.filter("is_primary").select("media_item_id", F.col("file_id").alias("id"))
    return primary.join(located, "id").select(
        "media_item_id", F.col("id").alias("file_id"),
        full_path(F.col("dir"), F.col("name"), F.col("extension")).alias("path"),
    )


def items_by_path(wanted: DataFrame, links: DataFrame, files: DataFrame,
                  paths: DataFrame) -> DataFrame:
    """(dir, name, extension, media_item_id): items by exact location of their primary file.

    An empty extension matches files stored with '' or null.
    """
    located = files.select(
        F.col("id").alias("file_id"), "name", F.coalesce("extension", F.lit("")).alias("extension"),
        "path_id",
    ).join(paths.select(F.col("id").alias("path_id"), "dir"), "path_id")
    asked = wanted.select("dir", "name", F.coalesce("extension", F.lit("")).alias("extension"))
    primary = links.filter("is_primary").select("media_item_id", "file_id")
    return (
        asked.distinct().join(located, ["dir", "name", "extension"])
        .join(primary, "file_id")
        .select("dir", "name", "extension", "media_item_id")
    )


def thumbnail_plan(images: DataFrame) -> DataFrame:
    """(id, tier_width, tier_height, sharpen, quality) of the tiers smaller than the source.

    The five tiers are an array literal, so this is one map-side explode.
    """
    tiers = F.array(
        *[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in THUMBNAIL_TIERS]
    )
    small = F.col("t.w") <= SMALL_TIER
    return (
        images.withColumn("t", F.explode(tiers))
        .filter((F.col("t.w") < F.col("width")) | (F.col("t.h") < F.col("height")))
        .select(
            "id", F.col("t.w").alias("tier_width"), F.col("t.h").alias("tier_height"),
            small.alias("sharpen"), F.when(small, 100).otherwise(90).alias("quality"),
        )
    )


def thumbnail_inventory(listing: DataFrame) -> DataFrame:
    """(dir, name, width) from thumbnail files called ``{name}_{width}.jpg``."""
    return (
        listing.filter(F.col("extension") == "jpg")
        .select(
            "dir",
            F.regexp_extract("name", r"^(.*)_(\d+)$", 1).alias("name"),
            F.regexp_extract("name", r"^(.*)_(\d+)$", 2).try_cast("int").alias("width"),
        )
        .filter("width > 0")
        .distinct()
    )


def best_thumbnail(inventory: DataFrame, keys: list[str], wanted_width: int) -> DataFrame:
    """(keys, width): the smallest width that is large enough, else the largest there is."""
    enough = F.min(F.when(F.col("width") >= wanted_width, F.col("width")))
    return inventory.groupBy(*keys).agg(F.coalesce(enough, F.max("width")).alias("width"))


# --- map --------------------------------------------------------------------------------------

def gps_items(items: DataFrame, info: str = "info", latitude: str = "$.gps.latitude",
              longitude: str = "$.gps.longitude") -> DataFrame:
    """(id, name, type, latitude, longitude) of items whose info has a latitude."""
    return items.select(
        "id", "name", "type",
        F.get_json_object(info, latitude).try_cast("double").alias("latitude"),
        F.get_json_object(info, longitude).try_cast("double").alias("longitude"),
    ).filter("latitude IS NOT NULL")


def gps_page(found: DataFrame, offset: int = 0, limit: int = 1000) -> DataFrame:
    """One page of ``gps_items`` by id, with the number of all of them as ``total``."""
    total = found.agg(F.count("*")).scalar()
    return page(found, ["id"], offset, limit).withColumn("total", total)


def map_clusters(points: DataFrame, zoom: int, cell_pixels: int = CLUSTER_PIXELS) -> DataFrame:
    """Markers per screen cell: count, mean position, bounds and size class."""
    cells = points.withColumns({
        "cell_x": F.floor(pixel_x(F.col("longitude"), zoom) / cell_pixels),
        "cell_y": F.floor(pixel_y(F.col("latitude"), zoom) / cell_pixels),
    })
    grouped = cells.groupBy("cell_x", "cell_y").agg(
        F.count("*").alias("items"),
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"),
        F.min("latitude").alias("south"), F.max("latitude").alias("north"),
        F.min("longitude").alias("west"), F.max("longitude").alias("east"),
    )
    size = F.when(F.col("items") >= 100, "large").when(F.col("items") >= 10, "medium")
    return grouped.withColumn("size_class", size.otherwise("small"))
