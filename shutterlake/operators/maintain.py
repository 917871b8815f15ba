"""Deduplication of items and clean-up of rows that lost their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.catalogue import prune_empty_folders
from shutterlake.operators.graph import connected_components
from shutterlake.operators.keyed import cascade_delete, new_rows

# --- duplicate signals ------------------------------------------------------------------------

def _star(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """(src, dst): each id of a repeated key linked to the key's lowest id; never all pairs."""
    lowest = (
        rows.groupBy(key)
        .agg(F.min(id_col).alias("src"), F.max(id_col).alias("_high"))
        .filter(F.col("src") < F.col("_high"))
        .select(key, "src")
    )
    return (
        rows.join(lowest, key)
        .filter(F.col(id_col) > F.col("src"))
        .select("src", F.col(id_col).alias("dst"))
        .distinct()
    )


def duplicate_pairs_by_hash(items: DataFrame) -> DataFrame:
    """Links between items with one perceptual hash."""
    hashed = items.filter("hash IS NOT NULL AND hash <> ''").select("id", "hash")
    return _star(hashed, "hash", "id")


def duplicate_pairs_by_checksum(files: DataFrame, links: DataFrame) -> DataFrame:
    """Links between items that hold a file of the same content."""
    content = files.filter("hash IS NOT NULL AND hash <> ''").select(
        F.col("id").alias("file_id"), "hash"
    )
    return _star(content.join(links.select("file_id", "media_item_id"), "file_id"), "hash",
                 "media_item_id")


def duplicate_pairs_by_match(matches: DataFrame) -> DataFrame:
    """Stored matches at distance 0 that are not ignored."""
    return matches.filter(
        ~F.coalesce(F.col("ignore_match"), F.lit(False))
        & (F.col("match_info.hamming_distance") == 0)
    ).select(F.col("media_item_id").alias("src"), F.col("matching_item_id").alias("dst"))


def duplicate_groups(*signals: DataFrame) -> DataFrame:
    """(keeper, item_id): every item of every duplicate group with the group's lowest id.

    Long form on purpose: a group may hold a third of the library.
    """
    edges = signals[0]
    for more in signals[1:]:
        edges = edges.unionByName(more)
    return connected_components(edges).select(
        F.col("component").alias("keeper"), F.col("id").alias("item_id")
    )


def group_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("keeper").agg(F.count("*").alias("members"))


def duplicates_only(groups: DataFrame) -> DataFrame:
    """(item_id, keeper) of the items that go."""
    return groups.filter("item_id <> keeper").select("item_id", "keeper")


# --- merging ----------------------------------------------------------------------------------

def _with_keeper(rows: DataFrame, remap: DataFrame, item_col: str) -> DataFrame:
    keys = remap.select(F.col("item_id").alias(item_col), "keeper")
    return rows.join(keys, item_col, "left")


def _merge_links(rows: DataFrame, remap: DataFrame, item_col: str, other: str,
                 carried: dict[str, str | None]) -> DataFrame:
    """Keeper's links win; the lowest duplicate id supplies carried values of new links."""
    mapped = _with_keeper(rows, remap, item_col)
    stay = mapped.filter("keeper IS NULL").select(*[c for c in rows.columns])
    order = [F.col(item_col)] + ([F.col("id")] if "id" in rows.columns else [])
    values = [
        F.min_by(c, F.struct(*order)).alias(c) if fixed is None else F.expr(fixed).alias(c)
        for c, fixed in carried.items()
    ]
    moved = mapped.filter("keeper IS NOT NULL").groupBy("keeper", other)
    moved = moved.agg(*values) if values else moved.agg(F.lit(1).alias("_one")).drop("_one")
    moved = moved.withColumnRenamed("keeper", item_col)
    return stay.unionByName(new_rows(stay, moved, [item_col, other]), allowMissingColumns=True)


def merge_file_links(links: DataFrame, remap: DataFrame) -> DataFrame:
    """Files of duplicates become non-primary files of the keeper."""
    return _merge_links(links, remap, "media_item_id", "file_id",
                        {"is_primary": "any_value(false)"})


def merge_folder_entries(entries: DataFrame, remap: DataFrame) -> DataFrame:
    return _merge_links(entries, remap, "item_id", "folder_id", {"index": None})


def merge_keywords(tags: DataFrame, remap: DataFrame) -> DataFrame:
    return _merge_links(tags, remap, "media_item_id", "keyword_id", {})


def _merge_rows(rows: DataFrame, remap: DataFrame, item_col: str, per: str) -> DataFrame:
    """One row per (keeper, per): the keeper's own, else that of the lowest duplicate.

    Rows of items outside any group, and all of the keeper's own rows, stay as they are. The
    choice is a ``min_by`` aggregate, so a user or item with very many rows does not sit in one task.
    """
    mapped = _with_keeper(rows, remap, item_col)
    stay = mapped.filter("keeper IS NULL").select(*rows.columns)
    best = (
        mapped.filter("keeper IS NOT NULL")
        .groupBy(F.col("keeper"), F.col(per))
        .agg(F.min_by(F.struct(*rows.columns), F.struct(item_col, "id")).alias("_row"))
        .select(F.col("_row").alias("_row"), F.col("keeper").alias("_keeper"))
        .select(
            *[
                F.col("_keeper").alias(c) if c == item_col else F.col(f"_row.{c}").alias(c)
                for c in rows.columns
            ]
        )
    )
    own = stay.select(item_col, per)
    return stay.unionByName(best.join(own, [item_col, per], "left_anti"))


def merge_ratings(ratings: DataFrame, remap: DataFrame) -> DataFrame:
    return _merge_rows(ratings, remap, "item_id", "user_id")


def merge_places(place_media: DataFrame, remap: DataFrame) -> DataFrame:
    return _merge_rows(place_media, remap, "media_id", "place_id")


def merge_access(access: DataFrame, remap: DataFrame) -> DataFrame:
    return _merge_rows(access, remap, "item_id", "group_id")


def merge_features(features: DataFrame, remap: DataFrame) -> DataFrame:
    """Faces of duplicates now belong to the keeper."""
    return (
        _with_keeper(features, remap, "item_id")
        .withColumn("item_id", F.coalesce("keeper", "item_id"))
        .select(*features.columns)
    )


def deduplicate(tables: dict[str, DataFrame], groups: DataFrame) -> dict[str, DataFrame]:
    """New state of all tables after merging every group into its keeper."""
    remap = duplicates_only(groups)
    merged = dict(tables)
    steps = {
        "media_item_file": merge_file_links,
        "folder_entry": merge_folder_entries,
        "media_item_keyword": merge_keywords,
        "user_rating": merge_ratings,
        "feature": merge_features,
        "place_media": merge_places,
        "media_access": merge_access,
    }
    for name, step in steps.items():
        if name in merged:
            merged[name] = step(merged[name], remap)
    return cascade_delete(merged, "media_item", remap.select(F.col("item_id").alias("id")))


def dedup_report(groups: DataFrame) -> DataFrame:
    """One row: duplicate_groups, merged_items (keepers), removed_items."""
    return groups.agg(
        F.count_if(F.col("item_id") == F.col("keeper")).alias("duplicate_groups"),
        F.count_if(F.col("item_id") == F.col("keeper")).alias("merged_items"),
        F.count_if(F.col("item_id") != F.col("keeper")).alias("removed_items"),
    )


# --- orphans ----------------------------------------------------------------------------------

def duplicate_features(features: DataFrame) -> DataFrame:
    """Ids of faces that repeat an older face of the same item: same coordinates, null = null."""
    rows = features.select("id", "item_id", F.coalesce("coordinates", F.lit("null")).alias("_c"))
    oldest = rows.groupBy("item_id", "_c").agg(F.min("id").alias("_first"))
    return rows.join(oldest, ["item_id", "_c"]).filter("id > _first").select("id")


def dangling_matches(matches: DataFrame, parents: DataFrame, left: str, right: str) -> DataFrame:
    """Ids of match rows one of whose endpoints does not exist."""
    missing = [
        matches.select("id", F.col(end).alias("_end"))
        .join(parents.select(F.col("id").alias("_end")), "_end", "left_anti")
        .select("id")
        for end in (left, right)
    ]
    return missing[0].union(missing[1]).distinct()


def dangling_media_matches(matches: DataFrame, items: DataFrame) -> DataFrame:
    return dangling_matches(matches, items, "media_item_id", "matching_item_id")


def dangling_feature_matches(matches: DataFrame, features: DataFrame) -> DataFrame:
    return dangling_matches(matches, features, "feature_id", "matching_feature_id")


def _without(parents: DataFrame, *children: tuple[DataFrame, str]) -> DataFrame:
    out = parents.select("id")
    for child, column in children:
        out = out.join(child.select(F.col(column).alias("id")), "id", "left_anti")
    return out


def orphan_keywords(keywords: DataFrame, tags: DataFrame) -> DataFrame:
    return _without(keywords, (tags, "keyword_id"))


def orphan_people(people: DataFrame, names: DataFrame, faces: DataFrame,
                  users: DataFrame) -> DataFrame:
    return _without(people, (names, "person_id"), (faces, "person_id"), (users, "person_id"))


def orphan_places(places: DataFrame, names: DataFrame, media: DataFrame,
                  addresses: DataFrame) -> DataFrame:
    return _without(places, (names, "place_id"), (media, "place_id"), (addresses, "place_id"))


def clean_orphans(t: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after clean-up, one count per class), in the fixed order of the clean-up steps.

    Later steps see what earlier ones removed: duplicate faces take their match rows with them.
    """
    out = dict(t)
    counts = []

    def remove(kind: str, table: str, ids: DataFrame) -> None:
        nonlocal out
        counts.append(ids.select(F.lit(kind).alias("kind")))
        out = cascade_delete(out, table, ids)

    remove("duplicate_features", "feature", duplicate_features(out["feature"]))
    remove("media_matches", "media_match",
           dangling_media_matches(out["media_match"], out["media_item"]))
    remove("feature_matches", "feature_match",
           dangling_feature_matches(out["feature_match"], out["feature"]))
    remove("keywords", "keyword", orphan_keywords(out["keyword"], out["media_item_keyword"]))
    remove("persons", "person", orphan_people(
        out["person"], out["person_name"], out["person_feature"], out["user"]))
    remove("places", "place", orphan_places(
        out["place"], out["place_name"], out["place_media"], out["address"]))
    remove("folders", "folder",
           prune_empty_folders(out["folder"], out["folder_entry"]).select("id"))
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    kinds = [
        "duplicate_features", "media_matches", "feature_matches", "keywords", "persons", "places",
        "folders",
    ]
    report = every.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    return out, report
