"""Deduplication over a table store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shutterlake.operators import maintain
from shutterlake.session import cut_lineage
from shutterlake.sources.tables import TableStore

TABLES = [
    "media_item", "media_item_file", "file", "media_match", "folder_entry", "media_item_keyword",
    "user_rating", "feature", "person_feature", "face_rejection", "feature_match", "place_media",
    "media_access", "media_log",
]


def deduplicate_store(store: TableStore) -> DataFrame:
    """Finds duplicate items by all three signals, merges them, writes new versions.

    Returns the one-row report.
    """
    tables = {n: store.read(n) for n in TABLES}
    groups = cut_lineage(
        maintain.duplicate_groups(
            maintain.duplicate_pairs_by_hash(tables["media_item"]),
            maintain.duplicate_pairs_by_checksum(tables["file"], tables["media_item_file"]),
            maintain.duplicate_pairs_by_match(tables["media_match"]),
        )
    )
    merged = maintain.deduplicate(tables, groups)
    for name, df in merged.items():
        if store.version(name):
            store.write(name, df)
    return maintain.dedup_report(groups)
