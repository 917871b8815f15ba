"""Catalogue tables: columns, unique keys and delete rules.

Fixed values: the table layout is the data contract of the library catalogue.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

DDL: dict[str, str] = {
    "host": "id BIGINT, name STRING, description STRING, metadata STRING",
    "path": "id BIGINT, dir STRING, host_id BIGINT",
    "file": (
        "id BIGINT, name STRING, extension STRING, path_id BIGINT, type STRING, "
        "date STRING, size BIGINT, hash STRING, metadata STRING"
    ),
    "media_item": (
        "id BIGINT, name STRING, description STRING, type STRING, start_date STRING, "
        "end_date STRING, hash STRING, info STRING"
    ),
    "media_item_file": "media_item_id BIGINT, file_id BIGINT, is_primary BOOLEAN",
    "keyword": "id BIGINT, word STRING",
    "media_item_keyword": "media_item_id BIGINT, keyword_id BIGINT",
    "media_match": (
        "id BIGINT, media_item_id BIGINT, matching_item_id BIGINT, "
        "match_info STRUCT<hamming_distance: INT, match_date: STRING>, ignore_match BOOLEAN"
    ),
    "media_access": "id BIGINT, item_id BIGINT, group_id BIGINT, read_only BOOLEAN",
    "media_log": "id BIGINT, item_id BIGINT, user_id BIGINT, date STRING, action STRING",
    "folder": "id BIGINT, name STRING, description STRING, parent_id BIGINT, info STRING",
    "folder_entry": "id BIGINT, folder_id BIGINT, item_id BIGINT, index BIGINT, info STRING",
    "feature": (
        "id BIGINT, item_id BIGINT, coordinates STRING, thumbnail BINARY, label STRING, "
        "info STRING, embedding ARRAY<FLOAT>, ignored BOOLEAN"
    ),
    "face_rejection": "id BIGINT, feature_id BIGINT, person_id BIGINT, created_at STRING",
    "feature_match": (
        "id BIGINT, feature_id BIGINT, matching_feature_id BIGINT, "
        "match_info STRUCT<similarity: DOUBLE, match_date: STRING>, ignore_match BOOLEAN"
    ),
    "person": "id BIGINT, gender STRING, birthday STRING, info STRING",
    "person_name": "id BIGINT, person_id BIGINT, name STRING, preferred BOOLEAN, info STRING",
    "person_address": (
        "id BIGINT, address_id BIGINT, person_id BIGINT, type STRING, preferred BOOLEAN, info STRING"
    ),
    "person_contact": "id BIGINT, person_id BIGINT, contact STRING, type STRING, info STRING",
    "person_feature": "id BIGINT, feature_id BIGINT, person_id BIGINT, info STRING",
    "place": "id BIGINT, info STRING",
    "place_name": "id BIGINT, place_id BIGINT, name STRING, preferred BOOLEAN, info STRING",
    "place_media": "id BIGINT, media_id BIGINT, place_id BIGINT, info STRING",
    "address": (
        "id BIGINT, street STRING, city STRING, state STRING, postal_code STRING, "
        "search_term STRING, place_id BIGINT"
    ),
    "user": "id BIGINT, person_id BIGINT, status STRING",
    "user_access": "id BIGINT, user_id BIGINT, component_id BIGINT, level INT, info STRING",
    "user_authentication": (
        "id BIGINT, user_id BIGINT, service STRING, key STRING, value STRING, info STRING"
    ),
    "user_preference": "id BIGINT, user_id BIGINT, key STRING, value STRING",
    "user_activity": "id BIGINT, user_id BIGINT, hour INT, minute INT, count BIGINT",
    "user_rating": (
        "id BIGINT, user_id BIGINT, item_id BIGINT, date STRING, rating INT, comment STRING"
    ),
    "user_group": "id BIGINT, name STRING, description STRING",
    "user_group_user": "user_group_id BIGINT, user_id BIGINT, is_admin BOOLEAN",
    "component": "id BIGINT, key STRING, label STRING, description STRING, info STRING",
    "setting": "id BIGINT, key STRING, value STRING",
    "datatype": "id BIGINT, label STRING",
    "data": (
        "id BIGINT, name STRING, description STRING, type_id BIGINT, data STRING, date STRING, "
        "thumbnail BINARY"
    ),
    "data_access": "id BIGINT, dataset_id BIGINT, group_id BIGINT, read_only BOOLEAN",
}

UNIQUE_KEYS: dict[str, list[str]] = {
    "path": ["dir", "host_id"],
    "file": ["path_id", "name", "extension"],
    "media_item_file": ["media_item_id", "file_id"],
    "keyword": ["word"],
    "media_item_keyword": ["media_item_id", "keyword_id"],
    "folder": ["name", "parent_id"],
    "folder_entry": ["folder_id", "item_id"],
    "face_rejection": ["feature_id", "person_id"],
    "user_group_user": ["user_group_id", "user_id"],
    "component": ["key"],
    "setting": ["key"],
}

# (child table, child column, parent table, rule); rules: cascade or set_null.
DELETE_RULES: list[tuple[str, str, str, str]] = [
    ("media_item_file", "media_item_id", "media_item", "cascade"),
    ("media_item_file", "file_id", "file", "cascade"),
    ("media_item_keyword", "media_item_id", "media_item", "cascade"),
    ("media_item_keyword", "keyword_id", "keyword", "cascade"),
    ("media_match", "media_item_id", "media_item", "cascade"),
    ("media_match", "matching_item_id", "media_item", "cascade"),
    ("media_access", "item_id", "media_item", "cascade"),
    ("media_access", "group_id", "user_group", "cascade"),
    ("media_log", "item_id", "media_item", "cascade"),
    ("folder_entry", "folder_id", "folder", "cascade"),
    ("folder_entry", "item_id", "media_item", "cascade"),
    ("feature", "item_id", "media_item", "cascade"),
    ("face_rejection", "feature_id", "feature", "cascade"),
    ("face_rejection", "person_id", "person", "cascade"),
    ("feature_match", "feature_id", "feature", "cascade"),
    ("feature_match", "matching_feature_id", "feature", "cascade"),
    ("person_name", "person_id", "person", "cascade"),
    ("person_address", "address_id", "address", "cascade"),
    ("person_address", "person_id", "person", "cascade"),
    ("person_contact", "person_id", "person", "cascade"),
    ("person_feature", "feature_id", "feature", "cascade"),
    ("person_feature", "person_id", "person", "cascade"),
    ("place_name", "place_id", "place", "cascade"),
    ("place_media", "media_id", "media_item", "cascade"),
    ("place_media", "place_id", "place", "cascade"),
    ("user", "person_id", "person", "set_null"),
    ("user_access", "user_id", "user", "cascade"),
    ("user_authentication", "user_id", "user", "cascade"),
    ("user_preference", "user_id", "user", "cascade"),
    ("user_activity", "user_id", "user", "cascade"),
    ("user_rating", "user_id", "user", "cascade"),
    ("user_rating", "item_id", "media_item", "cascade"),
    ("user_group_user", "user_group_id", "user_group", "cascade"),
    ("user_group_user", "user_id", "user", "cascade"),
    ("data_access", "dataset_id", "data", "cascade"),
    ("data_access", "group_id", "user_group", "cascade"),
]

# Tables open to whole-record saves and deletes (link tables without an id, and tables that have
# their own save operators, are not).
MODELS: list[str] = [
    "host", "path", "file", "keyword", "media_match", "media_access", "media_log", "folder",
    "folder_entry", "feature", "feature_match", "person", "person_name", "person_address",
    "person_contact", "person_feature", "place", "place_name", "place_media", "address", "user",
    "user_access", "user_authentication", "user_preference", "user_activity", "user_rating",
    "user_group", "component", "datatype", "data", "data_access",
]


def table_schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])
