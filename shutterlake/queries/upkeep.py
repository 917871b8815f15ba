"""Deduplication and orphan clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.operators import maintain
from shutterlake.operators.facegraph import similarity_join
from shutterlake.plans.library import Library
from shutterlake.queries.registry import query
from shutterlake.queries.similarity import PAIRS, _pairs
from shutterlake.schema import table_schema


def _star(rows: str, key: str, item: str) -> str:
    return f"""SELECT DISTINCT s.src, r.{item} AS dst FROM ({rows}) r
        JOIN (SELECT {key}, min({item}) AS src FROM ({rows}) GROUP BY {key}) s USING ({key}) WHERE r.{item} > s.src"""


DUPLICATES = {
    "hash_link": _star("SELECT id, hash FROM media_item WHERE hash IS NOT NULL", "hash", "id"),
    "content_link": _star(
        "SELECT hash, media_item_id FROM file JOIN media_item_file ON file_id = file.id", "hash", "media_item_id"),
    "match_link": """SELECT id AS src, id + doc_chars AS dst FROM (
        SELECT doc_id AS id, n_chars AS doc_chars FROM documents WHERE n_chars <= 50)""",
    "both_ways": """SELECT src AS a, dst AS b FROM (SELECT * FROM hash_link UNION SELECT * FROM content_link UNION SELECT * FROM match_link)
        UNION SELECT dst, src FROM (SELECT * FROM hash_link UNION SELECT * FROM content_link UNION SELECT * FROM match_link)""",
    "reach": "SELECT a AS node, b AS other FROM both_ways UNION SELECT node, b FROM reach JOIN both_ways ON a = other",
    "grouped_item": """SELECT least(node, min(other)) AS keeper, node AS item_id FROM reach GROUP BY node""",
    "remap": "SELECT item_id, keeper FROM grouped_item WHERE item_id <> keeper",
}


def stored_matches(lib: Library):
    """Stored matches: short texts matched exactly with the item as many ids further as they are long."""
    return lib.raw("documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("media_item_id"),
        (F.col("doc_id") + F.col("n_chars")).alias("matching_item_id"),
        F.struct(F.when(F.col("n_chars") <= 50, 0).otherwise(F.col("n_chars") % 9 + 1).alias("hamming_distance")).alias("match_info"),
        F.lit(False).alias("ignore_match"))


def groups(lib: Library):
    return maintain.duplicate_groups(
        maintain.duplicate_pairs_by_hash(lib.media_item),
        maintain.duplicate_pairs_by_checksum(lib.file, lib.media_item_file),
        maintain.duplicate_pairs_by_match(stored_matches(lib)))


def _remap(lib: Library):
    return maintain.duplicates_only(groups(lib))


@query("SELECT src, dst FROM hash_link", DUPLICATES)
def duplicate_pairs_by_hash(lib: Library):
    return maintain.duplicate_pairs_by_hash(lib.media_item)


@query("SELECT src, dst FROM content_link", DUPLICATES)
def duplicate_pairs_by_checksum(lib: Library):
    return maintain.duplicate_pairs_by_checksum(lib.file, lib.media_item_file)


@query("SELECT src, dst FROM match_link", DUPLICATES)
def duplicate_pairs_by_match(lib: Library):
    return maintain.duplicate_pairs_by_match(stored_matches(lib))


@query("SELECT keeper, item_id, count(*) OVER (PARTITION BY keeper) AS members FROM grouped_item", DUPLICATES)
def duplicate_groups(lib: Library):
    found = groups(lib)
    return found.join(maintain.group_sizes(found), "keeper")


@query("""
    SELECT media_item_id, file_id, is_primary FROM media_item_file WHERE media_item_id NOT IN (SELECT item_id FROM remap)
    UNION ALL SELECT DISTINCT r.keeper, l.file_id, false FROM media_item_file l JOIN remap r ON r.item_id = l.media_item_id
      WHERE (r.keeper, l.file_id) NOT IN (SELECT media_item_id, file_id FROM media_item_file)""", DUPLICATES)
def merge_file_links(lib: Library):
    return maintain.merge_file_links(lib.media_item_file, _remap(lib))


@query("""
    SELECT folder_id, item_id, index FROM folder_entry WHERE item_id NOT IN (SELECT item_id FROM remap)
    UNION ALL SELECT e.folder_id, r.keeper, arg_min(e.index, e.item_id) FROM folder_entry e JOIN remap r ON r.item_id = e.item_id
      WHERE (e.folder_id, r.keeper) NOT IN (SELECT folder_id, item_id FROM folder_entry) GROUP BY ALL""", DUPLICATES)
def merge_folder_entries(lib: Library):
    return maintain.merge_folder_entries(lib.folder_entry, _remap(lib)).select("folder_id", "item_id", "index")


@query("""
    SELECT DISTINCT coalesce(r.keeper, l.media_item_id) AS media_item_id, keyword_id
    FROM media_item_keyword l LEFT JOIN remap r ON r.item_id = l.media_item_id""", DUPLICATES)
def merge_keywords(lib: Library):
    return maintain.merge_keywords(lib.media_item_keyword, _remap(lib))


@query("""
    SELECT user_id, item_id, rating FROM rated WHERE item_id NOT IN (SELECT item_id FROM remap)
    UNION ALL SELECT user_id, keeper, rating FROM (
      SELECT t.user_id, r.keeper, t.rating, row_number() OVER (PARTITION BY t.user_id, r.keeper ORDER BY t.item_id, t.id) AS n
      FROM rated t JOIN remap r ON r.item_id = t.item_id
      WHERE (t.user_id, r.keeper) NOT IN (SELECT user_id, item_id FROM rated)) WHERE n = 1""",
       {**DUPLICATES, "rated": """SELECT o_orderkey AS id, o_custkey % 40 AS user_id, o_orderkey % 1000 AS item_id,
          CAST(o_orderkey % 5 + 1 AS INTEGER) AS rating FROM orders"""})
def merge_ratings(lib: Library):
    rated = lib.raw("orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("user_id"),
        (F.col("o_orderkey") % 1000).alias("item_id"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("rating"))
    return maintain.merge_ratings(rated, _remap(lib)).select("user_id", "item_id", "rating")


@query("""SELECT f.id, coalesce(r.keeper, f.item_id) AS item_id FROM feature f LEFT JOIN remap r ON r.item_id = f.item_id""", DUPLICATES)
def merge_features(lib: Library):
    return maintain.merge_features(lib.feature.select("id", "item_id"), _remap(lib))


@query("""
    SELECT media_id, place_id FROM place_media WHERE media_id NOT IN (SELECT item_id FROM remap)
    UNION SELECT r.keeper, m.place_id FROM place_media m JOIN remap r ON r.item_id = m.media_id""", DUPLICATES)
def merge_places(lib: Library):
    return maintain.merge_places(lib.place_media, _remap(lib)).select("media_id", "place_id")


@query("""
    SELECT item_id, group_id, read_only FROM shared WHERE item_id NOT IN (SELECT item_id FROM remap)
    UNION ALL SELECT keeper, group_id, read_only FROM (
      SELECT r.keeper, s.group_id, s.read_only, row_number() OVER (PARTITION BY r.keeper, s.group_id ORDER BY s.item_id, s.id) AS n
      FROM shared s JOIN remap r ON r.item_id = s.item_id
      WHERE (r.keeper, s.group_id) NOT IN (SELECT item_id, group_id FROM shared)) WHERE n = 1""",
       {**DUPLICATES, "shared": """SELECT c_custkey AS id, c_custkey AS item_id, CAST(c_nationkey AS BIGINT) AS group_id,
          c_acctbal < 0 AS read_only FROM customer"""})
def merge_access(lib: Library):
    shared = lib.raw("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("item_id"),
        F.col("c_nationkey").cast("bigint").alias("group_id"), (F.col("c_acctbal") < 0).alias("read_only"))
    return maintain.merge_access(shared, _remap(lib)).select("item_id", "group_id", "read_only")


@query("""
    SELECT 'media_item' AS table_name, count(*) AS left_rows FROM media_item WHERE id NOT IN (SELECT item_id FROM remap)
    UNION ALL SELECT 'feature', count(*) FROM feature
    UNION ALL SELECT 'media_item_keyword', count(*) FROM (SELECT DISTINCT coalesce(r.keeper, l.media_item_id), keyword_id
      FROM media_item_keyword l LEFT JOIN remap r ON r.item_id = l.media_item_id)""", DUPLICATES)
def deduplicate(lib: Library):
    from shutterlake.queries.files import _counts

    tables = {"media_item": lib.media_item, "feature": lib.feature, "media_item_keyword": lib.media_item_keyword}
    return _counts(maintain.deduplicate(tables, groups(lib)))


@query("""SELECT count(DISTINCT keeper) AS duplicate_groups, count(DISTINCT keeper) AS merged_items,
            count(*) FILTER (item_id <> keeper) AS removed_items FROM grouped_item""", DUPLICATES)
def dedup_report(lib: Library):
    return maintain.dedup_report(groups(lib))


@query("""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY item_id, coordinates ORDER BY id) AS n FROM located_face) WHERE n > 1""")
def duplicate_features(lib: Library):
    return maintain.duplicate_features(lib.located_face)


@query("""SELECT doc_id AS id FROM documents WHERE doc_id + n_chars NOT IN (SELECT doc_id FROM documents)""")
def dangling_media_matches(lib: Library):
    return maintain.dangling_media_matches(stored_matches(lib), lib.media_item)


@query("""SELECT feature_id * 1000000 + matching_feature_id AS id FROM face_pair
          WHERE feature_id IN (SELECT id FROM feature WHERE ignored) OR matching_feature_id IN (SELECT id FROM feature WHERE ignored)""",
       _pairs(PAIRS))
def dangling_feature_matches(lib: Library):
    pairs = similarity_join(lib.feature, PAIRS).withColumn(
        "id", F.col("feature_id") * 1_000_000 + F.col("matching_feature_id"))
    return maintain.dangling_feature_matches(pairs, lib.feature.filter("NOT ignored"))


@query("""SELECT id FROM keyword WHERE id NOT IN (SELECT keyword_id FROM media_item_keyword
          WHERE media_item_id IN (SELECT p_partkey FROM part WHERE p_name LIKE '%bolt'))""")
def orphan_keywords(lib: Library):
    bolts = lib.raw("part").filter("p_name LIKE '%bolt'").select(F.col("p_partkey").alias("media_item_id"))
    return maintain.orphan_keywords(lib.keyword, lib.media_item_keyword.join(bolts, "media_item_id", "left_semi"))


@query("""SELECT id FROM person WHERE id NOT IN (SELECT person_id FROM person_name)
          AND id NOT IN (SELECT person_id FROM person_feature)
          AND id NOT IN (SELECT person_id FROM "user" WHERE person_id IS NOT NULL)""")
def orphan_people(lib: Library):
    return maintain.orphan_people(lib.person, lib.person_name, lib.person_feature, lib.user)


@query("""SELECT id FROM place WHERE id NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
          AND id NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9950)
          AND id NOT IN (SELECT place_id FROM address WHERE city < 'city3')""")
def orphan_places(lib: Library):
    region = lib.raw("nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("bigint").alias("place_id"))
    rich = lib.raw("customer").filter("c_acctbal > 9950").select(F.col("c_nationkey").cast("bigint").alias("place_id"))
    return maintain.orphan_places(lib.place, region, rich, lib.address.filter("city < 'city3'"))


@query("""
    SELECT (SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY item_id, coordinates ORDER BY id) AS n FROM located_face) WHERE n > 1) AS duplicate_features,
      (SELECT count(*) FROM documents WHERE doc_id + n_chars NOT IN (SELECT doc_id FROM documents)) AS media_matches,
      0 AS feature_matches,
      (SELECT count(*) FROM keyword WHERE id NOT IN (SELECT keyword_id FROM media_item_keyword)) AS keywords,
      (SELECT count(*) FROM person WHERE id NOT IN (SELECT person_id FROM person_name)
        AND id NOT IN (SELECT person_id FROM person_feature) AND id NOT IN (SELECT person_id FROM "user" WHERE person_id IS NOT NULL)) AS persons,
      (SELECT count(*) FROM place WHERE id NOT IN (SELECT place_id FROM place_name)) AS places,
      (SELECT count(*) FROM folder f WHERE NOT EXISTS (SELECT 1 FROM folder_entry e JOIN folder u ON u.id = e.folder_id
        WHERE u.path = f.path OR starts_with(u.path, f.path || '/'))) AS folders""")
def clean_report(lib: Library):
    no_matches = lib.spark.createDataFrame([], table_schema("feature_match"))
    tables = {
        "feature": lib.located_face, "feature_match": no_matches, "media_match": stored_matches(lib),
        "media_item": lib.media_item, "keyword": lib.keyword, "media_item_keyword": lib.media_item_keyword,
        "person": lib.person, "person_name": lib.person_name,
        "person_feature": lib.person_feature.withColumn("feature_id", F.col("feature_id")),
        "user": lib.user, "place": lib.place, "place_name": lib.place_name, "place_media": lib.place_media,
        "address": lib.address, "folder": lib.folder, "folder_entry": lib.folder_entry,
    }
    _, report = maintain.clean_orphans(tables)
    return report
