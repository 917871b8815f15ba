"""File listing, grouping, catalogue build, table writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from shutterlake.functions.files import file_class, is_media_file, split_path
from shutterlake.operators import catalogue, keyed
from shutterlake.operators.facegraph import similarity_join
from shutterlake.operators.stats import table_counts
from shutterlake.plans.indexing import index_listing
from shutterlake.plans.library import Library
from shutterlake.queries.registry import query
from shutterlake.queries.similarity import PAIRS, _pairs
from shutterlake.session import shared_dir
from shutterlake.sources.media import is_mounted
from shutterlake.sources.media import media_file_scan as media_file_scan_source
from shutterlake.sources.media import media_file_stream
from shutterlake.sources.media import walk_files as walk_files_source
from shutterlake.sources.tables import TableStore, log_rows
from shutterlake.sources.tables import read_table as read_stored
from shutterlake.streaming import flows

PAGE_FILES = {
    "page_file": r"""
        SELECT page_id, regexp_extract(u, '([^/]*)$', 1) AS base,
          regexp_replace(u, '/[^/]*$', '') AS dir
        FROM (SELECT page_id, regexp_replace(url, '^[a-z0-9]+:/+', '/') AS u FROM pages)""",
}


@query("""SELECT doc_id, extension, size FROM listing
          WHERE lower(extension) IN ('jpg','jpeg','jpe','jfif','png','webp','tiff','tif','heic','heif',
            'mov','mts','m4v','mp4','webm','ogg','aae')""")
def media_filter(lib: Library):
    return lib.listing.filter(is_media_file(F.col("extension"))).select("doc_id", "extension", "size")


@query(r"""
    SELECT page_id, dir,
      regexp_replace(base, '^(.+)\.[^.]*$', '\1') AS name,
      CASE WHEN regexp_matches(base, '^.+\.[^.]*$') THEN regexp_extract(base, '\.([^.]*)$', 1) ELSE '' END AS extension,
      CASE WHEN regexp_matches(lower(base), '^.+\.(mov|mts|m4v|mp4|webm|ogg)$') THEN 'video'
           WHEN regexp_matches(lower(base), '^.+\.(jpg|jpeg|jpe|jfif|png|webp|tiff|tif|heic|heif)$') THEN 'image'
           ELSE 'other' END AS type
    FROM page_file""", PAGE_FILES)
def classify_file(lib: Library):
    parts = lib.raw("pages").select("page_id", split_path(F.col("url")).alias("p"))
    return parts.select("page_id", "p.*", file_class(F.col("p.extension")).alias("type"))


@query("""SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1 FROM documents""")
def content_checksum(lib: Library):
    content = F.encode("text", "UTF-8")
    return lib.raw("documents").select("doc_id", F.md5(content).alias("md5"), F.sha1(content).alias("sha1"))


# --- keyed writes ---

@query("""
    SELECT coalesce(n.user_id, a.user_id) AS user_id, coalesce(n.item_id, a.item_id) AS item_id,
      coalesce(n.rating, a.rating) AS rating, coalesce(n.date, a.date) AS date
    FROM (SELECT user_id, item_id, max_by(rating, id) AS rating, max_by(date, id) AS date
          FROM user_rating WHERE rating <= 2 GROUP BY ALL) a
    FULL OUTER JOIN (SELECT user_id, item_id, max_by(rating, id) AS rating, max_by(date, id) AS date
          FROM user_rating WHERE rating > 2 GROUP BY ALL) n
      ON a.user_id = n.user_id AND a.item_id = n.item_id""")
def upsert_update(lib: Library):
    rows = lib.user_rating
    columns = ["user_id", "item_id", "rating", "date"]
    stored = keyed.one_per_key(
        rows.filter("rating <= 2"), ["user_id", "item_id"], ["id"], last=True).select(*columns)
    return keyed.upsert(stored, rows.filter("rating > 2"), ["user_id", "item_id"], order=["id"])


@query("""
    SELECT user_id, item_id, rating FROM (
      SELECT user_id, item_id, min_by(rating, id) AS rating FROM user_rating WHERE rating <= 2 GROUP BY ALL)
    UNION ALL
    SELECT user_id, item_id, min_by(rating, id) AS rating FROM user_rating r WHERE rating > 2
      AND NOT EXISTS (SELECT 1 FROM user_rating a WHERE a.rating <= 2 AND a.user_id = r.user_id
                      AND a.item_id = r.item_id) GROUP BY ALL""")
def upsert_ignore(lib: Library):
    rows = lib.user_rating
    key = ["user_id", "item_id"]
    stored = keyed.one_per_key(rows.filter("rating <= 2"), key, ["id"]).select(*key, "rating")
    fresh = keyed.upsert(stored, rows.filter("rating > 2"), key, mode="ignore", order=["id"])
    return fresh.select(*key, "rating")


@query("""
    SELECT word, CASE WHEN known THEN old_id ELSE (SELECT max(o) FROM (
        SELECT row_number() OVER (ORDER BY word) AS o FROM old_words)) + new_id END AS id
    FROM (SELECT word, known, row_number() OVER (PARTITION BY known ORDER BY word) AS old_id,
        row_number() OVER (PARTITION BY known ORDER BY substr(md5(word), 1, 3), word) AS new_id
      FROM (SELECT DISTINCT word, word IN (SELECT word FROM old_words) AS known FROM part_words))""",
       {"old_words": "SELECT DISTINCT word FROM part_words WHERE word < 'm'"})
def find_or_create(lib: Library):
    words = lib.part_words.select("word").distinct()
    old = words.filter("word < 'm'")
    # fewer than 4096 words start before 'm', and their order is their id
    known = old.withColumn("id", F.row_number().over(_by_word()).cast("bigint")).select("id", "word")
    return keyed.find_or_create(known, lib.part_words, ["word"]).select("word", "id")


def _by_word():
    return Window.orderBy("word")


@query("""
    SELECT table_name, count(*) AS left_rows FROM (
      SELECT 'feature' AS table_name FROM feature WHERE item_id NOT IN (SELECT * FROM doomed)
      UNION ALL SELECT 'person_feature' FROM person_feature WHERE feature_id // 2 NOT IN (SELECT * FROM doomed)
      UNION ALL SELECT 'face_rejection' FROM face_rejection WHERE feature_id // 2 NOT IN (SELECT * FROM doomed)
      UNION ALL SELECT 'media_item_file' FROM media_item_file WHERE media_item_id NOT IN (SELECT * FROM doomed)
      UNION ALL SELECT 'media_item' FROM media_item WHERE id NOT IN (SELECT * FROM doomed))
    GROUP BY table_name""",
       {"doomed": "SELECT id FROM media_item WHERE type = 'video'"})
def cascade_delete(lib: Library):
    tables = {
        "media_item": lib.media_item, "feature": lib.feature, "person_feature": lib.person_feature,
        "face_rejection": lib.face_rejection, "media_item_file": lib.media_item_file,
    }
    gone = lib.media_item.filter("type = 'video'").select("id")
    return _counts(keyed.cascade_delete(tables, "media_item", gone))


def _counts(tables):
    return table_counts(tables).select(
        F.col("what").alias("table_name"), F.col("rows").alias("left_rows"))


@query("""SELECT id, person_id FROM (SELECT id, CASE WHEN c_acctbal < 3000 THEN NULL ELSE person_id END AS person_id
          FROM "user" JOIN customer ON c_custkey = id)""")
def cascade_set_null(lib: Library):
    gone = lib.raw("customer").filter("c_acctbal < 3000").select(F.col("c_custkey").alias("id"))
    return keyed.cascade_delete({"person": lib.person, "user": lib.user}, "person", gone)["user"]


@query("""
    SELECT id, street, city, place_id FROM address WHERE city <> 'city3'
    UNION ALL SELECT id, street, 'moved' AS city, place_id FROM address WHERE city = 'city3'
    UNION ALL SELECT (SELECT max(id) FROM address)
        + row_number() OVER (ORDER BY substr(md5(k), 1, 3), street, city, place_id), street, city, place_id
      FROM (SELECT *, concat_ws(chr(31), street, city, place_id) AS k
            FROM (SELECT 'new ' || n_name AS street, 'x' AS city, CAST(n_nationkey AS BIGINT) AS place_id FROM nation))""")
def apply_changes(lib: Library):
    edits = lib.address.filter("city = 'city3'").select(
        "id", F.lit(None).cast("string").alias("street"), F.lit("moved").alias("city"),
        F.lit(None).cast("bigint").alias("place_id"))
    adds = lib.raw("nation").select(
        F.lit(None).cast("bigint").alias("id"), F.concat(F.lit("new "), "n_name").alias("street"),
        F.lit("x").alias("city"), F.col("n_nationkey").cast("bigint").alias("place_id"))
    return keyed.apply_changes(lib.address, edits.unionByName(adds))


@query("""SELECT DISTINCT o_custkey + 100 AS id FROM orders
          WHERE o_custkey + 100 NOT IN (SELECT c_custkey FROM customer)""")
def unknown_change_ids(lib: Library):
    changes = lib.raw("orders").select((F.col("o_custkey") + 100).alias("id"))
    return keyed.unknown_ids(lib.person, changes)


@query("""
    SELECT table_name, count(*) AS left_rows FROM (
      SELECT 'person' AS table_name FROM person WHERE id NOT IN (SELECT * FROM left_people)
      UNION ALL SELECT 'person_name' FROM person_name WHERE person_id NOT IN (SELECT * FROM left_people)
      UNION ALL SELECT 'person_contact' FROM person_contact WHERE person_id NOT IN (SELECT * FROM left_people)
      UNION ALL SELECT 'person_feature' FROM person_feature WHERE person_id NOT IN (SELECT * FROM left_people)
      UNION ALL SELECT 'user' FROM "user") GROUP BY table_name""",
       {"left_people": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'"})
def apply_deletes(lib: Library):
    tables = {
        "person": lib.person, "person_name": lib.person_name, "person_contact": lib.person_contact,
        "person_feature": lib.person_feature, "user": lib.user,
    }
    gone = lib.raw("customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("id"))
    return _counts(keyed.cascade_delete(tables, "person", gone))


# --- catalogue build ---

@query("""
    SELECT dir, host_id, CASE WHEN known THEN id ELSE (SELECT max(id) FROM path) + new_id END AS id
    FROM (SELECT l.dir, 1 AS host_id, p.id, p.id IS NOT NULL AS known,
        row_number() OVER (PARTITION BY p.id IS NOT NULL
          ORDER BY substr(md5(concat_ws(chr(31), l.dir, 1)), 1, 3), l.dir) AS new_id
      FROM (SELECT dir FROM listing UNION SELECT '/lib/' || dir FROM page_dirs) l
      LEFT JOIN path p USING (dir))""")
def register_paths(lib: Library):
    seen = lib.listing.select("dir").unionByName(
        lib.page_dirs.select(F.concat(F.lit("/lib/"), "dir").alias("dir")))
    return catalogue.register_paths(lib.path, seen)


@query("""
    SELECT path_id, name, extension, type, size + CASE WHEN extension = 'heic' THEN 1 ELSE 0 END AS size,
      CASE WHEN extension = 'heic' THEN md5('changed' || hash) ELSE hash END AS hash, extension = 'mov' AS is_new
    FROM file""")
def register_files(lib: Library):
    known = lib.file.filter("extension <> 'mov'")
    changed = F.col("extension") == "heic"
    scan = lib.listing.select(
        "dir", "name", "extension",
        F.when(changed, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(changed, F.md5(F.concat(F.lit("changed"), "hash"))).otherwise(F.col("hash")).alias("hash"),
    )
    done = catalogue.register_files(known, scan, lib.path)
    old = known.select("id", F.lit(True).alias("old"))
    return done.join(old, "id", "left").select(
        "path_id", "name", "extension", "type", "size", "hash", F.col("old").isNull().alias("is_new"))


GROUPS = {
    "grouped": r"""
        SELECT *, regexp_replace(name, '^IMG_E(\d+)$', 'IMG_\1') AS base_name,
          CASE WHEN extension = 'aae' OR (extension = 'mov' AND size < 5242880) THEN 3
               WHEN extension = 'heic' THEN 0 WHEN extension = 'mov' THEN 1 ELSE 2 END AS rank
        FROM listing""",
}


@query("""SELECT dir, base_name, count(*) AS files FROM grouped GROUP BY ALL""", GROUPS)
def group_files(lib: Library):
    return catalogue.group_files(lib.listing).groupBy("dir", "base_name").agg(
        F.count("*").alias("files"))


@query("""
    SELECT doc_id, base_name, row_number() OVER (PARTITION BY dir, base_name
      ORDER BY rank, name || '.' || extension) = 1 AS is_primary FROM grouped""", GROUPS)
def pick_primary(lib: Library):
    return catalogue.pick_primary(lib.listing).select("doc_id", "base_name", "is_primary")


@query("""
    SELECT g.dir, g.base_name, min(l.media_item_id) AS media_item_id
    FROM grouped g LEFT JOIN media_item_file l ON l.file_id = g.doc_id GROUP BY ALL""", GROUPS)
def split_new_existing(lib: Library):
    grouped = catalogue.group_files(lib.listing).withColumnRenamed("doc_id", "file_id")
    return catalogue.split_new_existing(grouped, lib.media_item_file)


@query("""
    SELECT l.media_item_id, l.file_id, l.is_primary FROM media_item_file l JOIN file f ON f.id = l.file_id
      WHERE f.type = 'image'
    UNION ALL
    SELECT * EXCLUDE (extension) FROM (SELECT doc_id - doc_id % 4, doc_id, row_number() OVER (PARTITION BY dir, base_name
      ORDER BY rank, name || '.' || extension) = 1, extension FROM grouped) WHERE extension IN ('mov', 'aae')""", GROUPS)
def link_item_files(lib: Library):
    grouped = catalogue.pick_primary(lib.listing).select(
        (F.col("doc_id") - F.col("doc_id") % 4).alias("media_item_id"),
        F.col("doc_id").alias("file_id"), "is_primary")
    images = lib.file.filter("type = 'image'").select(F.col("id").alias("file_id"))
    known = lib.media_item_file.join(images, "file_id", "left_semi")
    return catalogue.link_item_files(known, grouped)


@query("""SELECT id, name, parent_id, path FROM folder""")
def build_folder_tree(lib: Library):
    return catalogue.build_folder_tree(lib.page_dirs)


@query("""
    SELECT f.id AS folder_id, g.first_id AS item_id,
      row_number() OVER (ORDER BY g.dir, g.base_name) - 1 AS index
    FROM (SELECT dir, base_name, min(doc_id) AS first_id FROM grouped GROUP BY ALL) g
    JOIN doc_folder f ON f.path = ltrim(g.dir, '/')""",
       {**GROUPS, "doc_folder": """SELECT path, row_number() OVER (ORDER BY substr(md5(path), 1, 3), path) AS id
          FROM (SELECT DISTINCT ltrim(dir, '/') AS path FROM listing
                UNION SELECT DISTINCT 'lib/' || split_part(dir, '/', 3) FROM listing UNION SELECT 'lib')"""})
def build_folder_entries(lib: Library):
    groups = catalogue.group_files(lib.listing).groupBy("dir", "base_name").agg(
        F.min("doc_id").alias("item_id"))
    folders = catalogue.build_folder_tree(lib.listing).select(
        F.col("id").alias("folder_id"), F.concat(F.lit("/"), "path").alias("dir"))
    empty = lib.folder_entry.limit(0).select("folder_id", "item_id", "index")
    return catalogue.build_folder_entries(empty, groups.join(folders, "dir"))


@query("""
    SELECT f.id AS file_id, p.dir || '/' || f.name || '.' || f.extension AS path
    FROM file f JOIN path p ON p.id = f.path_id WHERE f.extension = 'aae'""")
def orphan_files(lib: Library):
    on_disk = catalogue.catalogue_paths(lib.file, lib.path).filter("path NOT LIKE '%.aae'")
    return catalogue.orphan_files(lib.file, lib.path, on_disk)


@query("""SELECT id FROM media_item WHERE id NOT IN (SELECT media_item_id FROM media_item_file)""")
def items_without_files(lib: Library):
    return catalogue.items_without_files(lib.media_item, lib.media_item_file)


@query("""SELECT id, dir FROM path WHERE id NOT IN (SELECT path_id FROM file WHERE size > 20000000)""")
def paths_without_files(lib: Library):
    return catalogue.paths_without_files(lib.path, lib.file.filter("size > 20000000"))


@query("""
    SELECT id, name, path FROM folder f WHERE NOT EXISTS (
      SELECT 1 FROM folder_entry e JOIN folder u ON u.id = e.folder_id
      WHERE e.id IN (SELECT page_id FROM pages WHERE url LIKE 'https%?%') AND (u.path = f.path OR starts_with(u.path, f.path || '/')))""")
def prune_empty_folders(lib: Library):
    kept = lib.raw("pages").filter("url LIKE 'https%?%'").select(F.col("page_id").alias("id"))
    return catalogue.prune_empty_folders(lib.folder, lib.folder_entry.join(kept, "id", "left_semi"))


@query("""
    SELECT 'files' AS what, count(*) AS rows FROM file
    UNION ALL SELECT 'items', count(*) FROM media_item
    UNION ALL SELECT 'faces', count(*) FROM feature
    UNION ALL SELECT 'face matches', count(*) FROM face_pair""", _pairs(PAIRS))
def index_summary(lib: Library):
    return catalogue.index_summary(**{
        "files": lib.file, "items": lib.media_item, "faces": lib.feature,
        "face matches": similarity_join(lib.feature, PAIRS)})


# --- files and tables on storage ---

MEDIA_BYTES = """
    SELECT 'lang=' || lang || '/source=' || source AS dir,
      CAST(sum(len(CAST(doc_id AS VARCHAR)) + len(CAST(n_chars AS VARCHAR)) + 2) AS BIGINT) AS size, 'image' AS type
    FROM documents GROUP BY ALL"""


def _media_tree(lib: Library) -> str:
    """A folder tree of .jpg files holding the numbers of all documents, by language and source."""
    root = f"{shared_dir(lib.spark).rstrip('/')}/media-{uuid.uuid4().hex}"
    lib.raw("documents").select("lang", "source", "doc_id", "n_chars").write.partitionBy(
        "lang", "source").option("extension", "jpg").csv(root)
    return root


def _relative(column: str):
    return F.regexp_extract(column, "(lang=.*)$", 1)


@query(MEDIA_BYTES)
def media_file_scan(lib: Library):
    listed = media_file_scan_source(lib.spark, _media_tree(lib), media_only=True, checksum="md5")
    return listed.groupBy(_relative("dir").alias("dir"), "type").agg(F.sum("size").alias("size"))


@query(MEDIA_BYTES)
def walk_files(lib: Library):
    """The same tree, walked by the tasks."""
    listed = walk_files_source(lib.spark, _media_tree(lib), media_only=True)
    return listed.groupBy(_relative("dir").alias("dir"), "type").agg(F.sum("size").alias("size"))


@query(MEDIA_BYTES)
def incremental_ingest(lib: Library):
    """The same tree taken in by a file stream in several batches, each indexed into versioned tables."""
    root = _media_tree(lib)
    store = TableStore(lib.spark, f"{root}-tables")
    flows.stream_ingest(
        media_file_stream(lib.spark, root, files_per_batch=40),
        lambda batch, _: index_listing(store, batch, root), f"{root}-checkpoint", once=True,
        mounted=is_mounted(lib.spark, root),
    ).awaitTermination()
    paths = store.read("path").select(F.col("id").alias("path_id"), "dir")
    return store.read("file").join(paths, "path_id").groupBy(
        _relative("dir").alias("dir"), "type").agg(F.sum("size").alias("size"))


@query("SELECT id, name, type, start_date, hash FROM media_item")
def read_table(lib: Library):
    store = TableStore(lib.spark, f"{shared_dir(lib.spark).rstrip('/')}/tables-{uuid.uuid4().hex}")
    store.write("media_item", lib.media_item.filter("type = 'video'"))
    store.write("media_item", lib.media_item)
    return read_stored(lib.spark, store.root, "media_item").select("id", "name", "type", "start_date", "hash")


@query("SELECT id AS item_id, CASE WHEN action = 'delete' THEN user_id ELSE 1 END AS user_id, action FROM change WHERE action <> 'progress'")
def append_log(lib: Library):
    store = TableStore(lib.spark, f"{shared_dir(lib.spark).rstrip('/')}/log-{uuid.uuid4().hex}")
    changes = lib.change.withColumnRenamed("id", "item_id")
    store.append_log(log_rows(changes.filter("action IN ('create', 'update')").drop("user_id")))
    store.append_log(log_rows(changes.filter("action = 'delete'")))
    return read_stored(lib.spark, store.root, "media_log").select("item_id", "user_id", "action")
