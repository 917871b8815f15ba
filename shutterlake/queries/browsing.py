"""Search, folders, details, map, thumbnails, tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.operators import browse
from shutterlake.operators.keyed import page
from shutterlake.plans.library import Library
from shutterlake.queries.registry import query


@query("""
    SELECT id, name, type, start_date FROM media_item
    WHERE name ILIKE '%SRC1%' AND type = 'image' AND start_date >= '2024-02-01' AND start_date <= '2024-09-15'""")
def search_media(lib: Library):
    return browse.search_media(
        lib.media_item, q="SRC1", media_type="image", date_from="2024-02-01", date_to="2024-09-15",
    ).select("id", "name", "type", "start_date")


@query("""SELECT id, start_date FROM media_item WHERE start_date >= '2024-03-01' AND start_date <= '2024-06-15'""")
def date_range(lib: Library):
    return browse.date_range(lib.media_item, "2024-03-01", "2024-06-15").select("id", "start_date")


@query("""
    SELECT id, width, height FROM image_size WHERE id IN (
      SELECT media_item_id FROM media_item_keyword JOIN keyword k ON k.id = keyword_id WHERE k.word = 'bolt')""")
def keyword_semi_join(lib: Library):
    return browse.keyword_semi_join(lib.image_size, lib.keyword, lib.media_item_keyword, "  Bolt ")


@query("""SELECT id, name, start_date, (SELECT count(*) FROM media_item WHERE type = 'video') AS total
          FROM media_item WHERE type = 'video'
          ORDER BY start_date NULLS FIRST, id LIMIT 20 OFFSET 30""")
def page_with_total(lib: Library):
    found = browse.search_media(lib.media_item, media_type="video")
    total = found.agg(F.count("*")).scalar()
    return page(found, ["start_date", "id"], 30, 20).select("id", "name", "start_date", total.alias("total"))


@query("""SELECT k.id, k.word, count(l.keyword_id) AS item_count FROM keyword k
          LEFT JOIN media_item_keyword l ON l.keyword_id = k.id GROUP BY ALL""")
def keyword_counts(lib: Library):
    return browse.keyword_counts(lib.keyword, lib.media_item_keyword)


@query("""SELECT l.keyword_id, m.id, m.name, m.type, m.start_date
          FROM media_item_keyword l JOIN media_item m ON m.id = l.media_item_id""")
def items_for_keyword(lib: Library):
    return browse.items_for_keyword(lib.media_item, lib.media_item_keyword)


@query("""SELECT media_item_id, keyword_id, word, count(*) OVER (PARTITION BY media_item_id) AS total
          FROM media_item_keyword l JOIN keyword k ON k.id = l.keyword_id""")
def keywords_for_item(lib: Library):
    rows = browse.keywords_for_item(lib.keyword, lib.media_item_keyword)
    return browse.with_total(rows, "media_item_id")


@query("""
    SELECT DISTINCT b.media_item_id, b.word, l.media_item_id IS NOT NULL AS already_tagged
    FROM (SELECT p_partkey AS media_item_id, lower(trim(p_brand)) AS word FROM part
          UNION ALL SELECT p_partkey, split_part(p_name, ' ', 1) FROM part) b
    LEFT JOIN keyword k ON k.word = b.word
    LEFT JOIN media_item_keyword l ON l.media_item_id = b.media_item_id AND l.keyword_id = k.id""")
def apply_tags(lib: Library):
    part = lib.raw("part")
    batch = part.select(
        F.col("p_partkey").alias("media_item_id"), F.concat(F.lit(" "), "p_brand").alias("word")
    ).unionByName(part.select(
        F.col("p_partkey").alias("media_item_id"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("word")))
    _, _, outcome = browse.apply_tags(lib.keyword, lib.media_item_keyword, batch)
    return outcome.select("media_item_id", "word", "already_tagged")


@query("""SELECT media_item_id, keyword_id FROM media_item_keyword
          WHERE (media_item_id, keyword_id) NOT IN (
            SELECT p_partkey, k.id FROM part JOIN keyword k ON k.word = split_part(p_name, ' ', 2))""")
def apply_untags(lib: Library):
    words = lib.keyword.select(F.col("id").alias("keyword_id"), "word")
    batch = lib.raw("part").select(
        F.col("p_partkey").alias("media_item_id"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word"))
    return browse.apply_untags(lib.media_item_keyword, batch.join(words, "word"))


@query("""SELECT parent_id, id, name FROM folder""")
def child_folders(lib: Library):
    return browse.child_folders(lib.folder)


@query("""SELECT id, name FROM folder WHERE parent_id IS NULL""")
def root_folders(lib: Library):
    return browse.child_folders(lib.folder, roots=True).select("id", "name")


@query("""SELECT path, id FROM folder WHERE path IN (SELECT dir FROM page_dirs)""")
def resolve_folder_path(lib: Library):
    asked = lib.page_dirs.select(F.concat(F.lit("/"), "dir", F.lit("/")).alias("path")).unionByName(
        lib.page_dirs.select(F.concat("dir", F.lit("/nowhere")).alias("path")))
    return browse.resolve_folder_paths(lib.folder, asked)


@query("""SELECT e.folder_id, e.index, m.id, m.name, m.type, m.start_date
          FROM folder_entry e JOIN media_item m ON m.id = e.item_id""")
def folder_items(lib: Library):
    return browse.folder_items(lib.folder_entry, lib.media_item)


@query("""SELECT a.id AS folder_id, d.id AS descendant_id FROM folder a JOIN folder d
          ON d.path = a.path OR starts_with(d.path, a.path || '/')""")
def descend(lib: Library):
    return browse.descend(lib.folder)


@query("""SELECT DISTINCT a.id AS folder_id, e.item_id FROM folder a JOIN folder d
          ON d.path = a.path OR starts_with(d.path, a.path || '/')
          JOIN folder_entry e ON e.folder_id = d.id""")
def items_below_folder(lib: Library):
    return browse.items_below(lib.folder, lib.folder_entry)


@query("""SELECT id, name, path, len(string_split(path, '/')) AS depth FROM folder""")
def folder_full_path(lib: Library):
    return browse.folder_full_path(lib.folder)


@query("""
    SELECT folder_id, kind, ordinal, label, id, count(*) OVER (PARTITION BY folder_id) AS total FROM (
      SELECT parent_id AS folder_id, 0 AS kind, 0 AS ordinal, name AS label, id FROM folder WHERE parent_id IS NOT NULL
      UNION ALL SELECT e.folder_id, 1, e.index, m.name, m.id FROM folder_entry e JOIN media_item m ON m.id = e.item_id)
    ORDER BY folder_id, kind, ordinal, label, id LIMIT 50 OFFSET 25""")
def browse_page(lib: Library):
    rows = browse.browse_rows(lib.folder, lib.folder_entry, lib.media_item)
    return page(browse.with_total(rows, "folder_id"), browse.BROWSE_ORDER, 25, 50)


@query("""SELECT m.id, m.name, m.type, m.start_date, f.path AS folder_path FROM media_item m
          LEFT JOIN (SELECT item_id, min_by(folder_id, id) AS folder_id FROM folder_entry GROUP BY ALL) e ON e.item_id = m.id
          LEFT JOIN folder f ON f.id = e.folder_id""")
def item_details(lib: Library):
    return browse.item_details(lib.media_item, lib.folder_entry, lib.folder).select(
        "id", "name", "type", "start_date", "folder_path")


@query("""SELECT id, item_id, label, ignored, count(*) OVER (PARTITION BY item_id) AS total FROM feature""")
def features_of_item(lib: Library):
    return browse.with_total(browse.features_of_item(lib.feature), "item_id")


@query("""SELECT event_id AS id, event_type AS name, 'image' AS type,
            CAST(json_extract(props, '$.k') AS DOUBLE) AS latitude, value AS longitude, count(*) OVER () AS total
          FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def gps_items(lib: Library):
    info = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.col("value").alias("v")))
    items = lib.raw("events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.lit("image").alias("type"), info.alias("info"))
    found = browse.gps_items(items, latitude="$.k", longitude="$.v")
    return found.withColumn("total", found.agg(F.count("*")).scalar())


@query("""SELECT event_id AS id, event_type AS name, CAST(json_extract(props, '$.k') AS DOUBLE) AS latitude, value AS longitude,
            (SELECT count(*) FROM events WHERE json_extract(props, '$.k') IS NOT NULL) AS total
          FROM events WHERE json_extract(props, '$.k') IS NOT NULL ORDER BY event_id LIMIT 1000 OFFSET 50""")
def gps_page(lib: Library):
    info = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.col("value").alias("v")))
    items = lib.raw("events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.lit("image").alias("type"), info.alias("info"))
    return browse.gps_page(browse.gps_items(items, latitude="$.k", longitude="$.v"), 50).drop("type")


@query("""
    SELECT cell_x, cell_y, count(*) AS items, round(avg(lat), 6) AS latitude, min(lon) AS west, max(lon) AS east,
      CASE WHEN count(*) >= 100 THEN 'large' WHEN count(*) >= 10 THEN 'medium' ELSE 'small' END AS size_class
    FROM (SELECT lat, lon, CAST(floor((lon + 180) / 360 * 4096 / 50) AS BIGINT) AS cell_x,
        CAST(floor((0.5 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / (2 * pi())) * 4096 / 50) AS BIGINT) AS cell_y
      FROM (SELECT CAST(json_extract(props, '$.k') AS DOUBLE) * 0.8 AS lat, value % 360 - 180 AS lon FROM events))
    GROUP BY ALL""")
def map_clusters(lib: Library):
    points = lib.raw("events").select(
        (F.get_json_object("props", "$.k").cast("double") * 0.8).alias("latitude"),
        (F.col("value") % 360 - 180).alias("longitude"))
    return browse.map_clusters(points, zoom=4).select(
        "cell_x", "cell_y", "items", F.round("latitude", 6).alias("latitude"), "west", "east", "size_class")


@query("""SELECT l.media_item_id, l.file_id, p.dir || '/' || f.name || '.' || f.extension AS path
          FROM media_item_file l JOIN file f ON f.id = l.file_id JOIN path p ON p.id = f.path_id WHERE l.is_primary""")
def primary_file_of_item(lib: Library):
    return browse.primary_file_of_item(lib.media_item_file, lib.file, lib.path)


@query("""SELECT x.dir, x.name, x.extension, l.media_item_id FROM listing x
          JOIN media_item_file l ON l.file_id = x.doc_id AND l.is_primary""")
def item_by_path(lib: Library):
    return browse.items_by_path(lib.listing, lib.media_item_file, lib.file, lib.path)


@query("""
    SELECT i.id, t.w AS tier_width, t.h AS tier_height, t.w <= 300 AS sharpen,
      CASE WHEN t.w <= 300 THEN 100 ELSE 90 END AS quality
    FROM image_size i, (VALUES (1920,1080),(1280,720),(640,480),(300,300),(150,100)) t(w, h)
    WHERE t.w < i.width OR t.h < i.height""")
def thumbnail_plan(lib: Library):
    return browse.thumbnail_plan(lib.image_size)


THUMBS = {
    "thumb": """
        SELECT '/t' || (p_partkey % 40) AS dir, p_brand || '_' || (p_size * 10) AS file_name,
          p_brand AS name, p_size * 10 AS width FROM part""",
}


def _thumb_files(lib: Library):
    return lib.raw("part").select(
        F.concat(F.lit("/t"), (F.col("p_partkey") % 40).cast("string")).alias("dir"),
        F.concat("p_brand", F.lit("_"), (F.col("p_size") * 10).cast("string")).alias("name"),
        F.lit("jpg").alias("extension"))


@query("""SELECT DISTINCT dir, name, width FROM thumb""", THUMBS)
def thumbnail_inventory(lib: Library):
    return browse.thumbnail_inventory(_thumb_files(lib))


@query("""SELECT dir, name, coalesce(min(width) FILTER (width >= 300), max(width)) AS width FROM thumb GROUP BY ALL""", THUMBS)
def best_thumbnail(lib: Library):
    return browse.best_thumbnail(browse.thumbnail_inventory(_thumb_files(lib)), ["dir", "name"], 300)
