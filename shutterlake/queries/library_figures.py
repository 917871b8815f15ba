"""Statistics and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions.scalars import iso_timestamp
from shutterlake.operators import stats
from shutterlake.plans.library import Library
from shutterlake.queries.registry import query
from shutterlake.queries.upkeep import stored_matches
from shutterlake.sources.tables import log_rows


@query("""
    SELECT 'paths' AS what, count(*) AS rows FROM path UNION ALL SELECT 'files', count(*) FROM file
    UNION ALL SELECT 'media_items', count(*) FROM media_item UNION ALL SELECT 'images', count(*) FROM media_item WHERE type = 'image'
    UNION ALL SELECT 'videos', count(*) FROM media_item WHERE type = 'video' UNION ALL SELECT 'features', count(*) FROM feature
    UNION ALL SELECT 'matches', count(*) FROM documents UNION ALL SELECT 'people', count(*) FROM person
    UNION ALL SELECT 'places', count(*) FROM place UNION ALL SELECT 'keywords', count(*) FROM keyword
    UNION ALL SELECT 'users', count(*) FROM "user" UNION ALL SELECT 'face_rejections', count(*) FROM face_rejection""")
def library_stats(lib: Library):
    return stats.library_stats({
        "path": lib.path, "file": lib.file, "media_item": lib.media_item, "feature": lib.feature,
        "media_match": stored_matches(lib), "person": lib.person, "place": lib.place, "keyword": lib.keyword,
        "user": lib.user, "face_rejection": lib.face_rejection})


@query("""SELECT p.id, p.dir, count(f.id) AS file_count FROM path p LEFT JOIN file f ON f.path_id = p.id GROUP BY ALL""")
def path_file_counts(lib: Library):
    return stats.path_file_counts(lib.path, lib.file)


@query(r"""SELECT DISTINCT CASE WHEN regexp_replace(dir, '/?[^/]*$', '') = '' THEN '/' ELSE regexp_replace(dir, '/?[^/]*$', '') END AS dir
          FROM (SELECT dir FROM path UNION ALL SELECT '/' || n_name FROM nation)""")
def reindex_roots(lib: Library):
    tops = lib.raw("nation").select(F.concat(F.lit("/"), "n_name").alias("dir"))
    return stats.reindex_roots(lib.path.select("dir").unionByName(tops))


@query("""SELECT event_type AS phase, count(*) AS count, round(sum(value), 4) AS total_ms, min(value) AS min_ms, max(value) AS max_ms,
            round(avg(value), 6) AS mean_ms FROM events GROUP BY ALL""")
def phase_profile(lib: Library):
    timings = lib.raw("events").select(F.col("event_type").alias("phase"), F.col("value").alias("ms"))
    return stats.phase_profile(timings).withColumns({
        "total_ms": F.round("total_ms", 4), "mean_ms": F.round("mean_ms", 6)})


@query("""SELECT epoch_us(max(ts)) / 1000 - epoch_us(min(ts)) / 1000 AS wall_ms FROM events""")
def wall_time(lib: Library):
    return stats.wall_time(lib.event, "ts", "ts")


@query("""SELECT event_id, CASE WHEN action = 'progress' THEN 'progress,mediaItem,indexing:' || processed || '/' || total || ','
            ELSE action || ',mediaItem,' || id || ',' || user_id END AS message FROM change""")
def change_message(lib: Library):
    names = ("action", "source", "id", "user_id", "phase", "processed", "total")
    return lib.change.select("event_id", stats.change_message(*[F.col(n) for n in names]).alias("message"))


@query("""SELECT event_id AS item_id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS date, action
          FROM change WHERE action <> 'progress'""")
def media_log_rows(lib: Library):
    """The audit rows an append to the media log writes."""
    changes = lib.change.filter("action <> 'progress'").withColumnRenamed("id", "item_id")
    return log_rows(changes, F.col("ts"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso FROM events""")
def iso_dates(lib: Library):
    return lib.event.select("event_id", iso_timestamp(F.col("ts")).alias("iso"))
