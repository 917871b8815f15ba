"""File-move plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions.scalars import date_stem as stem_of
from shutterlake.operators import moveplan
from shutterlake.plans.library import Library
from shutterlake.queries.registry import query

STEM = "substr(regexp_replace(regexp_replace(replace(replace(start_date, '-', ''), ':', ''), 'T', '_'), '\\.\\d+.*$', ''), 1, 15)"

PLAN = {
    "plan": f"""
        SELECT m.id AS item_id, f.id AS file_id, f.extension, 'IMG_' || {STEM} AS stem
        FROM media_item m JOIN media_item_file l ON l.media_item_id = m.id JOIN file f ON f.id = l.file_id
        WHERE m.start_date IS NOT NULL""",
    "named": """
        SELECT *, CASE WHEN n = 1 THEN stem ELSE stem || '(' || n || ')' END AS new_name FROM (
          SELECT *, row_number() OVER (PARTITION BY lower(stem || '.' || extension) ORDER BY item_id, file_id) AS n FROM plan)""",
}


def _plan(lib: Library):
    return moveplan.move_candidates(lib.media_item, lib.media_item_file, lib.file)


@query("""SELECT DISTINCT m.id, m.start_date FROM media_item m JOIN media_item_file l ON l.media_item_id = m.id
          JOIN file f ON f.id = l.file_id JOIN path p ON p.id = f.path_id WHERE p.dir LIKE '/lib/a1/%'""")
def items_in_dirs(lib: Library):
    dirs = lib.path.filter("dir LIKE '/lib/a1/%'")
    return moveplan.items_in_dirs(dirs, lib.path, lib.file, lib.media_item_file, lib.media_item)


@query(f"SELECT id, {STEM} AS stem FROM media_item WHERE start_date IS NOT NULL")
def date_stem(lib: Library):
    dated = lib.media_item.filter("start_date IS NOT NULL")
    return dated.select("id", stem_of(F.col("start_date")).alias("stem"))


@query("SELECT item_id, file_id, new_name FROM named", PLAN)
def unique_names(lib: Library):
    return moveplan.unique_names(_plan(lib)).select("item_id", "file_id", "new_name")


@query("""SELECT count(*) FILTER (ready) AS moved, count(*) FILTER (NOT ready) AS skipped FROM (
          SELECT start_date IS NOT NULL AND id IN (SELECT media_item_id FROM media_item_file) AS ready FROM media_item)""")
def skip_undated(lib: Library):
    return moveplan.move_report(lib.media_item, lib.media_item_file)


@query("""SELECT doc_id, CASE WHEN extension = 'aae' THEN 'missing_copy' WHEN n_chars > 5000 THEN 'mismatch' ELSE 'ok' END AS verdict
          FROM listing JOIN documents USING (doc_id)
          UNION ALL SELECT -1 - page_id, 'missing_source' FROM pages""")
def checksum_audit(lib: Library):
    docs = lib.raw("documents")
    source = docs.select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("hash"))
    kept = lib.listing.filter("extension <> 'aae'").select("doc_id")
    content = F.when(F.col("n_chars") > 5000, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    copies = docs.join(kept, "doc_id", "left_semi").select(
        "doc_id", F.sha1(F.encode(content, "UTF-8")).alias("hash"))
    strays = lib.raw("pages").select((-F.col("page_id") - 1).alias("doc_id"), F.sha1("html").alias("hash"))
    return moveplan.checksum_audit(source, copies.unionByName(strays), ["doc_id"])


@query("""SELECT f.id, coalesce(n.new_name, f.name) AS name, CASE WHEN n.file_id IS NULL THEN p.dir ELSE '/moved/' || n.extension END AS dir
          FROM file f JOIN path p ON p.id = f.path_id LEFT JOIN named n ON n.file_id = f.id""", PLAN)
def repoint_files(lib: Library):
    moves = moveplan.unique_names(_plan(lib)).select(
        "file_id", "new_name", F.concat(F.lit("/moved/"), "extension").alias("dir"))
    files, paths = moveplan.repoint_files(lib.file, lib.path, moves)
    where = paths.select(F.col("id").alias("path_id"), "dir")
    return files.join(where, "path_id").select("id", "name", "dir")
