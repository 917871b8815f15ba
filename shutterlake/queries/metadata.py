"""Tag and probe normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions import tags as rules
from shutterlake.operators import catalogue, metadata
from shutterlake.plans.library import Library
from shutterlake.queries.registry import query


def _text(column):
    return F.col(column).cast("string")


def part_tags(lib: Library):
    """Raw tag maps from part: two blocks per image, some tags absent, blank or not numeric."""
    part = lib.raw("part")
    first = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("Make", "Model", "ISO", "ImageWidth", "ImageHeight", "Software")]),
        F.array(
            F.concat(F.lit("  "), "p_brand", F.lit(" ")),
            F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name")),
            F.when(F.col("p_size") % 5 == 0, "auto").otherwise(_text("p_size")),
            (F.col("p_size") * 60).cast("string"), (F.col("p_size") * 40).cast("string"),
            F.lit("block0"),
        ),
    )
    second = F.map_from_arrays(
        F.array(*[F.lit(k) for k in (
            "ExposureTime", "FNumber", "DateTimeOriginal", "OffsetTime", "ISOSpeedRatings", "Keywords",
            "ObjectName", "Software", "latitude", "longitude")]),
        F.array(
            F.when(F.col("p_size") <= 10, _text("p_size")).otherwise((F.lit(10.0) / F.col("p_size") / 10).cast("string")),
            (F.col("p_retailprice") / 100).cast("string"),
            F.concat(F.lit("2024-01-"), F.lpad(_text("p_size"), 2, "0")), F.lit("+01:00"), F.lit("64"),
            F.when(F.col("p_size") % 3 == 0, F.to_json(F.split("p_name", " "))).otherwise(F.col("p_name")),
            F.col("p_type"), F.lit("block1"),
            F.when(F.col("p_size") % 7 != 0, (F.col("p_size") * 1.5).cast("string")),
            F.concat(F.lit("-"), _text("p_size"), F.lit(".25")),
        ),
    )
    return part.select(
        F.col("p_partkey").alias("id"), "p_name", "p_type", "p_size",
        F.map_filter(first, lambda _, v: v.isNotNull()).alias("block0"),
        F.map_filter(second, lambda _, v: v.isNotNull()).alias("block1"),
    )


def _merged(lib: Library):
    return metadata.merge_tag_blocks(part_tags(lib), ["block0", "block1"])


EXPOSURE = {
    "exposed": """
        SELECT p_partkey AS id, p_size,
          CASE WHEN p_size <= 10 THEN CAST(p_size AS DOUBLE) ELSE 10.0 / p_size / 10 END AS seconds FROM part""",
}


@query("""
    SELECT p_partkey AS id, trim(p_brand) AS make, CASE WHEN p_size % 4 <> 0 THEN p_name END AS model,
      CAST(CASE WHEN p_size % 5 = 0 THEN 64 ELSE p_size END AS DOUBLE) AS iso,
      round(p_retailprice / 100, 6) AS f_stop,
      '2024-01-' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS date, '+01:00' AS date_offset,
      CAST(p_size * 60 AS DOUBLE) AS width, CAST(p_size * 40 AS DOUBLE) AS height,
      p_type AS headline,
      CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '|') ELSE p_name END AS keywords,
      CASE WHEN p_size % 7 <> 0 THEN CAST(p_size * 1.5 AS DOUBLE) END AS latitude,
      CASE WHEN p_size % 7 <> 0 THEN 'POINT(-' || p_size || '.25 ' ||
        CASE WHEN p_size % 2 = 0 THEN CAST(p_size * 3 // 2 AS VARCHAR) ELSE CAST(p_size * 3 // 2 AS VARCHAR) || '.5' END || ')' END AS wkt
    FROM part""")
def normalise_image_tags(lib: Library):
    typed = metadata.normalise_image_tags(_merged(lib))
    return typed.select(
        "id", "camera.make", "camera.model", "exposure.iso", F.round("exposure.fStop", 6).alias("f_stop"),
        F.col("date.date").alias("date"), F.col("date.offset").alias("date_offset"), "width", "height",
        "iptc.headline", F.array_join("iptc.keywords", "|").alias("keywords"),
        F.when(F.col("gps").isNotNull(), F.col("gps.latitude")).alias("latitude"), "wkt")


@query("""SELECT p_partkey AS id, 'block1' AS software, p_brand AS make FROM part""")
def merge_tag_blocks(lib: Library):
    tags = F.col("tags")
    return _merged(lib).select("id", tags["Software"].alias("software"), F.trim(tags["Make"]).alias("make"))


@query("""SELECT id, CASE WHEN seconds >= 1 THEN CAST(CAST(seconds AS BIGINT) AS VARCHAR) || 's'
            ELSE '1/' || CAST(floor(1 / seconds + 0.5) AS BIGINT) || 's' END AS shutter FROM exposed""", EXPOSURE)
def format_shutter(lib: Library):
    seconds = F.when(F.col("p_size") <= 10, F.col("p_size").cast("double")).otherwise(
        F.lit(10.0) / F.col("p_size") / 10)
    return lib.raw("part").select(F.col("p_partkey").alias("id"), rules.shutter_text(seconds).alias("shutter"))


@query("""SELECT c_custkey AS id, 'POINT(' || c_nationkey || ' ' || c_custkey || '.5)' AS wkt FROM customer""")
def wkt_point(lib: Library):
    return lib.raw("customer").select(
        F.col("c_custkey").alias("id"),
        rules.wkt_point(F.col("c_custkey") + F.lit(0.5), F.col("c_nationkey").cast("double")).alias("wkt"))


def _probe(row_prefix: str = ""):
    """Probe JSON text of a media file from event columns."""
    return F.concat(
        F.lit('{"format":{"duration":"'), F.col("value").cast("string"),
        F.lit('","tags":{'),
        F.when(F.col("event_type") == "view", F.concat(F.lit('"creation_time":"D'), "user_id", F.lit('"')))
        .otherwise(F.lit('"encoder":"x"')),
        F.lit('}},"streams":[{"codec_type":"audio","r_frame_rate":"0/0","tags":{}},'
              '{"codec_type":"video","width":'), "user_id", F.lit(',"height":'), F.hour("ts"),
        F.lit(',"r_frame_rate":"'),
        F.when(F.col("event_type") == "error", "junk")
        .when(F.col("event_type") == "click", "25")
        .otherwise(F.concat((F.col("event_id") + 1) * 1000, F.lit("/"), F.lit(1001))),
        F.lit('","tags":{"Creation Time":"S'), "event_id", F.lit('"}}]}'),
    )


@query("""
    SELECT event_id AS id,
      CASE WHEN event_type = 'view' THEN 'D' || user_id ELSE 'S' || event_id END AS date,
      user_id AS width, hour(ts) AS height, value AS duration,
      CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 25.0
        ELSE floor((event_id + 1) * 1000 / 1001 * 100 + 0.5) / 100 END AS frame_rate
    FROM events""")
def normalise_probe(lib: Library):
    probes = lib.event.select(F.col("event_id").alias("id"), _probe().alias("probe"))
    return metadata.normalise_probe(probes).select(
        "id", "date", "width", "height", "duration", F.col("frameRate").alias("frame_rate"))


@query("""
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_custkey = 0 THEN o_orderkey
      ELSE floor(o_orderkey / o_custkey * 100 + 0.5) / 100 END AS rate FROM orders""")
def parse_frame_rate(lib: Library):
    text = F.when(F.col("o_orderkey") % 4 == 0, F.lit("n/a")).when(
        F.col("o_custkey") == 0, _text("o_orderkey")
    ).otherwise(F.concat(_text("o_orderkey"), F.lit("/"), _text("o_custkey")))
    return lib.raw("orders").select(F.col("o_orderkey").alias("id"), rules.frame_rate(text).alias("rate"))


@query(r"""
    SELECT l.doc_id, coalesce(
      CASE WHEN l.extension <> 'heic' THEN l.hash END, j.hash) AS make
    FROM listing l LEFT JOIN (SELECT dir, regexp_replace(name, '^IMG_E', 'IMG_') AS name, hash FROM listing WHERE extension = 'jpg') j
      ON j.dir = l.dir AND j.name = regexp_replace(l.name, '^IMG_E', 'IMG_')""")
def sidecar_fallback(lib: Library):
    files = lib.listing.select(
        "doc_id", "dir", F.regexp_replace("name", "^IMG_E", "IMG_").alias("name"), "extension",
        F.when(F.col("extension") != "heic", F.create_map(F.lit("Make"), F.col("hash"))).alias("tags"))
    filled = metadata.sidecar_fallback(files)
    return filled.select("doc_id", F.try_element_at("tags", F.lit("Make")).alias("make"))


@query("""
    SELECT event_id AS id, event_type AS kind,
      CASE event_type WHEN 'view' THEN 'D' || user_id WHEN 'click' THEN 'T' || event_id END AS date,
      CASE event_type WHEN 'view' THEN CAST(user_id AS DOUBLE) WHEN 'click' THEN value END AS width,
      CASE event_type WHEN 'view' THEN value END AS duration,
      CASE event_type WHEN 'click' THEN 'M' || user_id END AS make
    FROM events""")
def metadata_by_type(lib: Library):
    extension = F.when(F.col("event_type") == "view", "MP4").when(
        F.col("event_type") == "click", "jpg").otherwise("txt")
    rows = lib.event.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"), extension.alias("extension"),
        _probe().alias("probe"),
        F.create_map(
            F.lit("DateTimeOriginal"), F.concat(F.lit("T"), "event_id"),
            F.lit("ImageWidth"), _text("value"), F.lit("Make"), F.concat(F.lit("M"), "user_id"),
        ).alias("tags"))
    done = metadata.metadata_by_type(rows)
    return done.select("id", "kind", F.col("date.date").alias("date"), "width", "duration",
                       F.col("camera.make").alias("make"))


@query("""
    SELECT p_partkey AS id, true AS has_camera, true AS has_exposure,
      true AS has_iptc, true AS has_size, p_size % 7 <> 0 AS has_gps FROM part""")
def build_item_info(lib: Library):
    typed = metadata.normalise_image_tags(_merged(lib)).withColumns({
        "duration": F.lit(None).cast("double"), "frameRate": F.lit(None).cast("double")})
    info = catalogue.build_item_info(typed)
    return info.select("id", *[
        F.col(f"info.{part}").isNotNull().alias(name) for part, name in (
            ("camera", "has_camera"), ("exposure", "has_exposure"), ("iptc", "has_iptc"),
            ("dimensions", "has_size"), ("gps", "has_gps"))])
