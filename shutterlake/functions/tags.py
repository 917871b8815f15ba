"""Rules from raw tag maps and probe JSON to typed metadata columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterlake.functions.scalars import (
    finite_number,
    js_number,
    round_half_up,
    text_or_null,
)

PROBE_SCHEMA = (
    "format STRUCT<duration: STRING, tags: MAP<STRING, STRING>>, "
    "streams ARRAY<STRUCT<codec_type: STRING, width: BIGINT, height: BIGINT, "
    "r_frame_rate: STRING, tags: MAP<STRING, STRING>>>"
)


def first_tag(tags: Column, *names: str) -> Column:
    return F.coalesce(*[F.try_element_at(tags, F.lit(n)) for n in names])


def taken_at(tags: Column) -> Column:
    return F.struct(
        first_tag(tags, "DateTimeOriginal", "CreateDate", "ModifyDate").alias("date"),
        first_tag(tags, "OffsetTimeOriginal", "OffsetTime").alias("offset"),
    )


def camera(tags: Column) -> Column:
    return F.struct(
        text_or_null(first_tag(tags, "Make")).alias("make"),
        text_or_null(first_tag(tags, "Model")).alias("model"),
        text_or_null(first_tag(tags, "LensMake")).alias("lensMake"),
        text_or_null(first_tag(tags, "LensModel")).alias("lensModel"),
    )


def shutter_text(seconds: Column) -> Column:
    """``2s`` from one second on, ``1/250s`` below."""
    fraction = F.concat(
        F.lit("1/"), round_half_up(F.try_divide(F.lit(1.0), seconds)).cast("bigint").cast("string"),
        F.lit("s"),
    )
    return F.when(seconds >= 1, F.concat(js_number(seconds), F.lit("s"))).otherwise(fraction)


def exposure(tags: Column) -> Column:
    seconds = finite_number(first_tag(tags, "ExposureTime"))
    return F.struct(
        finite_number(first_tag(tags, "FocalLength")).alias("focalLength"),
        finite_number(first_tag(tags, "ApertureValue")).alias("aperture"),
        finite_number(first_tag(tags, "FNumber")).alias("fStop"),
        shutter_text(seconds).alias("shutterSpeed"),
        seconds.alias("exposureTime"),
        F.coalesce(
            finite_number(first_tag(tags, "ISO")), finite_number(first_tag(tags, "ISOSpeedRatings"))
        ).alias("iso"),
    )


def gps(tags: Column) -> Column:
    """Null unless both coordinates are finite."""
    latitude = finite_number(first_tag(tags, "latitude"))
    longitude = finite_number(first_tag(tags, "longitude"))
    return F.when(
        latitude.isNotNull() & longitude.isNotNull(),
        F.struct(
            latitude.alias("latitude"),
            longitude.alias("longitude"),
            text_or_null(first_tag(tags, "GPSMapDatum")).alias("datum"),
            finite_number(first_tag(tags, "GPSImgDirection")).alias("azimuth"),
        ),
    )


def wkt_point(latitude: Column, longitude: Column) -> Column:
    return F.concat(
        F.lit("POINT("), js_number(longitude), F.lit(" "), js_number(latitude), F.lit(")")
    )


def iptc(tags: Column) -> Column:
    """Keywords arrive as one text or as a JSON array; entries that are not text are dropped."""
    raw = first_tag(tags, "Keywords")
    items = F.from_json(raw, "array<string>")
    text_items = F.filter(
        F.from_json(raw, "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING"
    )
    listed = F.transform(text_items, lambda v: F.variant_get(v, "$", "string"))
    keywords = (
        F.when(raw.isNull(), F.array().cast("array<string>"))
        .when(raw.startswith("[") & items.isNotNull(), listed)
        .otherwise(F.array(raw))
    )
    return F.struct(
        text_or_null(first_tag(tags, "Headline", "ObjectName")).alias("headline"),
        text_or_null(first_tag(tags, "Caption", "Caption-Abstract")).alias("caption"),
        keywords.alias("keywords"),
        text_or_null(first_tag(tags, "CopyrightNotice", "Copyright")).alias("copyright"),
    )


def dimension(tags: Column, axis: str) -> Column:
    return finite_number(first_tag(tags, f"Image{axis}", f"ExifImage{axis}"))


def merge_blocks(*blocks: Column) -> Column:
    """Flattens tag blocks; the later block wins.

    Written with map_filter so that no session-wide duplicate-key policy is needed.
    """
    empty = F.create_map().cast("map<string,string>")

    def over(earlier: Column, later: Column) -> Column:
        kept = F.map_filter(earlier, lambda key, _: ~F.map_contains_key(later, key))
        return F.map_concat(kept, later)

    filled = [F.coalesce(block, empty) for block in blocks]
    return reduce(over, filled)


def frame_rate(rate: Column) -> Column:
    """``30000/1001`` -> 29.97, plain numbers pass, anything else is null."""
    parts = F.split(rate, "/")
    num = F.try_element_at(parts, F.lit(1)).try_cast("double")
    den = F.try_element_at(parts, F.lit(2)).try_cast("double")
    ratio = round_half_up(num / F.when(den > 0, den), 100)
    plain = finite_number(rate)
    return F.when((F.size(parts) == 2) & (den > 0) & num.isNotNull(), ratio).otherwise(plain)


def parse_probe(probe_json: Column) -> Column:
    return F.from_json(probe_json, PROBE_SCHEMA)


def probe_fields(probe: Column) -> Column:
    """First video stream's size and rate, duration, and the first date found."""
    streams = probe["streams"]
    video = F.try_element_at(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(1))
    stream_dates = F.filter(
        F.transform(streams, lambda s: first_tag(s["tags"], "creation_time", "Creation Time")),
        lambda d: F.length(d) > 0,
    )
    format_date = first_tag(probe["format"]["tags"], "creation_time", "Creation Time", "date")
    return F.struct(
        F.when(F.length(format_date) > 0, format_date)
        .otherwise(F.try_element_at(stream_dates, F.lit(1)))
        .alias("date"),
        video["width"].alias("width"),
        video["height"].alias("height"),
        finite_number(probe["format"]["duration"]).alias("duration"),
        frame_rate(video["r_frame_rate"]).alias("frameRate"),
    )


def item_info(meta: Column) -> Column:
    """The info document of an item: parts with nothing to say are null, as is an empty whole."""
    cam, exp, ip = meta["camera"], meta["exposure"], meta["iptc"]
    has_camera = (F.length(cam["make"]) > 0) | (F.length(cam["model"]) > 0)
    has_exposure = (exp["iso"] != 0) | (exp["focalLength"] != 0)
    has_iptc = (F.size(ip["keywords"]) > 0) | (F.length(ip["headline"]) > 0)
    has_size = meta["width"].isNotNull() & meta["height"].isNotNull()
    place = meta["gps"]
    info = F.struct(
        F.when(has_camera, cam).alias("camera"),
        F.when(has_exposure, exp).alias("exposure"),
        F.when(has_iptc, ip).alias("iptc"),
        meta["duration"].alias("duration"),
        meta["frameRate"].alias("frameRate"),
        F.when(
            has_size, F.struct(meta["width"].alias("width"), meta["height"].alias("height"))
        ).alias("dimensions"),
        F.when(
            place.isNotNull(),
            F.struct(place["latitude"].alias("latitude"), place["longitude"].alias("longitude")),
        ).alias("gps"),
    )
    anything = (
        F.coalesce(has_camera, F.lit(False))
        | F.coalesce(has_exposure, F.lit(False))
        | F.coalesce(has_iptc, F.lit(False))
        | meta["duration"].isNotNull()
        | meta["frameRate"].isNotNull()
        | has_size
        | place.isNotNull()
    )
    return F.when(anything, info)
