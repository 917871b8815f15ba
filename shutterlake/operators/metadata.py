"""Raw tag and probe tables -> typed media metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import tags as rules
from shutterlake.functions.files import file_class

# JPEG spellings looked for beside a file without tags, in this order.
SIDECAR_ORDER = ["jpg", "jpeg", "JPG", "JPEG"]

METADATA = (
    "date STRUCT<date: STRING, offset: STRING>, "
    "camera STRUCT<make: STRING, model: STRING, lensMake: STRING, lensModel: STRING>, "
    "exposure STRUCT<focalLength: DOUBLE, aperture: DOUBLE, fStop: DOUBLE, shutterSpeed: STRING, "
    "exposureTime: DOUBLE, iso: DOUBLE>, "
    "gps STRUCT<latitude: DOUBLE, longitude: DOUBLE, datum: STRING, azimuth: DOUBLE>, "
    "iptc STRUCT<headline: STRING, caption: STRING, keywords: ARRAY<STRING>, copyright: STRING>, "
    "width DOUBLE, height DOUBLE, duration DOUBLE, frameRate DOUBLE, wkt STRING"
)


def merge_tag_blocks(df: DataFrame, blocks: list[str], name: str = "tags") -> DataFrame:
    """One tag map from several block columns; a later block wins."""
    return df.withColumn(name, rules.merge_blocks(*[F.col(b) for b in blocks]))


def normalise_image_tags(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Adds date, camera, exposure, gps, iptc, width, height and wkt; one projection, no shuffle."""
    tag = F.col(tags)
    typed = df.withColumns({
        "date": rules.taken_at(tag),
        "camera": rules.camera(tag),
        "exposure": rules.exposure(tag),
        "gps": rules.gps(tag),
        "iptc": rules.iptc(tag),
        "width": rules.dimension(tag, "Width"),
        "height": rules.dimension(tag, "Height"),
    })
    return typed.withColumn(
        "wkt", rules.wkt_point(F.col("gps.latitude"), F.col("gps.longitude"))
    )


def normalise_probe(df: DataFrame, probe_json: str = "probe") -> DataFrame:
    """Adds date, width, height, duration and frameRate from probe JSON text."""
    fields = rules.probe_fields(F.col("_probe"))
    return (
        df.withColumn("_probe", rules.parse_probe(F.col(probe_json)))
        .withColumn("_f", fields)
        .select(*df.columns, "_f.*")
    )


def sidecar_fallback(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Files without tags take those of a JPEG of the same name beside them.

    ``df`` has dir, name, extension and the tag map. The best JPEG per (dir, name) is a
    ``min_by`` aggregate.
    """
    spelling = F.array_position(F.array(*[F.lit(e) for e in SIDECAR_ORDER]), F.col("extension"))
    beside = (
        df.withColumn("_spelling", spelling)
        .filter(F.col("_spelling") > 0)
        .groupBy("dir", "name")
        .agg(F.min_by(tags, "_spelling").alias("_beside"))
    )
    bare = F.coalesce(F.size(F.map_keys(tags)), F.lit(0)) <= 0
    return (
        df.join(beside, ["dir", "name"], "left")
        .withColumn(tags, F.when(bare, F.coalesce("_beside", tags)).otherwise(F.col(tags)))
        .select(*df.columns)
    )


def metadata_by_type(df: DataFrame) -> DataFrame:
    """Videos from their probe, images from their tags, anything else all null.

    ``df`` has extension, tags and probe; one pass over it, each row taking its branch.
    """
    from pyspark.sql.types import StructType

    kind = file_class(F.col("extension"))
    both = df.withColumns({
        "_kind": kind,
        "_v": rules.probe_fields(rules.parse_probe(F.col("probe"))),
    })
    image = F.col("_kind") == "image"
    video = F.col("_kind") == "video"
    tag = F.col("tags")
    gps = rules.gps(tag)
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in StructType.fromDDL(METADATA)}
    no_keywords = F.struct(
        F.lit(None).cast("string").alias("headline"), F.lit(None).cast("string").alias("caption"),
        F.array().cast("array<string>").alias("keywords"),
        F.lit(None).cast("string").alias("copyright"),
    )
    video_date = F.when(
        F.length("_v.date") > 0,
        F.struct(F.col("_v.date").alias("date"), F.lit(None).cast("string").alias("offset")),
    )

    def branch(for_image, for_video, name):
        return (
            F.when(image, for_image).when(video, for_video).otherwise(nothing[name]).alias(name)
        )

    return both.select(
        *df.columns,
        branch(rules.taken_at(tag), video_date, "date"),
        branch(rules.camera(tag), nothing["camera"], "camera"),
        branch(rules.exposure(tag), nothing["exposure"], "exposure"),
        branch(gps, nothing["gps"], "gps"),
        F.when(image, rules.iptc(tag)).otherwise(no_keywords).alias("iptc"),
        branch(rules.dimension(tag, "Width"), F.col("_v.width").cast("double"), "width"),
        branch(rules.dimension(tag, "Height"), F.col("_v.height").cast("double"), "height"),
        branch(nothing["duration"], F.col("_v.duration"), "duration"),
        branch(nothing["frameRate"], F.col("_v.frameRate"), "frameRate"),
        F.when(image, rules.wkt_point(gps["latitude"], gps["longitude"])).alias("wkt"),
    )
