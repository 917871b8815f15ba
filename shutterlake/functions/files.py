"""File names: extensions, classes, group names, primary choice, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions a media library recognises.
IMAGE = ["jpg", "jpeg", "jpe", "jfif", "png", "webp", "tiff", "tif", "heic", "heif"]
VIDEO = ["mov", "mts", "m4v", "mp4", "webm", "ogg"]
JPEG = ["jpg", "jpeg", "jpe", "jfif"]
HEIC = ["heic", "heif"]
SIDECAR = ["aae"]

SHORT_MOV_BYTES = 5 * 1024 * 1024


def is_one_of(extension: Column, names: list[str]) -> Column:
    return F.lower(extension).isin(names)


def is_media_file(extension: Column) -> Column:
    return is_one_of(extension, IMAGE + VIDEO + SIDECAR)


def file_class(extension: Column) -> Column:
    return (
        F.when(is_one_of(extension, VIDEO), "video")
        .when(is_one_of(extension, IMAGE), "image")
        .otherwise("other")
    )


def split_path(path: Column) -> Column:
    """struct<dir, name, extension>; a leading dot belongs to the name."""
    clean = F.regexp_replace(path, "^[a-z0-9]+:/+", "/")
    base = F.regexp_extract(clean, "([^/]*)$", 1)
    return F.struct(
        F.regexp_replace(clean, "/[^/]*$", "").alias("dir"),
        F.regexp_replace(base, r"(?<=.)\.[^.]*$", "").alias("name"),
        F.regexp_extract(base, r"(?<=.)\.([^.]*)$", 1).alias("extension"),
    )


def group_name(name: Column) -> Column:
    """Edited phone shots (``IMG_E0001``) belong with their original (``IMG_0001``)."""
    return F.regexp_replace(name, r"^IMG_E(\d+)$", "IMG_$1")


def primary_rank(extension: Column, size: Column) -> Column:
    """0 HEIC, 1 other non-JPEG media, 2 other candidates, 3 never by choice."""
    short_mov = (F.lower(extension) == "mov") & (size < SHORT_MOV_BYTES)
    return (
        F.when(is_one_of(extension, SIDECAR) | F.coalesce(short_mov, F.lit(False)), 3)
        .when(is_one_of(extension, HEIC), 0)
        .when(is_one_of(extension, IMAGE + VIDEO) & ~is_one_of(extension, JPEG), 1)
        .otherwise(2)
    )


def full_path(directory: Column, name: Column, extension: Column) -> Column:
    """dir/name.ext, without the dot when there is no extension."""
    suffix = F.when(F.length(extension) > 0, F.concat(F.lit("."), extension)).otherwise("")
    return F.concat(directory, F.lit("/"), name, suffix)
