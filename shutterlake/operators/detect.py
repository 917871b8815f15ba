"""From raw detector rows to stored faces: decode, suppress overlaps, unscale, crop, align."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.boxes import (
    SCORE_THRESHOLD,
    anchor_score,
    decode_box,
    iou,
    unscale,
)

NMS_THRESHOLD = 0.3
NMS_TOP_K = 5000
MAX_FACES = 20
CORNERS_AT_ONCE = 256  # kept boxes compared with a batch at a time

BOX = "image_id", "box_id", "x", "y", "width", "height", "score"


def decode_anchors(anchors: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Raw rows (image_id, stride, idx, cls, obj, bbox[4], kps[10]) -> scored boxes.

    The score filter runs on plain columns before any box is decoded.
    """
    scored = anchors.withColumn("score", anchor_score(F.col("cls"), F.col("obj"))).filter(
        F.col("score") >= threshold
    )
    box = decode_box(F.col("stride"), F.col("idx"), F.col("bbox"), F.col("kps"))
    return scored.withColumn("_box", box).select(
        "image_id", "stride", "idx", "score",
        "_box.x", "_box.y", "_box.width", "_box.height", "_box.landmarks",
    )


def suppress_overlaps(boxes: DataFrame, threshold: float = NMS_THRESHOLD,
                      top_k: int = NMS_TOP_K) -> DataFrame:
    """Greedy suppression per image: best score first, ties by box_id, at most ``top_k`` kept.

    ``boxes`` has image_id, box_id, x, y, width, height, score; a row with a null among them is no
    box and goes. One shuffle brings the boxes of an image into one sorted run, and a sweep reads
    these runs batch by batch: it holds a batch and the boxes kept so far of the image it is in,
    never a whole image. The boxes of all images in a batch are settled together.
    """
    typed = boxes.select(
        "image_id", F.col("box_id").cast("bigint").alias("box_id"),
        *[F.col(c).cast("double").alias(c) for c in BOX[2:]],
    ).dropna()
    runs = typed.repartition("image_id").sortWithinPartitions(
        "image_id", -F.col("score"), *BOX[1:6]
    )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, corners = None, np.zeros((0, 4))  # the last image and the boxes kept of it
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            starts = np.zeros(batch.num_rows, dtype=bool)
            starts[1:] = np.asarray(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)))
            run = np.cumsum(starts)  # numbers the batch's images from 0
            places = np.column_stack([np.asarray(batch.column(i)) for i in range(2, 6)])
            if ids[0].as_py() != image:
                corners = corners[:0]
            kept = _settle(places, run, corners, threshold, top_k)
            last = kept[run[kept] == run[-1]]
            before = corners if run[-1] == 0 else corners[:0]
            image, corners = ids[-1].as_py(), np.concatenate([before, places[last]])
            yield batch.take(pa.array(kept))

    return runs.mapInArrow(sweep, runs.schema)


def _overlaps(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the boxes (x, y, width, height in the last axis) share more than ``threshold``."""
    low = np.maximum(a[..., :2], b[..., :2])
    high = np.minimum(a[..., :2] + a[..., 2:], b[..., :2] + b[..., 2:])
    side = np.maximum(high - low, 0.0)
    shared = side[..., 0] * side[..., 1]
    union = a[..., 2] * a[..., 3] + b[..., 2] * b[..., 3] - shared
    ratio = np.divide(shared, union, out=np.zeros_like(shared), where=shared != 0)
    return ratio > threshold


def _settle(places: np.ndarray, run: np.ndarray, corners: np.ndarray, threshold: float,
            top_k: int) -> np.ndarray:
    """The rows of a batch that stay; ``corners`` are boxes kept before of its first image.

    In each round the first open box of every image stays and closes those it overlaps.
    """
    first = np.flatnonzero(run == 0)
    closed = np.zeros(len(run), dtype=bool)
    for start in range(0, len(corners), CORNERS_AT_ONCE):
        part = corners[start:start + CORNERS_AT_ONCE]
        left = first[~closed[first]]
        closed[left] = _overlaps(part[None, :, :], places[left][:, None, :], threshold).any(axis=1)
    room = np.full(run[-1] + 1, top_k)
    room[0] -= len(corners)
    still = np.flatnonzero(~closed & (room[run] > 0))
    kept = []
    while len(still):
        heads = np.flatnonzero(np.diff(run[still], prepend=-1))
        best = still[heads]
        kept.append(best)
        room[run[best]] -= 1
        own = best[np.cumsum(np.diff(run[still], prepend=-1) != 0) - 1]
        stays = ~_overlaps(places[own], places[still], threshold) & (room[run[still]] > 0)
        stays[heads] = False
        still = still[stays]
    return np.sort(np.concatenate(kept)) if kept else np.zeros(0, dtype=np.int64)


def unscale_boxes(boxes: DataFrame, scale: str = "scale") -> DataFrame:
    """Boxes (and landmark points, when present) back in source-image pixels."""
    out = boxes.withColumns({
        c: unscale(F.col(c), F.col(scale)) for c in ("x", "y", "width", "height")
    })
    if "landmarks" in boxes.columns:
        out = out.withColumn(
            "landmarks", F.transform("landmarks", lambda v: unscale(v, F.col(scale)))
        )
    return out


def drop_crowded(boxes: DataFrame, most: int = MAX_FACES) -> DataFrame:
    """Images with more than ``most`` faces give none at all.

    A counted anti-join: the count combines before the shuffle, where a window would bring a
    crowded image's boxes into one task.
    """
    crowded = (
        boxes.groupBy("image_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
        .select("image_id")
    )
    return boxes.join(crowded, "image_id", "left_anti")


def overlap_with_best(boxes: DataFrame) -> DataFrame:
    """(image_id, box_id, best_id, iou): each box against the best-scored box of its image."""
    best = boxes.groupBy("image_id").agg(
        F.min_by(F.struct(*BOX[1:6]), F.struct(-F.col("score"), F.col("box_id"))).alias("_best")
    )
    return boxes.join(best, "image_id").select(
        "image_id", "box_id", F.col("_best.box_id").alias("best_id"),
        iou(F.col("_best"), F.struct(*BOX[1:6])).alias("iou"),
    )
