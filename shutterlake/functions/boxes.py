"""Face boxes and landmarks: letterboxing, anchor decoding, overlap, cropping, alignment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterlake.functions.scalars import round_half_up

MODEL_INPUT = 640
SCORE_THRESHOLD = 0.6
CROP_PADDING = 0.3
ALIGN_MAX_SIDE = 2048

# Landmark names in model order, and the aligned-face positions of a 112x112 crop.
LANDMARKS = ["rightEye", "leftEye", "noseTip", "rightMouthCorner", "leftMouthCorner"]
ALIGNED_POINTS = [
    (38.2946, 51.6963),
    (73.5318, 51.5014),
    (56.0252, 71.7366),
    (41.5493, 92.3655),
    (70.7299, 92.2041),
]


def letterbox(width: Column, height: Column) -> Column:
    """struct<scale, width, height> of the image fitted into the model input."""
    side = F.lit(float(MODEL_INPUT))
    scale = F.least(side / width, side / height, F.lit(1.0))
    return F.struct(
        scale.alias("scale"),
        round_half_up(width * scale).cast("bigint").alias("width"),
        round_half_up(height * scale).cast("bigint").alias("height"),
    )


def _unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double")))


def anchor_score(cls: Column, obj: Column) -> Column:
    return F.sqrt(_unit(cls) * _unit(obj))


def decode_box(stride: Column, idx: Column, bbox: Column, kps: Column) -> Column:
    """struct<x, y, width, height, landmarks> of one anchor; idx counts row by row."""
    cols = F.floor(F.lit(MODEL_INPUT) / stride)
    row = F.floor(idx / cols)
    col = idx - row * cols
    width = F.exp(F.element_at(bbox, 3)) * stride
    height = F.exp(F.element_at(bbox, 4)) * stride
    centre_x = (col + F.element_at(bbox, 1)) * stride
    centre_y = (row + F.element_at(bbox, 2)) * stride
    points = F.transform(
        kps, lambda k, i: (k + F.when(i % 2 == 0, col).otherwise(row)) * stride
    )
    return F.struct(
        (centre_x - width / 2).alias("x"),
        (centre_y - height / 2).alias("y"),
        width.alias("width"),
        height.alias("height"),
        points.alias("landmarks"),
    )


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two struct<x, y, width, height>; 0 when disjoint."""
    overlap_x = F.greatest(
        F.lit(0.0),
        F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]),
    )
    overlap_y = F.greatest(
        F.lit(0.0),
        F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]),
    )
    shared = overlap_x * overlap_y
    union = a["width"] * a["height"] + b["width"] * b["height"] - shared
    return F.when(shared == 0, F.lit(0.0)).otherwise(shared / union)


def unscale(value: Column, scale: Column) -> Column:
    return value * F.when(scale == 0, F.lit(1.0)).otherwise(1 / scale)


def crop_box(box: Column, image_width: Column, image_height: Column) -> Column:
    """Box padded by 30 %, rounded and clamped; null when nothing is left."""
    pad_x = box["width"] * CROP_PADDING
    pad_y = box["height"] * CROP_PADDING
    left = F.greatest(F.lit(0.0), round_half_up(box["x"] - pad_x))
    top = F.greatest(F.lit(0.0), round_half_up(box["y"] - pad_y))
    right = F.least(
        image_width.cast("double"), round_half_up(box["x"] + box["width"] + pad_x)
    )
    bottom = F.least(
        image_height.cast("double"), round_half_up(box["y"] + box["height"] + pad_y)
    )
    crop = F.struct(
        left.cast("bigint").alias("left"),
        top.cast("bigint").alias("top"),
        (right - left).cast("bigint").alias("width"),
        (bottom - top).cast("bigint").alias("height"),
    )
    return F.when((right > left) & (bottom > top), crop)


def valid_landmarks(landmarks: Column) -> Column:
    """All five points present and numeric."""
    present = F.lit(True)
    for name in LANDMARKS:
        for axis in ("x", "y"):
            value = landmarks[name][axis]
            present = present & value.isNotNull() & ~F.isnan(value)
    return F.coalesce(present, F.lit(False))


def alignment_transform(landmarks: Column, image_width: Column, image_height: Column) -> Column:
    """Least-squares rotation + uniform scale + shift from landmarks to the aligned points.

    struct<a, b, tx, ty> for x' = a*x - b*y + tx, y' = b*x + a*y + ty. Landmarks are first scaled
    as the image would be when its longer side is limited to 2048 pixels. Means of the five target
    points are constants, so the fit is five terms of plain arithmetic.
    """
    shrink = F.least(
        F.lit(1.0), F.lit(float(ALIGN_MAX_SIDE)) / F.greatest(image_width, image_height)
    )
    xs = [landmarks[name]["x"] * shrink for name in LANDMARKS]
    ys = [landmarks[name]["y"] * shrink for name in LANDMARKS]
    n = float(len(LANDMARKS))
    mean_x = sum(xs[1:], xs[0]) / n
    mean_y = sum(ys[1:], ys[0]) / n
    target_x = sum(p[0] for p in ALIGNED_POINTS) / n
    target_y = sum(p[1] for p in ALIGNED_POINTS) / n
    along, across, spread = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for x, y, (px, py) in zip(xs, ys, ALIGNED_POINTS):
        sx, sy = x - mean_x, y - mean_y
        dx, dy = px - target_x, py - target_y
        along = along + sx * dx + sy * dy
        across = across + sx * dy - sy * dx
        spread = spread + sx * sx + sy * sy
    a = along / spread
    b = across / spread
    return F.when(
        spread > 0,
        F.struct(
            a.alias("a"),
            b.alias("b"),
            (target_x - a * mean_x + b * mean_y).alias("tx"),
            (target_y - b * mean_x - a * mean_y).alias("ty"),
        ),
    )
