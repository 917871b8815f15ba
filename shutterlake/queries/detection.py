"""Detector post-processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions import boxes
from shutterlake.operators import detect
from shutterlake.plans.library import Library
from shutterlake.queries.registry import query

def _anchors(lib: Library):
    """Raw detector rows from lineitem: one anchor each, small integer box and landmark values."""
    number = F.col("l_linenumber").cast("double")
    stride = F.element_at(F.array(F.lit(8), F.lit(16), F.lit(32)), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return lib.raw("lineitem").select(
        F.col("l_orderkey").alias("image_id"), "l_partkey", "l_linenumber", stride.alias("stride"),
        (F.col("l_partkey") % 400).alias("idx"),
        (F.col("l_discount") * 12).alias("cls"), (F.col("l_tax") * 12 - 0.1).alias("obj"),
        F.array(F.lit(0.5), F.lit(0.25), number / 4, F.lit(0.0)).alias("bbox"),
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i + number) / 8).alias("kps"))


ANCHORS = {
    "anchor": """
        SELECT l_orderkey AS image_id, l_partkey, l_linenumber, [8, 16, 32][l_suppkey % 3 + 1] AS stride,
          l_partkey % 400 AS idx, sqrt(least(1, greatest(0, l_discount * 12)) * least(1, greatest(0, l_tax * 12 - 0.1))) AS score
        FROM lineitem""",
}


@query("""SELECT id, least(640.0 / width, 640.0 / height, 1) AS scale,
            CAST(floor(width * least(640.0 / width, 640.0 / height, 1) + 0.5) AS BIGINT) AS width,
            CAST(floor(height * least(640.0 / width, 640.0 / height, 1) + 0.5) AS BIGINT) AS height FROM image_size""")
def letterbox_scale(lib: Library):
    fitted = lib.image_size.select("id", boxes.letterbox(F.col("width"), F.col("height")).alias("f"))
    return fitted.select("id", "f.scale", "f.width", "f.height")


@query("""
    SELECT image_id, idx, stride, round(score, 6) AS score,
      round((c + 0.5) * stride - exp(l_linenumber / 4) * stride / 2, 6) AS x,
      round((r + 0.25) * stride - stride / 2, 6) AS y,
      round(exp(l_linenumber / 4) * stride, 6) AS width, CAST(stride AS DOUBLE) AS height,
      ((2 + l_linenumber) / 8 + c) * stride AS left_eye_x, ((9 + l_linenumber) / 8 + r) * stride AS left_mouth_y
    FROM (SELECT *, idx // (640 // stride) AS r, idx % (640 // stride) AS c FROM anchor) WHERE score >= 0.6""", ANCHORS)
def decode_anchors(lib: Library):
    done = detect.decode_anchors(_anchors(lib))
    return done.select(
        "image_id", "idx", "stride", F.round("score", 6).alias("score"), F.round("x", 6).alias("x"),
        F.round("y", 6).alias("y"), F.round("width", 6).alias("width"), "height",
        F.element_at("landmarks", 3).alias("left_eye_x"), F.element_at("landmarks", 10).alias("left_mouth_y"))


@query("""
    SELECT image_id, box_id, best_id, round(CASE WHEN ix * iy = 0 THEN 0 ELSE ix * iy / (b.width * b.height + w * h - ix * iy) END, 6) AS iou FROM (
      SELECT b.*, t.b.box_id AS best_id, t.b.w AS w, t.b.h AS h,
        greatest(0, least(t.b.x + t.b.w, b.x + b.width) - greatest(t.b.x, b.x)) AS ix,
        greatest(0, least(t.b.y + t.b.h, b.y + b.height) - greatest(t.b.y, b.y)) AS iy
      FROM box b JOIN (SELECT image_id, min({'r': -score, 'box_id': box_id, 'x': x, 'y': y, 'w': width, 'h': height}) AS b
        FROM box GROUP BY ALL) t USING (image_id)) b""")
def iou(lib: Library):
    return detect.overlap_with_best(lib.box).withColumn("iou", F.round("iou", 6))


@query("""
    SELECT image_id, k.box_id AS box_id, -k.r AS score FROM (
      SELECT image_id, unnest(list_reduce(list_sort(list({'r': -score, 'box_id': box_id, 'x': x, 'y': y, 'w': width, 'h': height})),
        lambda kept, b: CASE WHEN len(list_filter(kept, lambda k:
            greatest(0, least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x)) * greatest(0, least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y))
            > 0.3 * (k.w * k.h + b.w * b.h - greatest(0, least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x)) * greatest(0, least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y))))) > 0
          THEN kept ELSE list_append(kept, b) END, [])) AS k FROM box GROUP BY image_id)""")
def nms(lib: Library):
    return detect.suppress_overlaps(lib.box).select("image_id", "box_id", "score")


@query("""
    SELECT image_id, box_id, round(b.x / s, 6) AS x, round(b.width / s, 6) AS width
    FROM (SELECT *, CASE WHEN image_id % 50 = 0 THEN 1 ELSE (image_id % 50) / 10 END AS s FROM box) b""")
def unscale_boxes(lib: Library):
    scaled = lib.box.withColumn("scale", (F.col("image_id") % 50) / 10)
    return detect.unscale_boxes(scaled).select(
        "image_id", "box_id", F.round("x", 6).alias("x"), F.round("width", 6).alias("width"))


@query("""SELECT image_id, box_id FROM box WHERE image_id IN (SELECT image_id FROM box GROUP BY 1 HAVING count(*) <= 5)""")
def drop_crowded(lib: Library):
    """At most 5 instead of 20 faces: no benchmark image has more than 7 boxes."""
    return detect.drop_crowded(lib.box, 5).select("image_id", "box_id")


@query("""
    SELECT image_id, box_id, CAST(l AS BIGINT) AS left, CAST(t AS BIGINT) AS top, CAST(r - l AS BIGINT) AS width, CAST(b - t AS BIGINT) AS height
    FROM (SELECT image_id, box_id, greatest(0, floor(x - width * 0.3 + 0.5)) AS l, greatest(0, floor(y - height * 0.3 + 0.5)) AS t,
        least(60, floor(x + width + width * 0.3 + 0.5)) AS r, least(40, floor(y + height + height * 0.3 + 0.5)) AS b FROM box)
    WHERE r > l AND b > t""")
def crop_box(lib: Library):
    box = F.struct("x", "y", "width", "height")
    crops = lib.box.select("image_id", "box_id", boxes.crop_box(box, F.lit(60), F.lit(40)).alias("c"))
    return crops.filter("c IS NOT NULL").select("image_id", "box_id", "c.*")


@query("""
    SELECT image_id, box_id, CAST(0 AS DOUBLE) AS a, round(-1.0 / box_id, 6) AS b,
      round(-1.0 * width / box_id, 6) AS tx, round(1.0 * width / box_id, 6) AS ty FROM box""")
def alignment_transform(lib: Library):
    """Undoes a quarter turn, a scale and a shift that were applied to the aligned points."""
    scale, shift = F.col("box_id").cast("double"), F.col("width")
    points = F.struct(*[
        F.struct((shift - scale * y).alias("x"), (scale * x + shift).alias("y")).alias(name)
        for name, (x, y) in zip(boxes.LANDMARKS, boxes.ALIGNED_POINTS)])
    fit = boxes.alignment_transform(F.col("p"), F.lit(2000), F.lit(1000))
    return lib.box.select("image_id", "box_id", points.alias("p")).select(
        "image_id", "box_id", fit.alias("f")
    ).select("image_id", "box_id", *[
        # adding zero turns -0.0 into 0.0
        (F.round(F.col(f"f.{c}"), 6) + F.lit(0.0)).alias(c) for c in ("a", "b", "tx", "ty")])


@query("""SELECT image_id, box_id, box_id <> 3 AND width <> 10 AS valid FROM box""")
def valid_landmarks(lib: Library):
    def point(name: str):
        x = F.when(F.lit(name != "noseTip") | (F.col("box_id") != 3), F.col("x"))
        y = F.when(F.lit(name == "leftEye") & (F.col("width") == 10), F.lit(float("nan"))).otherwise(F.col("y"))
        return F.struct(x.alias("x"), y.alias("y")).alias(name)

    return lib.box.select(
        "image_id", "box_id",
        boxes.valid_landmarks(F.struct(*[point(n) for n in boxes.LANDMARKS])).alias("valid"))
