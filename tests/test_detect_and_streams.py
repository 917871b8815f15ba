"""Detector post-processing, access rules, streams."""

import math
import os

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shutterlake.functions import boxes
from shutterlake.operators import access, detect, people, stats
from shutterlake.sources.media import media_file_stream
from shutterlake.streaming import flows

BOX = "image_id long, box_id long, x double, y double, width double, height double, score double"


def overlap(a, b):
    w = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
    h = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
    return 0 if w * h == 0 else w * h / (a[4] * a[5] + b[4] * b[5] - w * h)


def random_boxes(seed, count, images=2):
    rng = np.random.default_rng(seed)
    return [(int(i % images), i, *map(float, rng.uniform(0, 60, 2)), *map(float, rng.uniform(2, 40, 2)),
             float(np.round(rng.uniform(), 2))) for i in range(count)]


def greedy(data, threshold, top_k):
    kept = []
    for image in {b[0] for b in data}:
        mine = []
        for b in sorted((b for b in data if b[0] == image), key=lambda b: (-b[6], b[1])):
            if len(mine) < top_k and all(overlap(k, b) <= threshold for k in mine):
                mine.append(b)
        kept += [(b[0], b[1]) for b in mine]
    return sorted(kept)


@pytest.fixture
def batch_rows(spark, request):
    """Arrow batches of so many rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(request.param))
    yield request.param
    spark.conf.set(name, before)


@pytest.mark.parametrize("batch_rows", [10_000, 5, 1], indirect=True)
@pytest.mark.parametrize("top_k", [5000, 6, 1])
def test_suppression_equals_greedy(spark, batch_rows, top_k):
    data = random_boxes(1, 120) + [(5 + i, i, 0.0, 0.0, 1.0, 1.0, 0.5) for i in range(7)]
    df = spark.createDataFrame(data, BOX)
    got = rows(detect.suppress_overlaps(df, 0.3, top_k), "image_id", "box_id")
    assert got == greedy(data, 0.3, top_k)


@pytest.mark.parametrize("batch_rows", [10_000, 100], indirect=True)
def test_suppression_of_one_dense_image(spark, batch_rows):
    """Thousands of boxes on one spot: few are kept and pairs are never listed."""
    data = [(1, i, float(i % 3), 0.0, 50.0, 50.0, 1 - i / 5000) for i in range(4000)] + [(1, 9000, 500.0, 0.0, 5.0, 5.0, 0.0)]
    got = rows(detect.suppress_overlaps(spark.createDataFrame(data, BOX), 0.3), "box_id")
    assert got == [(0,), (9000,)]


@pytest.mark.parametrize("batch_rows", [1000], indirect=True)
def test_suppression_of_ten_thousand_boxes(spark, batch_rows):
    """Boxes in pairs, far from the next pair: the better of each stays, up to the limit."""
    data = [(1, i, 100.0 * (i // 2), 0.0, 50.0, 50.0, 1 - i / 20000) for i in range(10_000)]
    df = spark.createDataFrame(data, BOX)
    assert rows(detect.suppress_overlaps(df, 0.3), "box_id") == [(i,) for i in range(0, 10_000, 2)]
    assert rows(detect.suppress_overlaps(df, 0.3, 1500), "box_id") == [(i,) for i in range(0, 3000, 2)]


def test_suppression_of_odd_rows(spark):
    """Nothing in, nothing out; rows with a null go; empty and repeated boxes; other columns are left behind."""
    odd = [(1, 1, None, 0.0, 5.0, 5.0, 0.9), (None, 2, 0.0, 0.0, 5.0, 5.0, 0.9), (1, 3, 0.0, 0.0, 5.0, 5.0, None),
           (1, 4, 0.0, 0.0, 0.0, 0.0, 0.5), (1, 5, 0.0, 0.0, 5.0, 5.0, 0.4), (1, 5, 0.0, 0.0, 5.0, 5.0, 0.4)]
    df = spark.createDataFrame(odd, BOX)
    got = detect.suppress_overlaps(df.withColumn("label", F.lit("x")))
    assert got.columns == list(detect.BOX) and rows(got, "box_id") == [(4,), (5,)]
    assert detect.suppress_overlaps(df.limit(0)).count() == 0


def test_overlap_with_best(spark):
    data = [(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 5.0, 0.0, 10.0, 10.0, 0.5), (1, 3, 50.0, 0.0, 1.0, 1.0, 0.4)]
    got = rows(detect.overlap_with_best(spark.createDataFrame(data, BOX)), "box_id", "best_id", "iou")
    assert got == [(1, 1, 1.0), (2, 1, pytest.approx(1 / 3)), (3, 1, 0.0)]


def test_alignment_recovers_rotation_scale_and_shift(spark):
    angle, scale = math.radians(30), 2.5
    a, b = scale * math.cos(angle), scale * math.sin(angle)
    source = {}
    for name, (px, py) in zip(boxes.LANDMARKS, boxes.ALIGNED_POINTS):
        dx, dy = px - 7, py + 3          # p = R s + t, solved for s
        source[name] = ((a * dx + b * dy) / scale**2, (-b * dx + a * dy) / scale**2)
    points = F.struct(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")).alias(n) for n, (x, y) in source.items()])
    fit = spark.range(1).select(boxes.alignment_transform(points, F.lit(100), F.lit(100)).alias("f")).first()["f"]
    assert (fit["a"], fit["b"], fit["tx"], fit["ty"]) == pytest.approx((a, b, 7, -3))


def test_decode_threshold_and_letterbox(spark):
    df = spark.createDataFrame(
        [(1, 8, 81, 1.5, 0.49, [0.5, 0.5, 0.0, 0.0], [0.0] * 10), (1, 8, 0, 0.5, 0.5, [0.0] * 4, [0.0] * 10)],
        "image_id long, stride int, idx int, cls double, obj double, bbox array<double>, kps array<double>")
    row = detect.decode_anchors(df).collect()
    assert len(row) == 1 and row[0]["score"] == pytest.approx(0.7)
    assert (row[0]["x"], row[0]["y"], row[0]["landmarks"][:2]) == (8.0, 8.0, [8.0, 8.0])
    size = spark.range(1).select(boxes.letterbox(F.lit(1280), F.lit(721)).alias("s")).first()["s"]
    assert (size["scale"], size["width"], size["height"]) == (0.5, 640, 361)


def test_crowded_images_give_nothing(spark):
    data = [(1, i, 0.0, 0.0, 1.0, 1.0, 0.9) for i in range(21)] + [(2, i, 0.0, 0.0, 1.0, 1.0, 0.9) for i in range(20)]
    assert {r["image_id"] for r in detect.drop_crowded(spark.createDataFrame(data, BOX)).collect()} == {2}


def test_group_write_rules(spark):
    requests = spark.createDataFrame([(1, 7, True), (2, 7, False), (2, 8, False), (2, 7, True), (3, None, True)],
                                     "user_id long, group_id long, read_only boolean")
    grants = spark.createDataFrame([(1, 1, 1, 5), (2, 2, 1, 4)], "id long, user_id long, component_id long, level int")
    components = spark.createDataFrame([(1, "SysAdmin")], "id long, key string")
    members = spark.createDataFrame([(7, 2, False)], "user_group_id long, user_id long, is_admin boolean")
    got = rows(access.group_write_decision(requests, grants, components, members), "user_id", "group_id", "read_only", "allowed")
    assert got == [(1, 7, True, True), (2, 7, False, True), (2, 7, True, False), (2, 8, False, False), (3, None, True, True)]


def test_ratings_replace_and_refuse(spark):
    stored = spark.createDataFrame([(1, 1, 1, "2024-01-01", 2, "fine")],
                                   "id long, user_id long, item_id long, date string, rating int, comment string")
    batch = spark.createDataFrame([(1, 1, 5, "2024-02-01", 1), (1, 2, 0, "2024-02-01", 2), (2, 1, 3, "2024-02-01", 3)],
                                  "user_id long, item_id long, rating int, date string, seq long")
    done, refused = people.apply_ratings(stored, batch)
    assert rows(done, "id", "user_id", "item_id", "rating", "comment") == [(1, 1, 1, 5, None), (2, 2, 1, 3, None)]
    assert rows(refused, "user_id", "item_id") == [(1, 2)]


def test_reindex_roots(spark):
    df = spark.createDataFrame([("/a/b",), ("/a/c",), ("/top",), ("/",)], "dir string")
    assert rows(stats.reindex_roots(df)) == [("/",), ("/a",)]


EVENT = "user_id long, ts timestamp_ntz"


def write_events(spark, path, stamps):
    values = ", ".join(f"({u}, timestamp_ntz'{t}')" for u, t in stamps)
    spark.sql(f"SELECT CAST(u AS BIGINT) AS user_id, t AS ts FROM VALUES {values} AS v(u, t)").coalesce(1).write.parquet(path)


def run_activity(spark, base):
    stream = spark.readStream.schema(EVENT).parquet(f"{base}/in/*")
    flows.stream_activity(stream, f"{base}/out", f"{base}/cp", once=True).awaitTermination()
    return rows(flows.stream_activity_state(spark.read.parquet(f"{base}/out")))


def test_activity_adds_up_over_flushes_and_days(spark, tmp_path):
    base = str(tmp_path)
    write_events(spark, f"{base}/in/a", [(1, "2024-01-01 10:05:01"), (1, "2024-01-01 10:05:30"), (2, "2024-01-01 10:05:40")])
    assert run_activity(spark, base) == [(1, 10, 5, 2), (2, 10, 5, 1)]
    write_events(spark, f"{base}/in/b", [(1, "2024-01-01 10:05:50"), (1, "2024-01-02 10:05:00")])
    assert run_activity(spark, base) == [(1, 10, 5, 4), (2, 10, 5, 1)]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    write = flows._keep_batch(str(tmp_path / "out"))
    batch = spark.createDataFrame([(1, "2024-01-01 10:05:00", 3)], "user_id long, w string, count long").select(
        "user_id", F.col("w").cast("timestamp").alias("window_start"), "count")
    write(batch, 0)
    write(batch, 0)
    assert rows(flows.stream_activity_state(spark.read.parquet(str(tmp_path / "out")))) == [(1, 10, 5, 3)]


def test_ingest_sees_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    os.makedirs(source / "sub")
    (source / "a.jpg").write_bytes(b"one")
    (source / "sub" / "skip.txt").write_bytes(b"no")
    seen = []

    def run():
        flows.stream_ingest(
            media_file_stream(spark, str(source)),
            lambda batch, _: seen.extend(r["name"] for r in batch.collect()), str(tmp_path / "cp"), once=True,
        ).awaitTermination()

    run()
    (source / "sub" / "b.mp4").write_bytes(b"two")
    run()
    assert seen == ["a", "b"]


def test_change_messages(spark):
    df = spark.createDataFrame(
        [("create", "mediaItem", 5, None, None, None, None), ("progress", "fileIndex", None, None, "indexing", 3, 9),
         ("progress", "fileIndex", None, None, None, None, None)],
        "action string, source string, id long, user_id long, phase string, processed long, total long")
    message = stats.change_message(*[F.col(c) for c in df.columns])
    assert [r[0] for r in df.select(message).collect()] == [
        "create,mediaItem,5,", "progress,fileIndex,indexing:3/9,", "progress,fileIndex,:0/0,"]
