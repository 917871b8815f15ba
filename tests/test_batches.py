"""Work done in pieces ends like work done at once."""

import random

import pytest
from pyspark.sql import functions as F

from shutterlake.operators import access, facegraph, graph, people
from shutterlake.operators.neardup import hash_groups
from shutterlake.plans.indexing import index_listing, remove_orphans
from shutterlake.sources.tables import TableStore, log_rows, read_table
from shutterlake.streaming import flows
from shutterlake.streaming.matching import HashPool, face_pairs_for_batch

from conftest import rows


def test_late_activity_counts(spark, tmp_path):
    stamps = ["2024-01-01 10:05:01", "2024-01-01 12:00:00", "2024-01-01 10:05:30"]
    source = str(tmp_path / "in")
    for stamp in stamps:
        spark.sql(f"SELECT CAST(1 AS BIGINT) AS user_id, timestamp'{stamp}' AS ts").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    flows.stream_activity(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = rows(flows.stream_activity_state(spark.read.parquet(str(tmp_path / "out"))))
    assert got == [(1, 10, 5, 2), (1, 12, 0, 1)]


LISTING = "dir string, name string, extension string, size long, hash string"


@pytest.mark.parametrize("pieces", [[0, 1, 2, 3], [3, 2, 1, 0]])
def test_index_in_pieces_equals_index_at_once(spark, tmp_path, pieces):
    files = [("/p/a", "IMG_0001", "heic", 9, "h1"), ("/p/a", "IMG_0001", "jpg", 8, "h2"),
             ("/p/a", "IMG_0002", "mov", 7, "h3"), ("/p/b", "IMG_0001", "jpg", 6, "h4")]
    whole, parts = TableStore(spark, str(tmp_path / "whole")), TableStore(spark, str(tmp_path / "parts"))
    index_listing(whole, spark.createDataFrame(files, LISTING), "/p")
    for i in pieces:
        index_listing(parts, spark.createDataFrame([files[i]], LISTING), "/p")
    index_listing(parts, spark.createDataFrame([files[pieces[0]]], LISTING), "/p")

    def state(store):
        names = store.read("file").join(store.read("path").select(F.col("id").alias("path_id"), "dir"), "path_id")
        links = store.read("media_item_file").select("media_item_id", F.col("file_id").alias("id"), "is_primary")
        items = store.read("media_item").select(F.col("id").alias("media_item_id"), F.col("name").alias("item"), F.col("type").alias("kind"))
        return rows(names.join(links, "id").join(items, "media_item_id"), "dir", "name", "extension", "hash", "is_primary", "item", "kind")

    assert state(parts) == state(whole) and whole.read("media_item").count() == 3


def test_matches_with_earlier_arrivals(spark, tmp_path):
    source = str(tmp_path / "in")
    for i, v in enumerate([[1.0, 0.0], [0.99, 0.1], [0.0, 1.0], [1.0, 0.0]]):
        spark.createDataFrame([(i, v)], "id long, embedding array<float>").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(source)
    match = lambda batch, known: face_pairs_for_batch(batch, known, 0.9)
    flows.stream_match(stream, match, str(tmp_path / "out"), str(tmp_path / "pool"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "feature_id", "matching_feature_id")
    assert got == [(0, 1), (0, 3), (1, 3)]


def test_hash_pool_over_batches_and_a_replay(spark, tmp_path):
    rng = random.Random(4)
    seen = [rng.getrandbits(64) for _ in range(12)]
    flip = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(64), n))
    values = seen + [flip(rng.choice(seen), rng.randrange(12)) for _ in range(150)] + seen[:5]
    items = [(i, f"{h:064b}") for i, h in enumerate(values)] + [(900, None), (901, "")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, hash string")
    batches = [items[60:100], items[100:130], items[60:70] + items[130:]]  # ids come again
    pool = HashPool(spark, str(tmp_path / "index"), 10)
    pool.build(frame(items[:60]))
    pool.build(frame([(1, "1" * 64)]))  # built before
    found = [rows(pool.match(frame(b), n)) for n, b in enumerate(batches)]
    assert rows(pool.match(frame(batches[1]), 1)) == found[1]  # a replay
    by_id = dict(items)
    distance = lambda a, b: (int(a, 2) ^ int(b, 2)).bit_count()
    links = [r for part in found for r in part]
    assert all(a < b and d == distance(by_id[a], by_id[b]) <= 10 for a, b, d in links)
    old = {h for _, h in items[:60]}
    new = {h for _, h in items[60:] if h} - old
    between = [(min(x, y), max(x, y)) for x, y in ((by_id[a], by_id[b]) for a, b, _ in links) if x != y]
    assert len(between) == len(set(between))
    assert set(between) == {(min(x, y), max(x, y)) for x in new for y in new | old if x != y and distance(x, y) <= 10}
    first = {}
    for i, h in reversed(items[:60]):
        first[h] = i
    for b in batches:
        fresh = {h: min(i for i, x in b if x == h) for _, h in b if h and h not in first}
        first |= fresh
    assert {(a, b) for a, b, d in links if d == 0} == {
        (min(i, first[h]), max(i, first[h])) for i, h in items[60:] if h and i != first[h]}


def test_hash_pool_reads_touched_buckets_only(spark, tmp_path):
    rng = random.Random(6)
    pool = HashPool(spark, str(tmp_path / "index"), 4)
    pool.build(spark.createDataFrame([(i, f"{rng.getrandbits(64):064b}") for i in range(3000)], "id long, hash string"))
    one = hash_groups(spark.createDataFrame([(9000, "01" * 32)], "id long, hash string"))
    touched = pool.touched(one)
    assert len(touched) == 4 * 7
    known = pool.known(0, touched)
    assert {f.split("bucket=")[1].split("/")[0] for f in
            (r[0] for r in known.select(F.input_file_name()).distinct().collect())} <= {str(b) for b in touched}
    assert 0 < known.count() < 4 * 3000 * len(touched) / 256 * 1.3
    with pytest.raises(ValueError, match="below 16"):
        HashPool(spark, str(tmp_path), 16)


def test_item_match_stream_stores_pairs_once(spark, tmp_path):
    base = "0" * 64
    near, far = "1" + base[1:], "1" * 64
    source = str(tmp_path / "in")
    for part in ([(5, near)], [(2, base), (7, far)], [(5, near), (9, None)], [(8, base)]):
        spark.createDataFrame(part, "id long, hash string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long, hash string").option("maxFilesPerTrigger", 1).parquet(source)
    flows.stream_item_match(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True,
                            catalogued=spark.createDataFrame([(6, base)], "id long, hash string")).awaitTermination()
    assert rows(flows.stored_matches(spark, str(tmp_path / "out"))) == [(2, 6, 0), (5, 6, 1), (6, 8, 0)]


def test_merge_chain_and_cycle(spark):
    merges = spark.createDataFrame([(1, 2), (2, 3), (5, 3)], "source_id long, target_id long")
    assert rows(people.final_targets(merges)) == [(1, 3), (2, 3), (5, 3)]
    faces = spark.createDataFrame([(1, 1, 10), (2, 3, 11)], "id long, person_id long, feature_id long")
    names = spark.createDataFrame([(1, 1, "A", True), (2, 3, "C", True)], "id long, person_id long, name string, preferred boolean")
    persons = spark.createDataFrame([(1,), (2,), (3,), (5,)], "id long")
    out, report = people.merge_people({"person": persons, "person_name": names, "person_feature": faces}, merges)
    assert rows(out["person_feature"], "person_id", "feature_id") == [(3, 10), (3, 11)]
    assert rows(out["person_name"], "person_id", "name", "preferred") == [(3, "A", False), (3, "C", True)]
    assert rows(out["person"]) == [(3,)] and rows(report) == [(3, 1, 1)]
    with pytest.raises(ValueError, match="cycle"):
        people.final_targets(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "source_id long, target_id long"))


def test_last_admins_lowered_together(spark):
    held = spark.createDataFrame([(1, 7, 5), (2, 7, 5), (3, 7, 1), (4, 8, 5), (5, 8, 6), (6, 9, 1)],
                                 "user_id long, component_id long, level int")
    changes = spark.createDataFrame([(1, 7, 1), (2, 7, None), (3, 7, 0), (4, 8, 1), (6, 9, 0)], held.schema)
    assert rows(access.last_admin_violations(changes, held), "user_id", "component_id") == [(2, 7), (6, 9)]


def test_one_media_log(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    change = lambda item: log_rows(spark.createDataFrame([(item, "update")], "item_id long, action string"))
    assert not store.has("media_log")
    store.append_log(change(1))
    store.append_log(change(2), "s-0")
    store.append_log(change(2), "s-0")
    assert store.has("media_log") and rows(read_table(spark, store.root, "media_log"), "item_id") == [(1,), (2,)]
    store.write("media_log", store.read("media_log").filter("item_id = 2"))
    store.append_log(change(2), "s-0")  # a replay after the rewrite
    store.append_log(change(3))
    assert rows(store.read("media_log"), "item_id") == [(2,), (3,)]


def test_orphans_leave_no_child_rows(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    listing = spark.createDataFrame([("/p/a", "IMG_1", "jpg", 9, "h1"), ("/p/a", "IMG_2", "jpg", 9, "h2")], LISTING)
    index_listing(store, listing, "/p")
    gone = store.read("media_item").filter("name LIKE '%1'").first()["id"]
    store.write("place_media", spark.createDataFrame([(1, 1, gone)], "id long, place_id long, media_id long"))
    store.append_log(log_rows(spark.createDataFrame([(gone, "create"), (gone + 1, "create")], "item_id long, action string")))
    remove_orphans(store, spark.createDataFrame([("/p/a/IMG_2.jpg",)], "path string"))
    assert store.read("place_media").count() == 0
    assert gone not in [r["item_id"] for r in store.read("media_log").collect()]
    assert gone not in [r["item_id"] for r in store.read("folder_entry").collect()]


def test_copies_cost_no_hop(spark):
    line = [[1.0, 0.0], [0.9, 0.436], [0.62, 0.785], [0.215, 0.977]]
    faces = [(i, i, v) for i, v in enumerate(line)] + [(10 + i, 10 + i, v) for i, v in enumerate(line)]
    df = spark.createDataFrame(faces, "id long, item_id long, embedding array<float>")
    edges = facegraph.similarity_join(df, 0.85)
    start = df.filter("id = 10").select("id")
    assert rows(facegraph.transitive_matches(edges, df, start, depth=2), "source", "feature_id") == [
        (10, 0), (10, 1), (10, 2), (10, 11), (10, 12)]
    assert rows(graph.reachable(edges.filter("false"), start, 3, "feature_id", "matching_feature_id")) == []
