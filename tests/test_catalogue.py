"""Files, tables, folders, indexing, metadata."""

import hashlib
import os
import shutil
import struct
import zlib
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shutterlake.functions import files as names
from shutterlake.functions import scalars, tags
from shutterlake.operators import browse, catalogue, keyed, maintain, metadata, moveplan
from shutterlake.operators.neardup import phash
from shutterlake.plans.dedupe import deduplicate_store
from shutterlake.plans.indexing import index_listing, remove_orphans
from shutterlake.sources.media import add_file_checksum, describe_files, image_pixels, media_file_scan, walk_files
from shutterlake.sources.tables import TableStore

LISTING = "dir string, name string, extension string, size long, hash string"


def png(path, width, height, shade):
    """A grey PNG file."""
    raw = b"".join(b"\0" + bytes(min(255, shade + x) for x in range(width)) for _ in range(height))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
                  + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "photos"
    png(str(root / "vacation/beach.png"), 40, 30, 10)
    png(str(root / "vacation/sunset.png"), 40, 30, 10)
    png(str(root / "family/portrait.png"), 20, 20, 90)
    png(str(root / ".hidden/no.png"), 8, 8, 0)
    png(str(root / "_tmp/no.png"), 8, 8, 0)
    (root / "family/notes.txt").write_text("not media")
    return str(root)


def test_scan_skips_hidden_folders(spark, tree):
    every = media_file_scan(spark, tree)
    assert rows(every, "name", "extension", "type") == [
        ("beach", "png", "image"), ("notes", "txt", "other"), ("portrait", "png", "image"), ("sunset", "png", "image")]
    media = media_file_scan(spark, tree, media_only=True, checksum="sha1")
    assert media.count() == 3 and all(len(r["hash"]) == 40 for r in media.collect())


def test_image_pixels_and_hash(spark, tree):
    pixels = image_pixels(spark, f"{tree}/vacation")
    assert rows(pixels, "width", "height", "channels") == [(40, 30, 1), (40, 30, 1)]
    hashes = phash(pixels.withColumnRenamed("path", "id"))
    assert len({r["hash"] for r in hashes.collect()}) == 1


def test_listing_does_not_read_content(spark, tree):
    plan = media_file_scan(spark, tree)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


@pytest.mark.parametrize("algorithm", ["md5", "sha1"])
def test_checksums_of_a_tree(spark, tree, algorithm):
    """In chunks and from Spark's cells alike, whatever the names; two equal trees have equal sums."""
    Path(tree, "family", "a b%20c+#.png").write_bytes(b"x" * 5_000_000)
    shutil.copytree(tree, f"{tree}-copy")
    want = {str(p): hashlib.new(algorithm, p.read_bytes()).hexdigest()
            for p in Path(tree).rglob("*") if p.is_file() and "hidden" not in str(p) and "_tmp" not in str(p)}
    scan = media_file_scan(spark, tree, checksum=algorithm)
    assert {r["path"]: r["hash"] for r in scan.collect()} == want
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(tree)
    assert rows(describe_files(raw, checksum=algorithm)) == rows(scan)
    copy = media_file_scan(spark, f"{tree}-copy", checksum=algorithm)
    assert rows(copy, "name", "hash") == rows(scan, "name", "hash")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_walk_lists_what_the_scan_does_and_more(spark, tree):
    """Folders at several depths; empty files and files that start with . or _ are listed, links are not."""
    Path(tree, "vacation", "a", "b c").mkdir(parents=True)
    Path(tree, "vacation", "a", "b c", "deep.jpg").write_bytes(b"deep")
    Path(tree, "family", "nobody").mkdir()
    columns = ["path", "dir", "name", "extension", "size", "type", "hash"]
    scan = rows(media_file_scan(spark, tree, checksum="md5"), *columns)
    walked = walk_files(spark, f"file://{tree}", checksum="md5")
    assert walked.columns == media_file_scan(spark, tree, checksum="md5").columns
    assert rows(walked, *columns) == scan and len(scan) == 5
    Path(tree, "family", "empty.jpg").write_bytes(b"")
    Path(tree, "family", "_own.jpg").write_bytes(b"1")
    Path(tree, "family", "link.jpg").symlink_to(Path(tree, "family", "_own.jpg"))
    Path(tree, "family", "loop").symlink_to(tree)
    more = {r["path"] for r in walk_files(spark, tree + "/").collect()} - {r[0] for r in scan}
    assert more == {f"{tree}/family/empty.jpg", f"{tree}/family/_own.jpg"}
    assert walk_files(spark, f"{tree}/family/nobody").count() == walk_files(spark, f"{tree}/gone").count() == 0
    with pytest.raises(ValueError):
        walk_files(spark, "hdfs://host/photos")


def test_checksum_of_a_file_above_two_gigabytes(spark, tmp_path):
    """One that no cell could hold; the file is sparse."""
    size = (1 << 31) + 5
    with open(tmp_path / "film.mp4", "wb") as film:
        film.truncate(size)
    digest, block = hashlib.sha1(), bytes(1 << 24)
    for start in range(0, size, len(block)):
        digest.update(block[:size - start])
    row = media_file_scan(spark, str(tmp_path), media_only=True, checksum="sha1").first()
    assert (row["size"], row["hash"]) == (size, digest.hexdigest())


def test_checksum_without_a_file(spark, tmp_path):
    (tmp_path / "here.jpg").write_bytes(b"here")
    (tmp_path / "empty.jpg").write_bytes(b"")
    paths = [str(tmp_path / f"{name}.jpg") for name in ("here", "empty", "gone")]
    files = spark.createDataFrame([(p,) for p in [*paths, None]], "path string")
    sums = {r["path"]: r["hash"] for r in add_file_checksum(files).collect()}
    assert sums == {paths[0]: hashlib.md5(b"here").hexdigest(), paths[1]: hashlib.md5().hexdigest(),
                    paths[2]: None, None: None}
    assert add_file_checksum(files.limit(0)).count() == 0
    with pytest.raises(ValueError):
        add_file_checksum(files, "crc")


def group(spark, *files):
    data = [("/d", n, e, s, "h") for n, e, s in files]
    return {(r["name"], r["extension"]) for r in
            catalogue.pick_primary(spark.createDataFrame(data, LISTING)).filter("is_primary").collect()}


MIB = 1024 * 1024


@pytest.mark.parametrize("files,primary", [
    ([("IMG_1", "jpg", 5)], ("IMG_1", "jpg")),
    ([("IMG_1", "JPG", 5), ("IMG_1", "HEIC", 5)], ("IMG_1", "HEIC")),
    ([("IMG_1", "jpg", 5), ("IMG_1", "png", 5)], ("IMG_1", "png")),
    ([("IMG_1", "jpg", 5), ("IMG_1", "mov", 2 * MIB), ("IMG_1", "aae", 1)], ("IMG_1", "jpg")),
    ([("IMG_1", "jpg", 5), ("IMG_1", "mov", 6 * MIB)], ("IMG_1", "mov")),
    ([("IMG_1", "aae", 1), ("IMG_1", "mov", 10)], ("IMG_1", "aae")),
    ([("IMG_0001", "jpg", 5), ("IMG_E0001", "heic", 5)], ("IMG_E0001", "heic")),
])
def test_primary_choice(spark, files, primary):
    assert group(spark, *files) == {primary}


def test_edited_shots_group_with_originals(spark):
    df = spark.createDataFrame([("IMG_E0001",), ("IMG_EX1",), ("IMG_0001",)], "n string")
    assert [r[0] for r in df.select(names.group_name(F.col("n"))).collect()] == ["IMG_0001", "IMG_EX1", "IMG_0001"]


def test_index_twice_then_remove_orphans(spark, tree, tmp_path):
    store = TableStore(spark, str(tmp_path / "tables"))
    scan = media_file_scan(spark, tree, media_only=True, checksum="md5")
    index_listing(store, scan, tree)
    first = {n: rows(store.read(n)) for n in ("file", "media_item", "media_item_file", "folder", "folder_entry")}
    assert len(first["media_item"]) == 3 and len(first["folder_entry"]) == 3
    assert {r["path"] for r in browse.folder_full_path(store.read("folder")).collect()} == {
        "photos", "photos/vacation", "photos/family"}
    index_listing(store, scan, tree)
    assert first == {n: rows(store.read(n)) for n in first}
    left = scan.filter("name <> 'portrait'")
    removed = remove_orphans(store, left)
    assert removed == {"file": 1, "media_item": 1, "path": 1, "folder": 1}
    assert sorted(r["name"] for r in store.read("media_item").collect()) == ["beach", "sunset"]


def test_deduplicate_store(spark, tree, tmp_path):
    store = TableStore(spark, str(tmp_path / "tables"))
    index_listing(store, media_file_scan(spark, tree, media_only=True, checksum="md5"), tree)
    report = deduplicate_store(store)
    assert rows(report) == [(1, 1, 1)]
    assert store.read("media_item").count() == 2 and store.read("media_item_file").count() == 3


def test_store_ignores_unfinished_versions(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write("keyword", spark.createDataFrame([(1, "a")], "id long, word string"))
    os.makedirs(tmp_path / "keyword" / "v=2")
    assert rows(store.read("keyword")) == [(1, "a")]
    assert store.read("place").count() == 0


def test_numbering_is_dense_and_order_safe(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    got = [r["n"] for r in keyed.dense_number(df, ["k"], "n").collect()]
    assert sorted(got) == list(range(1, 5001))
    inside = spark.range(3000).select((F.col("id") % 2).alias("g"), "id")
    numbered = keyed.number_within(inside, ["g"], "id", [], "n", span=100)
    assert numbered.filter(F.col("n") != F.floor(F.col("id") / 2) + 1).count() == 0
    placed = catalogue.ordinals(inside, ["g", "id"], "at")
    assert placed.filter(F.col("at") != F.col("g") * 1500 + F.floor(F.col("id") / 2)).count() == 0


def test_upsert_modes(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, v string, w string")
    update = spark.createDataFrame([(2, None, "y"), (3, "c", None)], "id long, v string, w string")
    assert rows(keyed.upsert(target, update, ["id"])) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]
    assert rows(keyed.upsert(target, update, ["id"], overwrite=True)) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]
    assert rows(keyed.upsert(target, update, ["id"], mode="ignore")) == [(1, "a", "x"), (2, "b", None), (3, "c", None)]


def test_cascade_reaches_grandchildren(spark):
    t = {
        "media_item": spark.createDataFrame([(1,), (2,)], "id long"),
        "feature": spark.createDataFrame([(10, 1), (20, 2)], "id long, item_id long"),
        "person_feature": spark.createDataFrame([(100, 10, 5), (200, 20, 5)], "id long, feature_id long, person_id long"),
    }
    out = keyed.cascade_delete(t, "media_item", spark.createDataFrame([(1,)], "id long"))
    assert rows(out["person_feature"], "id") == [(200,)] and rows(out["feature"], "id") == [(20,)]


def test_search_fixture(spark):
    items = spark.createDataFrame(
        [(1, "sunset_beach", "image", "2025-06-01"), (2, "mountain_hike", "image", "2025-07-15"),
         (3, "city_tour", "video", "2025-08-20"), (4, "forest_walk", "image", "2025-09-10T08:00:00")],
        "id long, name string, type string, start_date string")
    words = spark.createDataFrame([(1, "nature"), (2, "urban")], "id long, word string")
    links = spark.createDataFrame([(1, 1), (2, 1), (4, 1), (3, 2)], "media_item_id long, keyword_id long")

    def found(**kw):
        return [r[0] for r in rows(browse.search_media(items, keywords=words, tags=links, **kw), "id")]

    assert found(q="MOUNTAIN") == [2]
    assert found(q="c_ty") == [3]
    assert found(q="xyz") == []
    assert found(keyword=" Nature ") == [1, 2, 4]
    assert found(keyword="unknown") == []
    assert found(media_type="video") == [3]
    assert found(date_from="2025-07-01", date_to="2025-09-10") == [2, 3]
    assert found(keyword="nature", media_type="image", date_to="2025-06-30") == [1]


def test_search_filters_reach_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("name"), F.col("source").alias("type"),
        F.col("lang").alias("start_date"))
    plan = browse.search_media(docs, media_type="src1", date_from="a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src1)" in plan and "GreaterThanOrEqual(lang,a)" in plan and "text" not in plan


def test_prune_and_browse_folders(spark):
    folders = spark.createDataFrame(
        [(1, "Photos", None), (2, "2023", 1), (3, "2024", 1), (4, "empty", 1), (5, "deeper", 4)],
        "id long, name string, parent_id long")
    entries = spark.createDataFrame([(1, 2, 10, 0), (2, 3, 11, 0), (3, 3, 12, 1)],
                                    "id long, folder_id long, item_id long, index long")
    assert rows(catalogue.prune_empty_folders(folders, entries), "id") == [(4,), (5,)]
    assert rows(browse.items_below(folders, entries, spark.createDataFrame([(1,)], "id long"))) == [(1, 10), (1, 11), (1, 12)]
    wanted = spark.createDataFrame([("Photos/2024",), ("2024",), ("/Photos/",)], "path string")
    assert rows(browse.resolve_folder_paths(folders, wanted), "id") == [(1,), (3,)]


def test_folder_cycle_is_an_error(spark):
    loop = spark.createDataFrame([(1, "a", 2), (2, "b", 1)], "id long, name string, parent_id long")
    import shutterlake.operators.graph as graph

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(graph, "MAX_ROUNDS", 4)
        with pytest.raises(RuntimeError, match="cycle"):
            graph.folder_chains(loop)


def test_duplicate_signals_overlap(spark):
    items = spark.createDataFrame([(1, "h"), (2, "h"), (3, None), (4, ""), (5, ""), (6, None)], "id long, hash string")
    files = spark.createDataFrame([(1, "m"), (2, "m"), (3, "")], "id long, hash string")
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "media_item_id long, file_id long")
    matches = spark.createDataFrame(
        [(3, 6, (0,), False), (4, 5, (3,), False), (4, 5, (0,), True)],
        "media_item_id long, matching_item_id long, match_info struct<hamming_distance:int>, ignore_match boolean")
    groups = maintain.duplicate_groups(
        maintain.duplicate_pairs_by_hash(items), maintain.duplicate_pairs_by_checksum(files, links),
        maintain.duplicate_pairs_by_match(matches))
    assert rows(groups) == [(1, 1), (1, 2), (1, 3), (1, 6)]


def test_ratings_merge_keeps_the_keepers(spark):
    ratings = spark.createDataFrame([(1, 7, 1, 5), (2, 7, 2, 3), (3, 8, 3, 2), (4, 8, 2, 4)],
                                    "id long, user_id long, item_id long, rating int")
    remap = spark.createDataFrame([(2, 1), (3, 1)], "item_id long, keeper long")
    assert rows(maintain.merge_ratings(ratings, remap)) == [(1, 7, 1, 5), (4, 8, 1, 4)]


@pytest.mark.parametrize("seconds,text", [(2.0, "2s"), (1.5, "1.5s"), (0.004, "1/250s"), (None, None)])
def test_shutter_text(spark, seconds, text):
    df = spark.createDataFrame([(seconds,)], "s double")
    assert df.select(tags.shutter_text(F.col("s"))).first()[0] == text


@pytest.mark.parametrize("rate,value", [("30000/1001", 29.97), ("30/1", 30.0), ("25", 25.0), ("0/0", None), ("x", None), (None, None)])
def test_frame_rate(spark, rate, value):
    assert spark.createDataFrame([(rate,)], "r string").select(tags.frame_rate(F.col("r"))).first()[0] == value


def test_tag_blocks_and_missing_parts(spark):
    df = spark.createDataFrame(
        [({"Make": "A", "ISO": "NaN"}, {"Make": " B ", "Keywords": '["x",1,"y"]', "latitude": "1.5"})],
        "b0 map<string,string>, b1 map<string,string>")
    row = metadata.normalise_image_tags(metadata.merge_tag_blocks(df, ["b0", "b1"])).first()
    assert row["camera"]["make"] == "B" and row["exposure"]["iso"] is None
    assert row["iptc"]["keywords"] == ["x", "y"] and row["gps"] is None and row["wkt"] is None


def test_rounding_and_date_stem(spark):
    df = spark.createDataFrame([(-2.5, "2024-06-15T14:30:00.123Z"), (2.5, "2024-06-15")], "v double, d string")
    assert [r[0] for r in df.select(scalars.round_half_up(F.col("v"))).collect()] == [-2.0, 3.0]
    assert [r[0] for r in df.select(scalars.date_stem(F.col("d"))).collect()] == ["20240615_143000", "20240615"]


def test_unique_names_ignore_case(spark):
    df = spark.createDataFrame(
        [(1, 1, "jpg", 1, "IMG_a"), (2, 2, "JPG", 1, "IMG_A"), (3, 3, "png", 1, "IMG_a"), (3, 4, "jpg", 1, "IMG_a")],
        "item_id long, file_id long, extension string, path_id long, stem string")
    got = dict(rows(moveplan.unique_names(df), "file_id", "new_name"))
    assert got == {1: "IMG_a", 2: "IMG_A(2)", 3: "IMG_a", 4: "IMG_a(3)"}
