"""Hashes, near-duplicates, embeddings, match graph against brute force."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shutterlake.functions import hashing, vectors
from shutterlake.operators import facegraph, graph, neardup, tiles
from shutterlake.streaming.matching import face_pairs_for_batch


def bits(value):
    return format(value & (2**64 - 1), "064b")


def distance(a, b):
    return sum(x != y for x, y in zip(a, b))


def star_pairs(items, close):
    """Brute force in the folded form: distinct values pairwise, copies linked to the lowest id."""
    lowest = {}
    for id_, value in sorted(items):
        lowest.setdefault(value, id_)
    out = {(lowest[v], i) for i, v in items if i != lowest[v]}
    reps = sorted((i, v) for v, i in lowest.items())
    for n, (i, a) in enumerate(reps):
        for j, b in reps[n + 1:]:
            if close(a, b):
                out.add((i, j))
    return sorted(out)


def hash_fixture(rng, count):
    centre = int(rng.integers(0, 2**63))
    out = []
    for i in range(count):
        value = centre if i % 2 else int(rng.integers(0, 2**63))
        for bit in rng.choice(64, size=rng.integers(0, 12), replace=False):
            value ^= 1 << int(bit)
        out.append((i, bits(value)))
    return out + [(count + n, out[3][1]) for n in range(20)]


def test_hamming_known_pairs(spark):
    zero = "0" * 64
    df = spark.createDataFrame(
        [(zero, "1" * 5 + "0" * 59), (zero, "1" * 20 + "0" * 44), (zero, "1" * 64), (zero, zero)],
        "a string, b string")
    assert [r[0] for r in df.select(hashing.hamming(F.col("a"), F.col("b"))).collect()] == [5, 20, 64, 0]


def test_hamming_unequal_length_fails(spark):
    df = spark.createDataFrame([("0101", "01")], "a string, b string")
    with pytest.raises(Exception, match="length"):
        df.select(hashing.hamming(F.col("a"), F.col("b"))).collect()


@pytest.mark.parametrize("threshold", [0, 3, 10, 15, 18])
@pytest.mark.parametrize("busy", [4096, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, threshold, busy):
    """busy=3 sends most buckets through the block-wise path."""
    monkeypatch.setattr(neardup, "BUSY_BUCKET", busy)
    monkeypatch.setattr(neardup, "tile_count", lambda df: 3)
    items = hash_fixture(np.random.default_rng(threshold), 120)
    df = spark.createDataFrame([*items, (900, None), (901, "")], "id long, hash string")
    found = neardup.near_duplicate_join(df, threshold)
    got = rows(found, "media_item_id", "matching_item_id")
    assert got == star_pairs(items, lambda a, b: distance(a, b) <= threshold)
    by_id = dict(items)
    for a, b, d in rows(found):
        assert distance(by_id[a], by_id[b]) == d


def test_listed_bands_are_never_broadcast(spark):
    """Rows that a hash is exploded into meet in a shuffle, and both sides share the radius."""
    df = spark.createDataFrame(hash_fixture(np.random.default_rng(2), 50), "id long, hash string")
    groups = neardup.hash_groups(df).select("rep", "h")
    joined = neardup.band_join(groups, 10)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    against = neardup.band_join(groups, 10, against=neardup.hash_bands(groups))
    assert "BroadcastHashJoin" not in against._jdf.queryExecution().executedPlan().toString()
    assert neardup._listed(neardup.hash_bands(groups), 1).count() == 68 * groups.count()


@pytest.mark.parametrize("threshold", [10, 18])
def test_new_items_against_pool(spark, threshold):
    items = sorted({v: i for i, v in hash_fixture(np.random.default_rng(5), 100)[:100]}.items(), key=lambda x: x[1])
    items = [(i, v) for v, i in items]
    df = spark.createDataFrame(items, "id long, hash string")
    new = df.filter("id >= 60 AND id < 100")
    found = rows(neardup.near_duplicates_between(new, df.filter("id < 60"), threshold),
                 "media_item_id", "matching_item_id")
    every = star_pairs(items, lambda a, b: distance(a, b) <= threshold)
    assert found == [p for p in every if p[1] >= 60 or p[0] >= 60]


def test_near_duplicates_of_spells_out_copies(spark):
    h = ["0" * 64, "1" + "0" * 63, "1" * 64]
    items = [(1, h[0]), (2, h[0]), (3, h[1]), (4, h[1]), (5, h[2])]
    df = spark.createDataFrame(items, "id long, hash string")
    wanted = spark.createDataFrame([(2,)], "id long")
    assert rows(neardup.near_duplicates_of(df, wanted, 10)) == [(2, 1, 0), (2, 3, 1), (2, 4, 1)]


def test_canonical_insert_skips_either_direction(spark):
    existing = spark.createDataFrame([(5, 2)], "media_item_id long, matching_item_id long")
    found = spark.createDataFrame([(2, 5, 1), (9, 4, 2), (4, 9, 2)],
                                  "media_item_id long, matching_item_id long, hamming_distance int")
    fresh = neardup.canonical_match_insert(existing, found, "media_item_id", "matching_item_id")
    assert rows(fresh) == [(4, 9, 2)]


def images(spark, arrays):
    data = [(i, a.shape[1], a.shape[0], 1 if a.ndim == 2 else 3, bytearray(a.tobytes())) for i, a in enumerate(arrays)]
    return spark.createDataFrame(data, "id long, width int, height int, channels int, data binary")


def gradient(side):
    x = np.arange(side) / side
    out = np.zeros((side, side, 3), np.uint8)
    out[:, :, 0] = 128
    out[:, :, 1] = np.rint(x[:, None] * 255)
    out[:, :, 2] = np.rint(x[None, :] * 255)
    return out


def test_phash_is_stable_across_sizes(spark):
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 255, (90, 70), dtype=np.uint8)
    flat = np.full((40, 40), 77, np.uint8)
    got = dict(rows(neardup.phash(images(spark, [gradient(100), gradient(800), noise, flat]))))
    assert all(len(h) == 64 and set(h) <= {"0", "1"} for h in got.values())
    assert distance(got[0], got[1]) <= 10
    assert distance(got[0], got[2]) > 10


def test_phash_block_equals_direct_transform(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 255, (32, 32), dtype=np.uint8)
    block = np.array(neardup.low_frequency_blocks(images(spark, [image])).first()["block"]).reshape(8, 8)
    n = 32
    for u in range(8):
        for v in range(8):
            total = 0.0
            for y in range(n):
                for x in range(n):
                    total += (image[y, x] * np.cos((2 * y + 1) * u * np.pi / 64) * np.cos((2 * x + 1) * v * np.pi / 64))
            scale = (1 if u else 2**-0.5) * (1 if v else 2**-0.5) * 2 / n
            assert abs(block[u, v] - total * scale) < 1e-6


def unit(rng, count, width=16):
    v = rng.normal(size=(count, width)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def features(spark, ids, matrix):
    return spark.createDataFrame(
        [(int(i), int(i) // 2, [float(x) for x in v], False) for i, v in zip(ids, matrix)],
        "id long, item_id long, embedding array<float>, ignored boolean")


@pytest.mark.parametrize("tiles", [1, 4])
def test_similarity_join_equals_brute_force(spark, monkeypatch, tiles):
    monkeypatch.setattr(facegraph, "tile_count", lambda df: tiles)
    rng = np.random.default_rng(3)
    base = unit(rng, 150)
    vectors_ = np.vstack([base, base[:1].repeat(30, axis=0), base[7:8]])
    df = features(spark, range(len(vectors_)), vectors_)
    got = rows(facegraph.similarity_join(df, 0.5), "feature_id", "matching_feature_id")
    items = [(i, tuple(v)) for i, v in enumerate(vectors_)]
    close = lambda a, b: float(np.dot(np.float64(a), np.float64(b))) >= 0.5
    assert got == star_pairs(items, close)


def test_neighbours_spell_out_copies(spark):
    rng = np.random.default_rng(4)
    base = unit(rng, 20)
    vectors_ = np.vstack([base, base[:1].repeat(4, axis=0)])
    df = features(spark, range(24), vectors_)
    pairs = facegraph.similarity_join(df, 0.3)
    got = rows(facegraph.neighbours(pairs, facegraph.vector_members(df), df.filter("id IN (0, 21)")))
    sims = vectors_.astype(np.float64) @ vectors_.astype(np.float64).T
    expected = sorted((i, j) for i in (0, 21) for j in range(24) if i != j and sims[i, j] >= 0.3)
    assert got == expected


def test_search_in_any_blocks_agrees(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = features(spark, range(80), unit(rng, 80))
    queries = df.filter("id < 9")
    small = rows(facegraph.similarity_search(queries, df, 0.2), "query_id", "feature_id")
    monkeypatch.setattr(facegraph, "tile_count", lambda df: 3)
    assert rows(facegraph.similarity_search(queries, df, 0.2), "query_id", "feature_id") == small


def test_search_holds_a_strip_of_similarities():
    import tracemalloc

    import pandas as pd

    vectors = list(unit(np.random.default_rng(8), 3000))
    a = pd.DataFrame({"query_id": range(3000), "embedding": vectors})
    b = pd.DataFrame({"feature_id": range(3000), "embedding": vectors})
    tracemalloc.start()
    found = facegraph.search_block(a, b, 0.999999)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and not (found["query_id"] == found["feature_id"]).any()


def test_batch_against_pool_gives_every_new_pair(spark):
    rng = np.random.default_rng(7)
    df = features(spark, range(60), unit(rng, 60))
    every = rows(facegraph.similarity_join(df, 0.3), "feature_id", "matching_feature_id")
    got = rows(face_pairs_for_batch(df.filter("id >= 40").select("id", "embedding"),
                                    df.filter("id < 40").select("id", "embedding"), 0.3),
               "feature_id", "matching_feature_id")
    assert got == [p for p in every if p[1] >= 40]


def test_embedding_validation(spark):
    df = spark.createDataFrame(
        [(1, '{"embedding":[0.6,0.8]}'), (2, '{"embedding":[]}'), (3, '{"embedding":[1,"x"]}'), (4, "{}"), (5, None)],
        "id long, info string")
    assert [r[0] for r in rows(facegraph.with_valid_embedding(df), "id")] == [1]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select(vectors.l2_normalise(F.col("a")).alias("n"), vectors.l2_normalise(F.col("z")).alias("z"),
                  vectors.cosine(F.col("a"), F.col("b")).alias("c"),
                  vectors.is_match(F.col("b"), F.col("b")).alias("m")).first()
    assert r["n"] == pytest.approx([0.6, 0.8]) and r["z"] == [0.0, 0.0] and r["c"] == 3.0 and r["m"]


@pytest.mark.parametrize("length", [1.0, 3e16])
def test_products_are_exact_at_the_threshold(length):
    rng = np.random.default_rng(2)
    a = (rng.integers(-8, 9, (700, 16)) * length / 8).astype(np.float32).astype(np.float64)
    b = (rng.integers(-8, 9, (300, 16)) * length / 8).astype(np.float32).astype(np.float64)
    products = a @ b.T
    threshold = products[3, 5]  # met by several pairs
    found = [tuple(x.tolist()) for x in np.concatenate(
        [np.stack([r, c], axis=1) for r, c, _ in tiles.products_from(a, b, threshold)])]
    assert sorted(found) == sorted(zip(*[x.tolist() for x in np.nonzero(products >= threshold)])) and (3, 5) in found


def test_transitive_matches_follow_chains_and_ignores(spark):
    edges = spark.createDataFrame(
        [(1, 2, False), (2, 3, False), (3, 1, False), (3, 4, True), (5, 6, False)],
        "feature_id long, matching_feature_id long, ignore_match boolean")
    faces = spark.createDataFrame([(i, 10 * i) for i in range(1, 7)], "id long, item_id long")
    start = spark.createDataFrame([(1,)], "id long")
    assert rows(facegraph.transitive_matches(edges, faces, start)) == [(1, 20, 2), (1, 30, 3)]


def test_reachable_stops_at_depth(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(15)], "src long, dst long")
    found = graph.reachable(edges, spark.createDataFrame([(0,)], "id long"), depth=10)
    assert [r[0] for r in rows(found, "node")] == list(range(1, 11))


def test_transitive_matches_make_the_matches_once(spark):
    faces = spark.createDataFrame([(i, i, [1.0, float(i // 2)]) for i in range(12)],
                                  "id long, item_id long, embedding array<float>")
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    pairs = spark.createDataFrame([(i, i + 2) for i in range(0, 10, 2)] + [(i, i + 1) for i in range(0, 12, 2)],
                                  "feature_id long, matching_feature_id long")
    found = facegraph.transitive_matches(pairs.mapInPandas(count, pairs.schema), faces, faces.filter("id = 0").select("id"))
    page = facegraph.matching_faces_page(found).collect()
    assert [r["feature_id"] for r in page] == list(range(1, 12)) and made.value == 11


def test_walk_of_many_sources_equals_plain_search(spark, monkeypatch):
    """More sources than a bitmap has bits, copies, links between copies and to unknown ids; levels in several parts."""
    monkeypatch.setattr(graph, "MOST_BROADCAST", 20)
    rng = np.random.default_rng(5)
    rep = {i: i % 100 if i % 7 == 0 else i for i in range(200)}
    links = [(int(a), int(b)) for a, b in rng.integers(0, 230, (200, 2))]
    near = {}
    for a, b in links:
        if a < 200 and b < 200:
            near.setdefault(rep[a], set()).add(rep[b])
            near.setdefault(rep[b], set()).add(rep[a])
    starts = sorted(set(rep.values()))[:90]
    expected = []
    for start in starts:
        seen, level = {start}, {start}
        for hop in range(1, 5):
            level = {n for x in level for n in near.get(x, ())} - seen
            seen |= level
            expected += [(start, n, hop) for n in level]
    made = graph.walk(spark.createDataFrame(links, "a long, b long"), spark.createDataFrame([(i,) for i in starts], "id long"),
                      4, spark.createDataFrame(sorted(rep.items()), "id long, rep long"))
    assert rows(made, "source", "node", "hops") == sorted(expected)
    # a hop writes a row for a node and bitmap, not one for a source and node
    level = spark.createDataFrame([(i, 0, 1 << i) for i in range(20)], "node long, batch int, bits long")
    star = spark.createDataFrame([(i, 1000) for i in range(20)], "a long, b long")
    assert rows(graph._neighbour_bits(star, level)) == [(1000, 0, (1 << 20) - 1)]


@pytest.mark.parametrize("seed", [0, 1])
def test_connected_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500, x) for x in range(600, 640)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    expected = sorted((x, find(x)) for x in parent)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = rows(graph.connected_components(spark.createDataFrame(edges, "src long, dst long")))
    assert got == [p for p in expected if p[0] in linked]


def test_connected_components_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long")
    assert {r["component"] for r in graph.connected_components(edges).collect()} == {0}


@pytest.mark.parametrize("tiles", [1, 4])
@pytest.mark.parametrize("threshold", [0.2, 0.6])
def test_component_links_connect_like_all_pairs(spark, monkeypatch, tiles, threshold):
    monkeypatch.setattr(facegraph, "tile_count", lambda df: tiles)
    df = features(spark, range(140), unit(np.random.default_rng(9), 140))
    pairs = facegraph.similarity_join(df, threshold)
    expected = rows(graph.connected_components(pairs, "feature_id", "matching_feature_id"))
    links = facegraph.component_links(facegraph.vector_groups(df), threshold)
    assert links.count() <= 140 * tiles * (tiles + 1) // 2
    assert rows(graph.connected_components(links)) == expected
