"""Pruned and approximate similarity joins against all pairs."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shutterlake.operators import facegraph
from shutterlake.operators.cells import hashing_saves, pivot_visits, table_count


def people(seed, count=600, width=32, centres=25, noise=0.35):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    vectors = middle[rng.integers(0, centres, count)] / np.sqrt(width) + noise * rng.normal(size=(count, width)) / np.sqrt(width)
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, vectors, id_col="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)],
                                 f"{id_col} long, embedding array<float>")


def all_pairs(vectors, threshold):
    scores = vectors.astype(np.float64) @ vectors.T.astype(np.float64)
    return sorted((int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(scores >= threshold, 1))))


@pytest.mark.parametrize("threshold, cell_rows, tile_rows", [(0.5, 30, 16_384), (0.8, 20, 16), (0.95, 30, 25), (-0.2, 200, 90)])
def test_pruned_pairs_equal_all_pairs(spark, threshold, cell_rows, tile_rows):
    vectors = people(1)
    vectors[5] *= 3      # lengths other than one stay exact
    vectors[6] *= 0
    groups = facegraph.vector_groups(frame(spark, vectors))
    got = rows(facegraph.distinct_vector_pairs(groups, threshold, cell_rows, tile_rows), "feature_id", "matching_feature_id")
    assert got == all_pairs(vectors, threshold)


def test_far_tiles_are_skipped(spark):
    """At a high threshold most rows meet a small part of the tiles, and never more than exist."""
    vectors = frame(spark, people(2, 800, noise=0.2), "rep")
    seen = pivot_visits(vectors, "rep", 0.9, 40).agg(
        F.sum(F.size("tiles")).alias("copies"), F.max(F.size("tiles")).alias("most"), F.count("*").alias("n"),
        F.countDistinct("_own").alias("tiles")).first()
    assert seen["n"] == 800 and seen["tiles"] <= 40
    assert seen["copies"] < 0.4 * seen["n"] * seen["tiles"]
    every = pivot_visits(vectors, "rep", -1.0, 40).agg(F.min(F.size("tiles"))).first()[0]
    assert every == seen["tiles"]


def test_cells_that_save_nothing_are_not_used(spark, monkeypatch):
    """At a threshold that rules out nothing, rows meet in few large tiles."""
    from shutterlake.operators import cells

    used = []
    monkeypatch.setattr(cells, "self_tiles", lambda *a: used.append(a[-1]) or facegraph.self_tiles(*a))
    vectors = people(7, 300)
    groups = facegraph.vector_groups(frame(spark, vectors))
    got = rows(facegraph.distinct_vector_pairs(groups, -0.9, 20, 16), "feature_id", "matching_feature_id")
    assert used == [1] and got == all_pairs(vectors, -0.9)
    facegraph.distinct_vector_pairs(facegraph.vector_groups(frame(spark, people(2, 800, noise=0.2))), 0.9, 20)
    assert len(used) == 1


def test_hashed_pairs_reach_their_recall(spark):
    vectors = people(3)
    expected = set(all_pairs(vectors, 0.8))
    got = rows(facegraph.similarity_join(frame(spark, vectors), 0.8, approx=True), "feature_id", "matching_feature_id")
    assert len(got) == len(set(got)) and set(got) <= expected
    assert len(got) >= 0.9 * len(expected) > 100


def test_hashed_buckets_in_tiles(spark, monkeypatch):
    """Buckets larger than a tile, and copies linked to their lowest id."""
    from shutterlake.operators import cells

    monkeypatch.setattr(cells, "BUCKET_ROWS", 20)
    vectors = people(4, 300)
    vectors[100:110] = vectors[7]
    expected = {p for p in all_pairs(vectors, 0.7) if not (100 <= p[1] < 110) and not (100 <= p[0] < 110)}
    expected |= {(7, n) for n in range(100, 110)}
    got = rows(facegraph.similarity_join(frame(spark, vectors), 0.7, approx=True, recall=0.9999), "feature_id", "matching_feature_id")
    assert set(got) <= expected and len(got) >= 0.99 * len(expected)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    assert facegraph.similarity_join(none, 0.5, approx=True).count() == 0
    assert facegraph.similarity_join(frame(spark, people(5, 1)), 0.5, approx=True).count() == 0


def test_table_count_follows_the_angle():
    assert table_count(4, 1.0, 0.95) == 1
    assert table_count(8, 0.5, 0.95) > table_count(8, 0.8, 0.95) > table_count(4, 0.8, 0.95)


def test_recall_must_be_a_share(spark):
    with pytest.raises(ValueError):
        facegraph.similarity_join(frame(spark, people(5, 2)), 0.5, approx=True, recall=1.0)


def test_all_pairs_where_hashing_is_more_work(spark):
    """At a recall that tables of hyperplanes miss pairs at, and more work than all pairs: nothing is missed."""
    vectors = people(6)
    assert not hashing_saves(len(vectors), 0.3, 0.5) and hashing_saves(10**8, 0.9, 0.95)
    got = rows(facegraph.similarity_join(frame(spark, vectors), 0.3, approx=True, recall=0.5), "feature_id", "matching_feature_id")
    assert got == all_pairs(vectors, 0.3)


def test_hashed_pairs_alone(spark):
    vectors = people(3)
    expected = set(all_pairs(vectors, 0.8))
    groups = facegraph.vector_groups(frame(spark, vectors))
    got = rows(facegraph._hashed_pairs(groups, 0.8, 0.95), "feature_id", "matching_feature_id")
    assert len(got) == len(set(got)) and set(got) <= expected and len(got) >= 0.9 * len(expected)
