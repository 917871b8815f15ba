"""Clusters and candidates against a plain greedy version."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shutterlake.operators import cluster
from shutterlake.plans.triage import face_triage


def unit(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def greedy(ids, vectors, threshold, cap):
    clusters = []
    for i, v in zip(ids, vectors):
        best, best_sim = None, -1
        for c in clusters:
            if len(c["ids"]) < cap:
                sim = float(v @ c["centroid"])
                if sim > best_sim:
                    best, best_sim = c, sim
        if best and best_sim >= threshold and np.mean([v @ m for m in best["members"]]) >= threshold:
            best["ids"].append(i)
            best["members"].append(v)
            mean = np.mean(best["members"], axis=0)
            best["centroid"] = mean / np.linalg.norm(mean)
        else:
            clusters.append({"ids": [i], "members": [v], "centroid": v})
    return sorted((i, c["ids"][0]) for c in clusters for i in c["ids"])


def people_vectors(rng, count, people=9, noise=0.45, width=12):
    centres = unit(rng.normal(size=(people, width)))
    picked = centres[rng.integers(0, people, count)]
    return unit(picked + noise * rng.normal(size=(count, width)) / np.sqrt(width) * 2).astype(np.float32)


def frame(spark, vectors):
    return spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in enumerate(vectors)],
                                 "id long, item_id long, embedding array<float>")


@pytest.mark.parametrize("seed,wave", [(0, 20_000), (1, 20_000), (2, 15), (3, 7)])
def test_clusters_equal_greedy(spark, seed, wave):
    vectors = people_vectors(np.random.default_rng(seed), 160)
    got = rows(cluster.capped_average_linkage(frame(spark, vectors), 0.55, 8, wave_rows=wave))
    assert got == greedy(range(160), vectors.astype(np.float64), 0.55, 8)


@pytest.mark.parametrize("seed,slice_rows,wave", [(5, 40, 20_000), (6, 55, 30)])
def test_slices_equal_greedy(spark, seed, slice_rows, wave):
    """Later slices go on with the clusters that earlier ones left open."""
    vectors = people_vectors(np.random.default_rng(seed), 160, people=4)
    vectors[70:80] = vectors[10]
    got = rows(cluster.capped_average_linkage(frame(spark, vectors), 0.45, 8, wave_rows=wave, slice_rows=slice_rows))
    assert got == greedy(range(160), vectors.astype(np.float64), 0.45, 8)


def test_one_component_in_waves_and_slices(spark):
    """All faces alike: waves of 25 in slices of 50."""
    vectors = people_vectors(np.random.default_rng(7), 90, people=1, noise=0.2)
    got = rows(cluster.capped_average_linkage(frame(spark, vectors), 0.55, 20, wave_rows=25, slice_rows=50))
    assert got == greedy(range(90), vectors.astype(np.float64), 0.55, 20)


def test_copies_fill_clusters_up_to_the_cap(spark):
    vectors = np.vstack([people_vectors(np.random.default_rng(4), 5)] + [unit(np.ones((1, 12), np.float32))] * 50)
    got = rows(cluster.capped_average_linkage(frame(spark, vectors), 0.55, 20, wave_rows=9))
    assert got == greedy(range(55), vectors.astype(np.float64), 0.55, 20)
    assert max(np.unique([c for _, c in got], return_counts=True)[1]) == 20


def test_blocks_of_faces_equal_greedy(monkeypatch):
    """Faces screened in blocks of five, next to clusters that are open already."""
    monkeypatch.setattr(cluster, "SCREEN_FACES", 5)
    monkeypatch.setattr(cluster, "SCREEN_ROWS", 7)
    vectors = people_vectors(np.random.default_rng(9), 120, people=4).astype(np.float64)
    vectors[60:75] = vectors[3]
    expected = greedy(range(120), vectors, 0.5, 6)
    first = dict(greedy(range(50), vectors[:50], 0.5, 6))
    names = np.array(sorted({c for c in first.values() if list(first.values()).count(c) < 6}))
    members = [[i for i, c in first.items() if c == name] for name in names]
    clusters = cluster.OpenClusters(names, np.array([vectors[m].sum(axis=0) for m in members]),
                                    np.array([len(m) for m in members]), 70)
    got = cluster.place_faces(np.arange(50, 120), vectors[50:], clusters, 0.5, 6)
    assert sorted([*first.items(), *zip(range(50, 120), got.tolist())]) == expected


def test_threshold_bounds(spark):
    with pytest.raises(ValueError):
        cluster.capped_average_linkage(frame(spark, np.eye(3, dtype=np.float32)), 0.9)


def scores(reps, linked, min_score):
    out = []
    for r, v in reps:
        for person in sorted({p for p, _ in linked}):
            sims = sorted((float(v @ e) for p, e in linked if p == person), reverse=True)
            k = min(len(sims), max(5, len(sims) // 2))
            mean = sum(sims[:k]) / k
            if mean >= min_score:
                out.append((r, person, round(mean, 9)))
    return sorted(out)


@pytest.mark.parametrize("whole", [8192, 20])
def test_person_scores_equal_brute_force(spark, monkeypatch, whole):
    """whole=20 sends the larger persons through the histogram path."""
    monkeypatch.setattr(cluster, "WHOLE_PERSON_ROWS", whole)
    monkeypatch.setattr(cluster, "HISTOGRAM_BINS", 64)
    monkeypatch.setattr(cluster, "HISTOGRAM_LEVELS", 7)
    rng = np.random.default_rng(8)
    linked = [(int(p), v) for p, v in zip(np.r_[np.zeros(70), np.repeat([1, 2], 25), [3] * 4], people_vectors(rng, 124))]
    linked += [(0, linked[0][1])] * 30
    reps = [(i, v) for i, v in enumerate(people_vectors(rng, 25))]
    left = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in reps], "rep_id long, embedding array<float>")
    right = spark.createDataFrame([(p, n, [float(x) for x in v]) for n, (p, v) in enumerate(linked)],
                                  "person_id long, feature_id long, embedding array<float>")
    got = rows(cluster.person_scores(left, right, 0.1).withColumn("score", F.round("score", 9)))
    wide = [(i, v.astype(np.float64)) for i, v in reps], [(p, v.astype(np.float64)) for p, v in linked]
    expected = scores(*wide, 0.1)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected], abs=2e-9)


def test_person_scores_hold_a_strip_of_similarities(spark, monkeypatch):
    """Strips of two representatives; a person of 70 faces is never scored against all of them at once."""
    monkeypatch.setattr(cluster, "STRIP_SCORES", 140)
    rng = np.random.default_rng(12)
    linked = [(0, v) for v in people_vectors(rng, 70)] + [(1, v) for v in people_vectors(rng, 3)]
    reps = [(i, v) for i, v in enumerate(people_vectors(rng, 25))]
    left = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in reps], "rep_id long, embedding array<float>")
    right = spark.createDataFrame([(p, n, [float(x) for x in v]) for n, (p, v) in enumerate(linked)],
                                  "person_id long, feature_id long, embedding array<float>")
    got = rows(cluster.person_scores(left, right, 0.1).withColumn("score", F.round("score", 9)))
    wide = [(i, v.astype(np.float64)) for i, v in reps], [(p, v.astype(np.float64)) for p, v in linked]
    expected = scores(*wide, 0.1)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected], abs=2e-9)


def triage_tables(spark):
    """Faces A, B, C around one direction, D elsewhere; one person with a linked face near A."""
    width = 128
    rng = np.random.default_rng(0)
    e0, e64 = np.zeros(width), np.zeros(width)
    e0[0], e64[64] = 1, 1
    vectors = [e0, unit(e0 + 0.05 * rng.normal(size=width) / 4), unit(e0 + 0.1 * rng.normal(size=width) / 4), e64, e0]
    features = spark.createDataFrame(
        [(i + 1, i + 1, [float(x) for x in v], False) for i, v in enumerate(vectors)],
        "id long, item_id long, embedding array<float>, ignored boolean")
    links = spark.createDataFrame([(1, 5, 77)], "id long, feature_id long, person_id long")
    none = spark.createDataFrame([], "id long, feature_id long, person_id long")
    return features, links, none


def test_face_triage_listing(spark):
    features, links, none = triage_tables(spark)
    ranked = face_triage(features, links, none)
    page = cluster.cluster_page(ranked, 0, 20).collect()
    assert [(r["representative_id"], r["feature_ids"], r["size"], r["top_person_id"], r["tier"]) for r in page] == [
        (1, [1, 2, 3], 3, 77, "suggested"), (4, [4], 1, None, "single")]
    assert page[0]["top_score"] == 1.0


def test_face_triage_rejections_and_ignored(spark):
    features, links, none = triage_tables(spark)
    refused = spark.createDataFrame([(1, 1, 77)], "id long, feature_id long, person_id long")
    ranked = face_triage(features.withColumn("ignored", F.col("id") == 4), links, refused)
    assert rows(ranked, "representative_id", "top_person_id", "tier") == [(1, None, "unsuggested")]


def test_no_unlinked_faces(spark):
    features, links, none = triage_tables(spark)
    empty = cluster.unlinked_features(features.withColumn("ignored", F.lit(True)), links)
    assert cluster.capped_average_linkage(empty).count() == 0
