"""Face triage from feature table to ranked clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators import cluster
from shutterlake.session import cut_lineage


def face_triage(features: DataFrame, person_features: DataFrame, rejections: DataFrame,
                threshold: float = cluster.CLUSTER_THRESHOLD,
                min_score: float = cluster.CANDIDATE_MIN_SCORE) -> DataFrame:
    """(representative_id, feature_ids, size, top_score, top_person_id, tier) of unlinked faces.

    Clusters are computed once and written out; order pages with ``cluster.cluster_order``.
    """
    faces = cluster.unlinked_features(features, person_features)
    summary = cut_lineage(
        cluster.cluster_summary(cluster.capped_average_linkage(faces, threshold))
    )
    reps = summary.select(F.col("representative_id").alias("id")).join(
        faces.select("id", "embedding"), "id"
    ).select(F.col("id").alias("rep_id"), "embedding")
    linked = cluster.linked_embeddings(features, person_features)
    found = cluster.candidate_people(reps, linked, rejections, min_score)
    return cluster.ranked_clusters(summary, found)
