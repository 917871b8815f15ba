"""Face triage: unlinked faces, centroids, clusters, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.operators import cluster
from shutterlake.operators.graph import connected_components
from shutterlake.operators.facegraph import component_links, vector_groups
from shutterlake.plans import triage
from shutterlake.plans.library import Library
from shutterlake.queries.registry import query
from shutterlake.queries.similarity import EDGES, _pairs

WIDE = cluster.THRESHOLD_RANGE[0]
LOW_SCORE = 0.12   # the benchmark vectors are nearly orthogonal

SCORES = {
    "unlinked": """SELECT id, item_id, embedding FROM feature WHERE NOT ignored AND id NOT IN (SELECT feature_id FROM person_feature)""",
    "linked": """SELECT p.person_id, p.feature_id, f.embedding FROM person_feature p JOIN feature f ON f.id = p.feature_id""",
    "score": f"""
        SELECT rep_id, person_id, avg(s) AS score FROM (
          SELECT u.id AS rep_id, l.person_id, list_inner_product(u.embedding, l.embedding) AS s,
            row_number() OVER (PARTITION BY u.id, l.person_id ORDER BY list_inner_product(u.embedding, l.embedding) DESC) AS r,
            count(*) OVER (PARTITION BY u.id, l.person_id) AS n
          FROM unlinked u, linked l)
        WHERE r <= greatest(5, n // 2) GROUP BY ALL HAVING avg(s) >= {LOW_SCORE}""",
    "candidate": """
        SELECT *, row_number() OVER (PARTITION BY rep_id ORDER BY score DESC, person_id) AS rank FROM score
        WHERE (rep_id, person_id) NOT IN (SELECT feature_id, person_id FROM face_rejection)
        QUALIFY rank <= 5""",
}


# The greedy rule itself: one face an iteration, carrying the clusters that are not full
def _clusters(threshold: float = cluster.CLUSTER_THRESHOLD) -> dict[str, str]:
    return {
        "unlinked": SCORES["unlinked"],
        "unit": """
            SELECT id, row_number() OVER (ORDER BY id) AS seq, list_transform(list_transform(embedding,
                lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), lambda x: x::FLOAT::DOUBLE) AS v
            FROM unlinked""",
        "greedy": f"""
            SELECT 0::BIGINT AS seq, NULL::BIGINT AS id, NULL::BIGINT AS cluster, []::STRUCT(name BIGINT, s DOUBLE[], n BIGINT)[] AS open
            UNION ALL
            SELECT seq, id, cluster, list_filter(list_transform(
                CASE WHEN cluster = id THEN list_append(open, {{'name': id, 's': list_transform(v, lambda x: 0::DOUBLE), 'n': 0::BIGINT}}) ELSE open END,
                lambda c: CASE WHEN c.name = cluster THEN {{'name': c.name, 's': list_transform(list_zip(c.s, v), lambda z: z[1] + z[2]), 'n': c.n + 1}}
                  ELSE c END), lambda c: c.n < {cluster.MAX_CLUSTER_SIZE}) AS open
            FROM (SELECT seq, id, v, open, CASE WHEN best.score >= {threshold} AND best.mean >= {threshold}
                    THEN -best.earlier ELSE id END AS cluster
              FROM (SELECT u.seq, u.id, u.v, g.open, list_sort(list_transform(g.open, lambda c: {{
                    'score': list_inner_product(c.s, u.v) / sqrt(list_inner_product(c.s, c.s)), 'earlier': -c.name,
                    'mean': list_inner_product(c.s, u.v) / c.n}}), 'DESC')[1] AS best
                  FROM greedy AS g JOIN unit AS u ON u.seq = g.seq + 1))""",
        "clustered": "SELECT id, cluster FROM greedy WHERE seq > 0",
        "summary": """SELECT min(id) AS representative_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS feature_ids, count(*) AS size
            FROM clustered GROUP BY cluster""",
    }


def _scored(lib: Library):
    free = cluster.unlinked_features(lib.feature, lib.person_feature)
    linked = cluster.linked_embeddings(lib.feature, lib.person_feature)
    return free.select(F.col("id").alias("rep_id"), "embedding"), linked


@query("SELECT id, item_id FROM unlinked", SCORES)
def unlinked_features(lib: Library):
    return cluster.unlinked_features(lib.feature, lib.person_feature).select("id", "item_id")


@query("SELECT person_id, feature_id, round(embedding[1], 6) AS first_value FROM linked", SCORES)
def linked_embeddings(lib: Library):
    rows = cluster.linked_embeddings(lib.feature, lib.person_feature)
    return rows.select("person_id", "feature_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


@query("""
    SELECT label, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM (
      SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, 64)) AS pos FROM feature) GROUP BY ALL)""")
def normalised_centroid(lib: Library):
    centroids = cluster.normalised_centroid(lib.feature.select("label", "embedding"), "label")
    return centroids.select("label", F.posexplode("centroid").alias("pos", "v")).select(
        "label", F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("value"))


@query("""
    SELECT node AS id, min(other) AS component FROM (
      SELECT node, other FROM closure UNION ALL SELECT DISTINCT node, node FROM closure) GROUP BY node""",
       {**_pairs(EDGES),
        "link": "SELECT feature_id AS a, matching_feature_id AS b FROM face_pair UNION SELECT matching_feature_id, feature_id FROM face_pair",
        "closure": "SELECT a AS node, b AS other FROM link UNION SELECT node, b FROM closure JOIN link ON a = other"})
def connected_faces(lib: Library):
    """Components of the similarity graph, from links that are linear in the faces compared."""
    return connected_components(component_links(vector_groups(lib.feature), EDGES))


@query("SELECT id, cluster FROM clustered", _clusters())
def capped_average_linkage(lib: Library):
    faces = cluster.unlinked_features(lib.feature, lib.person_feature)
    return cluster.capped_average_linkage(faces)


@query("SELECT id, cluster FROM clustered", _clusters(WIDE))
def capped_average_linkage_wide(lib: Library):
    """At the lowest threshold, where clusters of the benchmark vectors have several members."""
    return cluster.capped_average_linkage(cluster.unlinked_features(lib.feature, lib.person_feature), WIDE)


@query("SELECT representative_id, feature_ids, size FROM summary", _clusters())
def cluster_representative(lib: Library):
    faces = cluster.unlinked_features(lib.feature, lib.person_feature)
    return cluster.cluster_summary(cluster.capped_average_linkage(faces)).withColumn(
        "feature_ids", F.array_join(F.col("feature_ids").cast("array<string>"), ","))


@query("SELECT rep_id, person_id, round(score, 6) AS score, rank FROM candidate", SCORES)
def candidate_people(lib: Library):
    """Every unlinked face taken as a representative, so that the scores can be checked in SQL."""
    reps, linked = _scored(lib)
    found = cluster.candidate_people(reps, linked, lib.face_rejection, LOW_SCORE)
    return found.withColumn("score", F.round("score", 6))


@query("""SELECT rep_id, person_id FROM score WHERE (rep_id, person_id) NOT IN (SELECT feature_id, person_id FROM face_rejection)""", SCORES)
def exclude_rejected(lib: Library):
    reps, linked = _scored(lib)
    scores = cluster.person_scores(reps, linked, LOW_SCORE)
    return cluster.exclude_rejected(scores, lib.face_rejection).select("rep_id", "person_id")


@query("""
    SELECT c.rep_id, c.person_id, c.rank, n.name, coalesce(n.name_count, 0) AS name_count, p.first_feature_id, p.photo_count,
      floor(c.score * 1000 + 0.5) / 1000 AS match_score
    FROM candidate c
    LEFT JOIN (SELECT person_id, arg_min(name, CASE WHEN preferred THEN id ELSE id + 1e12 END) AS name, count(*) AS name_count FROM person_name GROUP BY ALL) n USING (person_id)
    LEFT JOIN (SELECT person_id, arg_min(feature_id, id) AS first_feature_id, count(*) AS photo_count FROM person_feature GROUP BY ALL) p USING (person_id)""", SCORES)
def enrich_candidates(lib: Library):
    reps, linked = _scored(lib)
    found = cluster.candidate_people(reps, linked, lib.face_rejection, LOW_SCORE)
    return cluster.enrich_candidates(found, lib.person_name, lib.person_feature)


@query("""
    SELECT u.id AS representative_id, 1 AS size, floor(c.score * 1000 + 0.5) / 1000 AS top_score, c.person_id AS top_person_id,
      'single' AS tier, (SELECT count(*) FROM unlinked) AS total
    FROM unlinked u LEFT JOIN candidate c ON c.rep_id = u.id AND c.rank = 1
    ORDER BY coalesce(floor(c.score * 1000 + 0.5) / 1000, -1) DESC, size DESC, u.id LIMIT 20""", SCORES)
def rank_clusters(lib: Library):
    """Faces taken as clusters of one, so that order, page and total can be checked in SQL."""
    reps, linked = _scored(lib)
    found = cluster.candidate_people(reps, linked, lib.face_rejection, LOW_SCORE)
    summary = reps.select(F.col("rep_id").alias("representative_id"), F.lit(1).cast("bigint").alias("size"))
    ranked = cluster.ranked_clusters(summary, found)
    return cluster.cluster_page(ranked).withColumn("total", summary.agg(F.count("*")).scalar())


@query("SELECT count(*) AS total, sum(size)::BIGINT AS total_faces FROM summary", _clusters(WIDE))
def cluster_totals(lib: Library):
    faces = cluster.unlinked_features(lib.feature, lib.person_feature)
    return cluster.cluster_totals(cluster.cluster_summary(cluster.capped_average_linkage(faces, WIDE)))


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey > 12 AND c_acctbal > 0 THEN 'suggested'
            WHEN c_nationkey > 12 THEN 'unsuggested' ELSE 'single' END AS tier FROM customer""")
def triage_tiers(lib: Library):
    size = F.when(F.col("c_nationkey") > 12, 2).otherwise(1)
    score = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return lib.raw("customer").select(
        F.col("c_custkey").alias("id"), cluster.triage_tier(size, score).alias("tier"))


@query("""
    SELECT representative_id, size, floor(c.score * 1000 + 0.5) / 1000 AS top_score, c.person_id AS top_person_id,
      CASE WHEN size > 1 AND c.score IS NOT NULL THEN 'suggested' WHEN size > 1 THEN 'unsuggested' ELSE 'single' END AS tier
    FROM summary LEFT JOIN candidate c ON c.rep_id = representative_id AND c.rank = 1""", {**_clusters(), **SCORES})
def face_triage(lib: Library):
    """The whole triage listing: clusters, candidates, order."""
    return triage.face_triage(
        lib.feature, lib.person_feature, lib.face_rejection, min_score=LOW_SCORE
    ).drop("feature_ids")
