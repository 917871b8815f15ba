"""Face triage: capped average-linkage clusters of unlinked faces and people suggested for them."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.scalars import round_half_up
from shutterlake.functions.vectors import l2_normalise
from shutterlake.operators.facegraph import (
    component_links,
    hit_links,
    vector_groups,
    with_valid_embedding,
)
from shutterlake.operators.graph import connected_components
from shutterlake.operators.keyed import number_within, page
from shutterlake.operators.tiles import cross_tiles, matrix, tile_count
from shutterlake.session import cut_lineage, shared_dir

CLUSTER_THRESHOLD = 0.55
THRESHOLD_RANGE = (0.40, 0.70)
MAX_CLUSTER_SIZE = 20
CANDIDATE_MIN_SCORE = 0.65
CANDIDATE_TOP_K = 5
CANDIDATES_KEPT = 5

SLICE_ROWS = 200_000   # faces looked at together, over all tasks
WAVE_ROWS = 20_000     # faces of one component placed by one task at a time
SCREEN_ROWS = 4096    # centroids compared with a block of faces at once
SCREEN_FACES = 256     # faces of such a block
SCREEN_SLACK = 1e-4    # more than floats lose in products of unit vectors
WHOLE_PERSON_ROWS = 65_536
STRIP_SCORES = 1 << 21  # similarities held at once: 16 MB
FACE_SCHEMA = "component BIGINT, id BIGINT, embedding ARRAY<FLOAT>, wave INT"
PLACED = "component BIGINT, id BIGINT, cluster BIGINT"
PLACED_SCHEMA = f"{PLACED}, wave INT"
DONE = "id BIGINT, cluster BIGINT"
HISTOGRAM_BINS = 1024
HISTOGRAM_LEVELS = 4   # 2 / 1024**4 < 2e-12: bins end narrower than rounding noise


def unlinked_features(features: DataFrame, person_features: DataFrame) -> DataFrame:
    """(id, item_id, embedding) of faces nobody is linked to, not ignored, with a valid vector."""
    free = with_valid_embedding(features).filter(~F.coalesce(F.col("ignored"), F.lit(False)))
    linked = person_features.select(F.col("feature_id").alias("id"))
    return free.join(linked, "id", "left_anti").select("id", "item_id", "embedding")


def linked_embeddings(features: DataFrame, person_features: DataFrame) -> DataFrame:
    """(person_id, feature_id, embedding) of linked faces."""
    faces = with_valid_embedding(features).select(F.col("id").alias("feature_id"), "embedding")
    return person_features.select("person_id", "feature_id").join(faces, "feature_id")


def normalised_centroid(vectors: DataFrame, key: str) -> DataFrame:
    """(key, centroid): mean vector per key, scaled to length one.

    Averages per (key, position) combine before the shuffle, so a key with very many vectors is
    never gathered; only one short vector per key is.
    """
    parts = vectors.select(key, F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("v"))
    return ordered.select(key, l2_normalise(F.col("v.m")).alias("centroid"))


# --- clustering -------------------------------------------------------------------------------

class OpenClusters:
    """Sums, sizes and names of clusters that can take another face, in the order of their founding."""

    def __init__(self, names: np.ndarray, sums: np.ndarray, sizes: np.ndarray, room: int):
        self.used = len(names)
        self.names = np.concatenate([names, np.zeros(room, dtype=np.int64)])
        self.sizes = np.concatenate([sizes, np.zeros(room, dtype=np.int64)])
        self.sums = np.concatenate([sums, np.zeros((room, sums.shape[1]))])
        norms = np.linalg.norm(self.sums, axis=1)
        self.centroids = self.sums / np.where(norms > 0, norms, 1.0)[:, None]
        self.single = self.centroids.astype(np.float32)
        self.live = np.arange(len(self.names)) < self.used

    def found(self, name: int) -> int:
        slot, self.used = self.used, self.used + 1
        self.names[slot], self.live[slot] = name, True
        return slot

    def add(self, slot: int, face: np.ndarray, cap: int) -> None:
        self.sums[slot] += face
        self.sizes[slot] += 1
        norm = np.linalg.norm(self.sums[slot])
        self.centroids[slot] = self.sums[slot] / norm if norm > 0 and self.sizes[slot] > 1 else self.sums[slot]
        self.single[slot] = self.centroids[slot]
        self.live[slot] = self.sizes[slot] < cap

    def near(self, faces: np.ndarray, threshold: float) -> list[np.ndarray]:
        """For each face the slots, in order, whose centroid may reach the threshold (compared in floats)."""
        slots = np.flatnonzero(self.live[:self.used])
        single = faces.astype(np.float32).T
        rows, cols = [], []
        for start in range(0, len(slots), SCREEN_ROWS):
            part = slots[start:start + SCREEN_ROWS]
            at, face = np.nonzero(self.single[part] @ single >= threshold - SCREEN_SLACK)
            rows.append(part[at])
            cols.append(face)
        if not rows:
            return [np.zeros(0, dtype=np.int64)] * len(faces)
        row, col = np.concatenate(rows), np.concatenate(cols)
        order = np.argsort(col, kind="stable")
        return np.split(row[order], np.cumsum(np.bincount(col, minlength=len(faces)))[:-1])


def place_faces(ids: np.ndarray, vectors: np.ndarray, clusters: OpenClusters, threshold: float,
                cap: int) -> np.ndarray:
    """Cluster (lowest member id) of each face, in the given order, starting from open clusters.

    A face joins the non-full cluster whose centroid is most similar (the earlier one on a tie) if
    that similarity and its mean similarity to the members both reach the threshold; otherwise it
    founds a cluster. Sums of members are kept, so a mean similarity is one dot product. A block of faces
    is compared with all open centroids at once; what is left of these is compared again one face at a
    time, together with the clusters that the block's earlier faces changed.
    """
    out = np.zeros(len(ids), dtype=np.int64)
    for start in range(0, len(ids), SCREEN_FACES):
        near = clusters.near(vectors[start:start + SCREEN_FACES], threshold)
        places: dict[int, int] = {}  # of the clusters this block has changed
        changed = np.zeros(len(near), dtype=np.int64)
        moved = np.zeros((len(near), vectors.shape[1]))
        for n, slots in enumerate(near, start):
            face = vectors[n]
            again = np.flatnonzero(moved[:len(places)] @ face >= threshold - SCREEN_SLACK)
            if len(again):
                slots = np.union1d(slots, changed[again])
            slots = slots[clusters.live[slots]]
            target = -1
            if len(slots):
                scores = np.einsum("ij,j->i", clusters.centroids[slots], face)
                best = int(np.argmax(scores))
                slot = int(slots[best])
                if scores[best] >= threshold and (clusters.sums[slot] @ face) / clusters.sizes[slot] >= threshold:
                    target = slot
            if target < 0:
                target = clusters.found(ids[n])
            clusters.add(target, face, cap)
            at = places.setdefault(target, len(places))
            changed[at], moved[at] = target, clusters.centroids[target]
            out[n] = clusters.names[target]
    return out


def conflict_links(faces: DataFrame, members: DataFrame | None, threshold: float) -> DataFrame:
    """(src, dst) links between faces, and between faces and clusters, that can meet in a cluster.

    On unit vectors a face is only admitted to a cluster when some member has similarity of at
    least threshold**1.5, so faces and clusters that are not connected by such similarities never
    influence each other. ``members(cluster, id, embedding)`` are those of the open clusters; a cluster is
    named by an id that no face of ``faces`` has. The links are linear in the rows compared.
    """
    near = threshold**1.5 - 1e-9
    groups = vector_groups(faces)
    links = component_links(groups, near).unionByName(
        faces.join(groups.filter("copies > 1").select("embedding", "rep"), "embedding")
        .filter("id <> rep")
        .select(F.col("rep").alias("src"), F.col("id").alias("dst"))
    )
    if members is None:
        return links

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return hit_links(matrix(a["embedding"]), matrix(b["embedding"]), a["rep"].to_numpy(),
                         b["cluster"].to_numpy(), near)

    reps = groups.select("rep", "embedding")
    return links.unionByName(cross_tiles(
        reps, members.select("cluster", "id", "embedding"), "rep", "id", kernel, "src BIGINT, dst BIGINT",
        tile_count(reps), tile_count(members)))


def capped_average_linkage(faces: DataFrame, threshold: float = CLUSTER_THRESHOLD,
                           cap: int = MAX_CLUSTER_SIZE, wave_rows: int = WAVE_ROWS,
                           slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(id, cluster): greedy clusters in id order, named by their lowest id.

    Faces are placed in slices of ``slice_rows`` in id order. Within a slice only faces that can influence each
    other, directly or through a cluster that is still open, have to be placed one after the other:
    they form components, which are found from links and placed by one task each. A component with
    more than ``wave_rows`` faces of the slice is placed in several waves, in id order. A task sees
    the faces of its wave and the members of the open clusters of its component, so its input stays bounded
    also where similarities connect the whole library. Faces without links are clusters by themselves
    and never reach Python.
    """
    low, high = THRESHOLD_RANGE
    if not low <= threshold <= high:
        raise ValueError(f"threshold must be within {low} and {high}")
    unit = l2_normalise(F.col("embedding")).cast("array<float>").alias("embedding")
    whole = faces.select("id", unit).withColumn("_all", F.lit(0))
    units = cut_lineage(
        number_within(whole, ["_all"], "id", [], "_seq")
        .select("id", "embedding", F.floor((F.col("_seq") - 1) / slice_rows).cast("int").alias("slice"))
    )
    slices = 1 + (units.agg(F.max("slice")).first()[0] or 0)
    # Kept as a table in the shared folder, a part per slice: the plan does not grow from slice to slice.
    spark = faces.sparkSession
    work = f"{shared_dir(spark).rstrip('/')}/clusters-{uuid.uuid4().hex}"
    for number in range(slices):
        part = units.filter(F.col("slice") == number).select("id", "embedding")
        done = spark.read.schema(DONE).parquet(f"{work}/slice=*") if number else None
        members = done and _open_members(done.select("id", "cluster"), units.select("id", "embedding"), cap)
        _place_slice(part, members and cut_lineage(members), threshold, cap, wave_rows).write.parquet(
            f"{work}/slice={number}"
        )
    return spark.read.schema(DONE).parquet(f"{work}/slice=*")


def _open_members(done: DataFrame, vectors: DataFrame, cap: int) -> DataFrame:
    """(cluster, id, embedding) of the clusters that can take another face."""
    still_open = done.groupBy("cluster").count().filter(F.col("count") < cap)
    return (
        done.join(still_open, "cluster", "left_semi").join(vectors, "id")
        .select("cluster", "id", "embedding")
    )


def _place_slice(faces: DataFrame, members: DataFrame | None, threshold: float, cap: int,
                 wave_rows: int) -> DataFrame:
    """(id, cluster) of the faces of one slice, ``members`` being those of the clusters open before it."""
    spark = faces.sparkSession
    component = cut_lineage(connected_components(conflict_links(faces, members, threshold)))
    joined = faces.join(component, "id", "left")
    lonely = joined.filter("component IS NULL").select("id", F.col("id").alias("cluster"))
    crowd = joined.filter("component IS NOT NULL")
    work = f"{shared_dir(spark).rstrip('/')}/placed-{uuid.uuid4().hex}"
    number_within(crowd, ["component"], "id", [], "_seq").select(
        "component", "id", "embedding",
        F.floor((F.col("_seq") - 1) / wave_rows).cast("int").alias("wave"),
    ).write.partitionBy("wave").parquet(f"{work}/faces")
    waves = spark.read.schema(FACE_SCHEMA).parquet(f"{work}/faces")
    last = waves.agg(F.max("wave")).first()[0]
    if last is None:
        return lonely
    known = None
    if members is not None:
        known = members.join(component.withColumnRenamed("id", "cluster"), "cluster")
    for wave in range(last + 1):
        rows = waves.filter(F.col("wave") == wave).select("component", "id", "embedding")
        placed = spark.read.schema(PLACED_SCHEMA).parquet(f"{work}/placed") if wave else None
        _place_wave(rows, placed, known, waves, threshold, cap).write.mode("overwrite").parquet(
            f"{work}/placed/wave={wave}"
        )
    placed = spark.read.schema(PLACED_SCHEMA).parquet(f"{work}/placed")
    return lonely.unionByName(placed.select("id", "cluster"))


def _place_wave(rows: DataFrame, placed: DataFrame | None, known: DataFrame | None, waves: DataFrame,
                threshold: float, cap: int) -> DataFrame:
    """Places one wave next to the slice's earlier waves and the open clusters of earlier slices."""
    def place(block: pd.DataFrame, members: pd.DataFrame | None) -> pd.DataFrame:
        block = block.sort_values("id")
        vectors = matrix(block["embedding"])
        names = sizes = np.zeros(0, dtype=np.int64)
        sums = np.zeros((0, vectors.shape[1]))
        if members is not None and len(members):
            members = members.sort_values(["cluster", "id"])
            names, first, sizes = np.unique(members["cluster"], return_index=True, return_counts=True)
            sums = np.add.reduceat(matrix(members["embedding"]), first, axis=0)
            names, sums, sizes = (x[sizes < cap] for x in (names, sums, sizes))
        cluster = place_faces(block["id"].to_numpy(), vectors, OpenClusters(names, sums, sizes, len(block)),
                              threshold, cap)
        return pd.DataFrame(
            {"component": block["component"], "id": block["id"], "cluster": cluster}
        )

    waiting = rows.select("component").distinct()
    parts = []
    if known is not None:
        parts.append(known.select("component", "cluster", "id", "embedding"))
    if placed is not None:
        vectors = waves.select("id", "embedding")
        parts.append(placed.select("component", "cluster", "id").join(vectors, "id")
                     .select("component", "cluster", "id", "embedding"))
    if not parts:
        return rows.groupBy("component").applyInPandas(lambda b: place(b, None), PLACED)
    members = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    still_open = members.groupBy("cluster").count().filter(F.col("count") < cap)
    members = members.join(still_open, "cluster", "left_semi").join(waiting, "component", "left_semi")
    # fresh column identities: both sides come from the same table
    members = members.select(*[F.col(c).alias(c) for c in members.columns])

    def both(block: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if len(block) == 0:
            return pd.DataFrame({"component": [], "id": [], "cluster": []})
        return place(block, others)

    return rows.groupBy("component").cogroup(members.groupBy("component")).applyInPandas(both, PLACED)


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """(representative_id, feature_ids, size); a cluster has at most ``cap`` members."""
    return (
        clusters.groupBy("cluster")
        .agg(
            F.min("id").alias("representative_id"),
            F.sort_array(F.collect_list("id")).alias("feature_ids"),
            F.count("*").alias("size"),
        )
        .drop("cluster")
    )


# --- candidates -------------------------------------------------------------------------------

def person_scores(reps: DataFrame, linked: DataFrame,
                  min_score: float = CANDIDATE_MIN_SCORE) -> DataFrame:
    """(rep_id, person_id, score): mean of the best k = max(5, n // 2) similarities, >= min_score.

    ``reps(rep_id, embedding)``, ``linked(person_id, feature_id, embedding)``. A person of up to
    WHOLE_PERSON_ROWS faces is scored whole inside one block, for strips of representatives that make
    STRIP_SCORES similarities at a time; for larger ones see ``_large_person_scores``.
    """
    sizes = linked.groupBy("person_id").agg(F.count("*").alias("n"))
    sized = linked.join(sizes, "person_id")
    small = sized.filter(F.col("n") <= WHOLE_PERSON_ROWS)
    large_people = sizes.filter(F.col("n") > WHOLE_PERSON_ROWS)
    rep_tiles = tile_count(reps)
    schema = "rep_id BIGINT, person_id BIGINT, score DOUBLE"

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("person_id", kind="stable")
        people = b["person_id"].to_numpy()
        vectors = matrix(b["embedding"])
        rep_ids, queries = a["rep_id"].to_numpy(), matrix(a["embedding"])
        found, starts = np.unique(people, return_index=True)
        stops = np.append(starts[1:], len(people))
        out = []
        for person, start, stop in zip(found, starts, stops):
            n = stop - start
            k = min(n, max(CANDIDATE_TOP_K, n // 2))
            strip = max(1, STRIP_SCORES // n)
            for row in range(0, len(queries), strip):
                scores = queries[row:row + strip] @ vectors[start:stop].T
                if k < n:
                    scores.partition(n - k, axis=1)
                mean = scores[:, n - k:].mean(axis=1)
                hit = mean >= min_score
                out.append(pd.DataFrame(
                    {"rep_id": rep_ids[row:row + strip][hit], "person_id": person, "score": mean[hit]}
                ))
        return pd.concat(out)

    scored = cross_tiles(
        reps.select("rep_id", "embedding"), small.select("person_id", "embedding"),
        "rep_id", "person_id", kernel, schema,
        rep_tiles, tile_count(linked),
    )
    if large_people.isEmpty():
        return scored
    return scored.unionByName(
        _large_person_scores(
            reps, sized.filter(F.col("n") > WHOLE_PERSON_ROWS), min_score, rep_tiles
        )
    )


def _bin_kernel(step: float, bins: int):
    """Counts and sums of similarities per (rep, person, bin) above each rep's ``lo``."""

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        people, vectors = b["person_id"].to_numpy(), matrix(b["embedding"])
        out = []
        for person in np.unique(people):
            faces = vectors[people == person]
            for start in range(0, len(a), 256):
                part = a.iloc[start:start + 256]
                scores = matrix(part["embedding"]) @ faces.T
                place = np.floor((scores - part["lo"].to_numpy()[:, None]) / step)
                rows, cols = np.nonzero((place >= 0) & (place < bins))
                grouped = (
                    pd.DataFrame({
                        "rep_id": part["rep_id"].to_numpy()[rows],
                        "bin": place[rows, cols].astype(np.int32),
                        "s": scores[rows, cols],
                    })
                    .groupby(["rep_id", "bin"])["s"]
                    .agg(["count", "sum"])
                    .reset_index()
                )
                out.append(pd.DataFrame({
                    "rep_id": grouped["rep_id"], "person_id": person, "bin": grouped["bin"],
                    "cnt": grouped["count"], "total": grouped["sum"],
                }))
        return pd.concat(out)

    return kernel


def _large_person_scores(reps: DataFrame, faces: DataFrame, min_score: float, rep_tiles: int,
                         bins: int = HISTOGRAM_BINS, levels: int = HISTOGRAM_LEVELS,
                         chunk_rows: int = 4096) -> DataFrame:
    """Mean of the best k similarities without bringing a person's faces together.

    Blocks of faces emit counts and sums per similarity bin; the bins are added up per (rep,
    person) and the bin that holds the k-th value is cut finer on the next level. After four
    levels that bin is narrower than 2e-12 and its mean stands for the values taken from it. Pairs
    that cannot reach ``min_score`` any more are dropped between levels.

    State per pair: lo = lower end of the bin to look into, need = values still wanted from it,
    kept = sum of the values above it.
    """
    schema = "rep_id BIGINT, person_id BIGINT, bin INT, cnt BIGINT, total DOUBLE"
    pair = ["rep_id", "person_id"]
    width, lowest = 2.0 + 2e-6, -1.0 - 1e-6
    vectors = reps.select("rep_id", "embedding")
    people = faces.groupBy("person_id").agg(
        F.greatest(F.lit(CANDIDATE_TOP_K), F.floor(F.max("n") / 2)).cast("long").alias("k"),
        F.ceil(F.max("n") / chunk_rows).cast("int").alias("_tiles"),
    )
    blocks = faces.select("person_id", "feature_id", "embedding")
    state: DataFrame | None = None
    for _ in range(levels):
        step = width / bins
        if state is None:
            counted = cross_tiles(
                vectors.withColumn("lo", F.lit(lowest)), blocks, "rep_id", "feature_id",
                _bin_kernel(step, bins), schema, rep_tiles, tile_count(blocks),
            )
        else:
            left = state.select(*pair, "lo").join(vectors, "rep_id").join(people, "person_id")
            counted = cross_tiles(
                left.drop("k"), blocks.join(people.drop("k"), "person_id"),
                "rep_id", "feature_id", _bin_kernel(step, bins), schema,
                F.lit(rep_tiles), F.col("_tiles"), keys=["person_id"],
            )
        summed = counted.groupBy(*pair, "bin").agg(
            F.sum("cnt").alias("cnt"), F.sum("total").alias("total")
        )
        if state is None:
            known = (
                summed.select(*pair).distinct()
                .join(people.select("person_id", "k"), "person_id")
                .withColumns({"lo": F.lit(lowest), "need": F.col("k"), "kept": F.lit(0.0)})
            )
        else:
            known = state.drop("mean")
        above = (
            Window.partitionBy(*pair).orderBy(F.desc("bin"))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        ranked = summed.withColumns({
            "before": F.coalesce(F.sum("cnt").over(above), F.lit(0)),
            "before_sum": F.coalesce(F.sum("total").over(above), F.lit(0.0)),
        })
        chosen = (
            known.join(ranked, pair)
            .filter("before < need AND before + cnt >= need")
            .select(
                *pair, "k",
                (F.col("lo") + F.col("bin") * F.lit(step)).alias("lo"),
                (F.col("need") - F.col("before")).alias("need"),
                (F.col("kept") + F.col("before_sum")).alias("kept"),
                (F.col("total") / F.col("cnt")).alias("mean"),
            )
        )
        best_case = (F.col("kept") + F.col("need") * (F.col("lo") + step)) / F.col("k")
        state = cut_lineage(chosen.filter(best_case >= min_score))
        width = step
    return (
        state.withColumn("score", (F.col("kept") + F.col("need") * F.col("mean")) / F.col("k"))
        .filter(F.col("score") >= min_score)
        .select(*pair, "score")
    )


def exclude_rejected(scores: DataFrame, rejections: DataFrame) -> DataFrame:
    """Drops (rep, person) pairs a user has rejected."""
    refused = rejections.select(F.col("feature_id").alias("rep_id"), "person_id")
    return scores.join(refused, ["rep_id", "person_id"], "left_anti")


def candidate_people(reps: DataFrame, linked: DataFrame, rejections: DataFrame,
                     min_score: float = CANDIDATE_MIN_SCORE,
                     kept: int = CANDIDATES_KEPT) -> DataFrame:
    """(rep_id, person_id, score, rank): the best people per representative."""
    scores = exclude_rejected(person_scores(reps, linked, min_score), rejections)
    best = Window.partitionBy("rep_id").orderBy(F.desc("score"), "person_id")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= kept)


def enrich_candidates(candidates: DataFrame, person_names: DataFrame,
                      person_features: DataFrame) -> DataFrame:
    """Adds preferred name, name count, first linked face, photo count and the rounded score."""
    names = person_names.groupBy("person_id").agg(
        F.min_by("name", F.struct(~F.col("preferred"), F.col("id"))).alias("name"),
        F.count("*").alias("name_count"),
    )
    faces = person_features.groupBy("person_id").agg(
        F.min_by("feature_id", "id").alias("first_feature_id"),
        F.count("*").alias("photo_count"),
    )
    return (
        candidates.join(names, "person_id", "left")
        .join(faces, "person_id", "left")
        .select(
            "rep_id", "person_id", "rank", "name",
            F.coalesce("name_count", F.lit(0)).alias("name_count"),
            "first_feature_id",
            F.coalesce("photo_count", F.lit(0)).alias("photo_count"),
            round_half_up(F.col("score"), 1000).alias("match_score"),
        )
    )


def ranked_clusters(summary: DataFrame, candidates: DataFrame) -> DataFrame:
    """Clusters with their best candidate and triage tier, in ``cluster_order``."""
    top = candidates.filter("rank = 1").select(
        F.col("rep_id").alias("representative_id"),
        round_half_up(F.col("score"), 1000).alias("top_score"),
        F.col("person_id").alias("top_person_id"),
    )
    return summary.join(top, "representative_id", "left").withColumn(
        "tier", triage_tier(F.col("size"), F.col("top_score"))
    )


def cluster_order() -> list[Column]:
    """Best score first (none last), larger first, lowest id first."""
    return [
        F.coalesce("top_score", F.lit(-1.0)).desc(), F.col("size").desc(),
        F.col("representative_id").asc(),
    ]


def cluster_totals(summary: DataFrame) -> DataFrame:
    """One row (total, total_faces) over all clusters of a listing."""
    return summary.agg(F.count("*").alias("total"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_faces"))


def cluster_page(ranked: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    return page(ranked, cluster_order(), offset, limit)


def triage_tier(size: Column, score: Column) -> Column:
    return (
        F.when((size > 1) & score.isNotNull(), "suggested")
        .when(size > 1, "unsuggested")
        .otherwise("single")
    )
