"""Face similarity: all-pairs join, search, match table, neighbours, transitive matches."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.vectors import (
    MATCH_THRESHOLD,
    cosine,
    embedding_from_info,
    valid_embedding,
)
from shutterlake.operators.cells import CELL_ROWS, RECALL, cell_tiles, hashing_saves, hyperplane_pairs
from shutterlake.operators.graph import broadcast_parts, undirected, walk
from shutterlake.operators.keyed import page
from shutterlake.operators.neardup import canonical_match_insert
from shutterlake.operators.tiles import (
    MOST_TILE_ROWS,
    STRIP_ROWS,
    cross_tiles,
    matrix,
    products_from,
    self_tiles,
    tile_count,
)
from shutterlake.session import cut_lineage

BFS_DEPTH = 10

PAIR_SCHEMA = "feature_id BIGINT, matching_feature_id BIGINT, similarity DOUBLE"


def parse_features(features: DataFrame) -> DataFrame:
    """Adds ``embedding`` from the info JSON where it is not a column yet."""
    if "embedding" in features.columns:
        return features
    return features.withColumn("embedding", embedding_from_info(F.col("info")))


def with_valid_embedding(features: DataFrame) -> DataFrame:
    return parse_features(features).filter(valid_embedding(F.col("embedding")))


# --- similarity join --------------------------------------------------------------------------

def vector_groups(features: DataFrame) -> DataFrame:
    """(rep, embedding, copies): one row per distinct vector, represented by its lowest id."""
    return (
        with_valid_embedding(features)
        .groupBy("embedding")
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        .select("rep", "embedding", "copies")
    )


def vector_members(features: DataFrame) -> DataFrame:
    """(id, rep): the lowest id with the same vector, for every feature with a valid one."""
    groups = vector_groups(features).select("embedding", "rep")
    return with_valid_embedding(features).join(groups, "embedding").select("id", "rep")


def similarity_join(features: DataFrame, threshold: float = MATCH_THRESHOLD, approx: bool = False,
                    recall: float = RECALL) -> DataFrame:
    """Pairs with cosine >= threshold: (feature_id, matching_feature_id, similarity).

    Exact, unless ``approx``. Equal vectors are folded into their lowest id first: the result has every pair of
    distinct vectors plus one link from each lowest id to each of its copies, from which all
    matches of any feature follow (``neighbours``). Blocks of distinct vectors are compared by
    matrix product; a pair below the threshold never leaves its task. Large tables are dealt to cells around
    pivots, and a row only meets the cells that distance bounds cannot rule out; these bounds save much at
    high thresholds and little below 0.7. With ``approx`` rows only meet where random hyperplanes put
    them together: every pair found is right, and a pair is found with probability ``recall`` at least. Where
    that takes more comparisons than all pairs do, these are compared, and none is missed.
    """
    if not 0 < recall < 1:
        raise ValueError("recall must lie between 0 and 1")
    groups = vector_groups(features)
    if approx and hashing_saves(groups.count(), threshold, recall):
        pairs = _hashed_pairs(groups, threshold, recall)
    else:
        pairs = distinct_vector_pairs(groups, threshold)
    links = (
        with_valid_embedding(features)
        .join(groups.filter("copies > 1").select("embedding", "rep"), "embedding")
        .filter(F.col("id") != F.col("rep"))
        .select(
            F.col("rep").alias("feature_id"),
            F.col("id").alias("matching_feature_id"),
            cosine(F.col("embedding"), F.col("embedding")).alias("similarity"),
        )
        .filter(F.col("similarity") >= threshold)
    )
    return pairs.unionByName(links)


def distinct_vector_pairs(groups: DataFrame, threshold: float, cell_rows: int = CELL_ROWS,
                          tile_rows: int = MOST_TILE_ROWS) -> DataFrame:
    vectors = groups.select("rep", "embedding")

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool):
        a = matrix(left["embedding"])
        b = a if same else matrix(right["embedding"])
        if a.shape[1] != b.shape[1]:
            raise ValueError("vectors differ in length")
        lid, rid = left["rep"].to_numpy(), right["rep"].to_numpy()
        for rows, cols, score in products_from(a, b, threshold):
            small, large = lid[rows], rid[cols]
            if same:
                once = small < large
                small, large, score = small[once], large[once], score[once]
            yield pd.DataFrame({"feature_id": np.minimum(small, large), "matching_feature_id": np.maximum(small, large),
                                "similarity": score})

    pivots = vectors.count() // cell_rows
    if pivots < 2:
        return self_tiles(vectors, "rep", kernel, PAIR_SCHEMA, tile_count(vectors))
    return cell_tiles(vectors, "rep", kernel, PAIR_SCHEMA, threshold, pivots, tile_rows)


def _hashed_pairs(groups: DataFrame, threshold: float, recall: float) -> DataFrame:
    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        scores = matrix(a["embedding"]) @ matrix(b["embedding"]).T
        small, large = a["rep"].to_numpy(), b["rep"].to_numpy()
        rows, cols = np.nonzero((scores >= threshold) & (small[:, None] < large[None, :]))
        return pd.DataFrame({"feature_id": small[rows], "matching_feature_id": large[cols],
                             "similarity": scores[rows, cols]})

    met = hyperplane_pairs(groups.select("rep", "embedding"), "rep", kernel, PAIR_SCHEMA, threshold, recall)
    return met.dropDuplicates(["feature_id", "matching_feature_id"])


def hit_links(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray,
              threshold: float) -> pd.DataFrame:
    """(src, dst): a link from the lowest id to every other of each component that the hits make.

    Rows of ``a`` and ``b`` are named by ``left`` and ``right``; several rows may have one name.
    """
    ids = np.unique(np.concatenate([left, right]))
    of_left, of_right = np.searchsorted(ids, left), np.searchsorted(ids, right)
    label = np.arange(len(ids))
    for start in range(0, len(a), STRIP_ROWS):
        rows, cols = np.nonzero(a[start:start + STRIP_ROWS] @ b.T >= threshold)
        u, v = of_left[rows + start], of_right[cols]
        while True:
            low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
            apart = low < high
            if not apart.any():
                break
            np.minimum.at(label, high[apart], low[apart])
            while not np.array_equal(label, label[label]):
                label = label[label]
    moved = label != np.arange(len(ids))
    return pd.DataFrame({"src": ids[label[moved]], "dst": ids[moved]})


def component_links(groups: DataFrame, threshold: float) -> DataFrame:
    """(src, dst) links that connect the same vectors as all pairs >= threshold do.

    Each pair of tiles contracts its hits to local components and emits one link per member, so the
    output is linear in the rows compared however dense the similarity graph is.
    """
    vectors = groups.select("rep", "embedding")

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool):
        a = matrix(left["embedding"])
        b = a if same else matrix(right["embedding"])
        yield hit_links(a, b, left["rep"].to_numpy(), right["rep"].to_numpy(), threshold)

    return self_tiles(vectors, "rep", kernel, "src BIGINT, dst BIGINT", tile_count(vectors))


def search_block(a: pd.DataFrame, b: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Hits of the queries ``a`` in the features ``b``, for a strip of queries at a time."""
    query_ids, feature_ids = a["query_id"].to_numpy(), b["feature_id"].to_numpy()
    asked_for, others = matrix(a["embedding"]), matrix(b["embedding"]).T
    out = []
    for start in range(0, len(a), STRIP_ROWS):
        scores, ids = asked_for[start:start + STRIP_ROWS] @ others, query_ids[start:start + STRIP_ROWS]
        rows, cols = np.nonzero((scores >= threshold) & (ids[:, None] != feature_ids[None, :]))
        out.append(pd.DataFrame({
            "query_id": ids[rows], "feature_id": feature_ids[cols], "similarity": scores[rows, cols],
        }))
    return pd.concat(out)


def similarity_search(queries: DataFrame, features: DataFrame,
                      threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """(query_id, feature_id, similarity) for query vectors against the whole table.

    Both sides are dealt to bounded blocks by a hash of their ids, as many as their sizes ask for; a
    handful of queries is one block that meets every block of the table.
    """
    asked = with_valid_embedding(queries).select(F.col("id").alias("query_id"), "embedding")
    table = with_valid_embedding(features).select(F.col("id").alias("feature_id"), "embedding")

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return search_block(a, b, threshold)

    return cross_tiles(
        asked, table, "query_id", "feature_id", kernel,
        "query_id BIGINT, feature_id BIGINT, similarity DOUBLE", tile_count(asked), tile_count(table),
    )


def backfill_matches(features: DataFrame, existing: DataFrame,
                     threshold: float = MATCH_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(new match rows, one-row report) of matching the whole feature table again.

    The report has processed (valid embeddings), new_matches and total_matches.
    """
    found = similarity_join(features, threshold)
    fresh = canonical_match_insert(existing, found, "feature_id", "matching_feature_id")
    counts = (
        with_valid_embedding(features).select(F.lit("processed").alias("k"))
        .unionByName(fresh.select(F.lit("new").alias("k")))
        .unionByName(existing.select(F.lit("old").alias("k")))
    )
    report = counts.agg(
        F.count_if(F.col("k") == "processed").alias("processed"),
        F.count_if(F.col("k") == "new").alias("new_matches"),
        F.count_if(F.col("k").isin("new", "old")).alias("total_matches"),
    )
    return fresh, report


# --- match graph ------------------------------------------------------------------------------

def active_matches(matches: DataFrame) -> DataFrame:
    if "ignore_match" not in matches.columns:
        return matches
    return matches.filter(~F.coalesce(F.col("ignore_match"), F.lit(False)))


def _folded(matches: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active matches as (src, dst) between different representatives, and (id, rep) of the faces whose
    link to an equal vector is active."""
    ends = undirected(active_matches(matches), "feature_id", "matching_feature_id")
    near = members.select(F.col("id").alias("node"), F.col("rep").alias("src"))
    far = members.select(F.col("id").alias("neighbour"), F.col("rep").alias("dst"))
    both = ends.join(near, "node").join(far, "neighbour")
    edges = both.filter("src <> dst").select("src", "dst").distinct()
    alike = both.filter("src = dst").select(F.col("node").alias("id"), F.col("src").alias("rep")).distinct()
    return edges, alike


def neighbours(matches: DataFrame, members: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(node, neighbour) of the given faces (all by default), ignored matches left out.

    ``matches`` are those of ``similarity_join``, where equal vectors are folded into their lowest id;
    ``members(id, rep)`` says how (``vector_members``). Every copy gets all the matches of its vector
    and its other copies. The output is as large as the answer for the faces asked for.
    """
    edges, alike = _folded(matches, members)
    asked = members if ids is None else members.join(ids.select("id"), "id", "left_semi")
    other = members.select(F.col("id").alias("neighbour"), F.col("rep").alias("dst"))
    far = (asked.select(F.col("id").alias("node"), F.col("rep").alias("src")).join(edges, "src")
           .join(other, "dst").select("node", "neighbour"))
    return far.unionByName(_copies(alike, asked))


def _alike(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, rep) of the faces with a link to an equal vector, as ``_folded`` gives them, of vectors with copies.

    Only these are joined with the links, in parts that are broadcast; both ends of a link are in one part.
    """
    named = members.filter("id IS NOT NULL").distinct()
    several = cut_lineage(named.join(named.groupBy("rep").count().filter("count > 1"), "rep").select("id", "rep"))
    found = []
    for part in broadcast_parts(several, "rep"):
        near = part.select(F.col("id").alias("a"), "rep")
        far = part.select(F.col("id").alias("b"), F.col("rep").alias("_rep"))
        both = links.join(F.broadcast(near), "a").join(F.broadcast(far), "b").filter("rep = _rep")
        found.append(both.select(F.explode(F.array("a", "b")).alias("id"), "rep"))
    return reduce(DataFrame.unionByName, found).distinct()


def _copies(alike: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, neighbour): the other faces with the vector of each face asked for."""
    nodes = alike.join(asked.select("id"), "id", "left_semi").select(F.col("id").alias("node"), "rep")
    others = alike.select(F.col("id").alias("neighbour"), "rep")
    return nodes.join(others, "rep").filter("node <> neighbour").select("node", "neighbour")


def transitive_matches(matches: DataFrame, features: DataFrame, sources: DataFrame,
                       depth: int = BFS_DEPTH) -> DataFrame:
    """(source, item_id, feature_id): items reached within ``depth`` hops, lowest feature each.

    The search walks representatives of equal vectors only, so a link between copies costs no hop.
    Faces given without vectors stand for themselves.
    """
    if "embedding" in features.columns or "info" in features.columns:
        members = cut_lineage(vector_members(features))
    else:
        members = features.select("id", F.col("id").alias("rep"))
    # matches are made once: written as pairs, read by every hop
    links = cut_lineage(active_matches(matches).select(
        F.col("feature_id").alias("a"), F.col("matching_feature_id").alias("b")))
    alike = _alike(links, members)
    asked = members.join(sources.select("id").distinct(), "id", "left_semi")
    starts = asked.select(F.col("rep").alias("id")).distinct()
    reached = walk(links, starts, depth, members).select(
        F.col("source").alias("start"), F.col("node").alias("rep"))
    far = (asked.select(F.col("id").alias("source"), F.col("rep").alias("start")).join(reached, "start")
           .join(members.withColumnRenamed("id", "node"), "rep").select("source", "node"))
    own = _copies(alike, asked).select(F.col("node").alias("source"), F.col("neighbour").alias("node"))
    owner = features.select(F.col("id").alias("node"), "item_id")
    return (
        far.unionByName(own).join(owner, "node")
        .groupBy("source", "item_id")
        .agg(F.min("node").alias("feature_id"))
    )


def matching_faces_page(found: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of ``transitive_matches`` with the number of items of each source as ``total``."""
    totals = found.groupBy("source").agg(F.count("*").alias("total"))
    return page(found.join(totals, "source"), ["source", "item_id", "feature_id"], offset, limit)


def apply_match_ignores(matches: DataFrame, pairs: DataFrame, ignored: bool = True) -> DataFrame:
    """Sets the ignore flag on pairs named in either order."""
    marks = pairs.select(
        F.least("feature_id", "matching_feature_id").alias("_lo"),
        F.greatest("feature_id", "matching_feature_id").alias("_hi"),
        F.lit(True).alias("_hit"),
    ).distinct()
    joined = matches.withColumns({
        "_lo": F.least("feature_id", "matching_feature_id"),
        "_hi": F.greatest("feature_id", "matching_feature_id"),
    }).join(marks, ["_lo", "_hi"], "left")
    flag = F.when(F.col("_hit"), F.lit(ignored)).otherwise(F.col("ignore_match"))
    return joined.withColumn("ignore_match", flag).select(*matches.columns)


def apply_face_ignores(features: DataFrame, batch: DataFrame) -> DataFrame:
    """Sets or clears ``ignored`` from a batch of (id, ignored)."""
    marks = batch.groupBy("id").agg(F.max("ignored").alias("_flag"))
    return (
        features.join(marks, "id", "left")
        .withColumn("ignored", F.coalesce("_flag", "ignored"))
        .select(*features.columns)
    )


def ignored_faces(features: DataFrame) -> DataFrame:
    return features.filter("ignored").select("id", "item_id")


def apply_rejections(rejections: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds and removes (feature_id, person_id) rejections; both idempotent.

    ``batch`` has feature_id, person_id, rejected, created_at; a pair both added and removed in one
    batch ends up removed.
    """
    keys = ["feature_id", "person_id"]
    removed = batch.filter(~F.col("rejected")).select(*keys).distinct()
    added = (
        batch.filter("rejected")
        .groupBy(*keys)
        .agg(F.min("created_at").alias("created_at"))
        .join(rejections.select(*keys), keys, "left_anti")
    )
    merged = rejections.select(*keys, "created_at").unionByName(added)
    return merged.join(removed, keys, "left_anti")


def reembed_worklist(features: DataFrame, items: DataFrame, links: DataFrame, files: DataFrame,
                     paths: DataFrame, valid_landmarks) -> DataFrame:
    """(feature_id, item_id, path, usable): the primary file each feature must be re-read from.

    ``valid_landmarks`` is a boolean column over the feature rows.
    """
    from shutterlake.functions.files import full_path

    primary = links.filter("is_primary").select(
        F.col("media_item_id").alias("item_id"), "file_id"
    )
    located = files.select(
        F.col("id").alias("file_id"), F.col("name").alias("_name"), "extension", "path_id"
    ).join(paths.select(F.col("id").alias("path_id"), "dir"), "path_id")
    return (
        features.withColumn("usable", valid_landmarks)
        .select(F.col("id").alias("feature_id"), "item_id", "usable")
        .join(items.select(F.col("id").alias("item_id")), "item_id")
        .join(primary, "item_id")
        .join(located, "file_id")
        .select(
            "feature_id", "item_id",
            full_path(F.col("dir"), F.col("_name"), F.col("extension")).alias("path"),
            "usable",
        )
    )


def reembed_counts(features: DataFrame, worklist: DataFrame) -> DataFrame:
    """One row (total, updated, skipped): features that can be read again from a file, and those left as they are."""
    totals = features.agg(F.count("*").alias("total"))
    updated = worklist.filter("usable").agg(F.count_distinct("feature_id").alias("updated"))
    return totals.select("total", updated.scalar().alias("updated")).withColumn(
        "skipped", F.col("total") - F.col("updated"))
