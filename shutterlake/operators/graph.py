"""Graphs and trees: connected components, bounded breadth-first search, folder chains."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.keyed import dense_number
from shutterlake.session import cut_lineage

MAX_ROUNDS = 64
SOURCES_A_BITMAP = 64
MOST_BROADCAST = 500_000  # rows of ids and bitmaps, some 30 MB


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): component = lowest id reachable over undirected edges.

    Alternating large-star / small-star contraction (Kiveris et al., SoCC 2014). Each half-round is
    a min-aggregate, which combines before the shuffle, and an equi-join with one row per key, which
    adaptive execution splits where a hub is skewed. Each round is written to the
    shared folder.
    """
    state = cut_lineage(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .filter("u <> v")
        .distinct()
    )
    seen = _signature(state)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            break
        state = cut_lineage(_small_star(_large_star(state)))
        now = _signature(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not converge")
    roots = state.select("v").distinct()
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("id"), F.col("v").alias("component"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.filter("v > u")
        .join(lowest, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest one."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (
        edges.join(lowest, "u")
        .filter("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def undirected(edges: DataFrame, src: str, dst: str) -> DataFrame:
    forward = edges.select(F.col(src).alias("node"), F.col(dst).alias("neighbour"))
    backward = edges.select(F.col(dst).alias("node"), F.col(src).alias("neighbour"))
    return forward.unionByName(backward)


def reachable(edges: DataFrame, sources: DataFrame, depth: int = 10, src: str = "src",
              dst: str = "dst") -> DataFrame:
    """(source, node, hops): nodes within ``depth`` hops of each source id, sources excluded."""
    return walk(cut_lineage(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))), sources, depth)


def walk(links: DataFrame, sources: DataFrame, depth: int, members: DataFrame | None = None) -> DataFrame:
    """``reachable`` over stored links (a, b).

    Level-synchronous, for all sources at once: a node of a level carries one bitmap for each ``SOURCES_A_BITMAP``
    sources it was reached from, so that a hop reads the links once in each direction, whatever the number of
    sources, and adds up bitmaps before they are shuffled. The links stay where they are: the level is
    broadcast, in parts of at most ``MOST_BROADCAST`` rows. Each level is written out, ends early on an empty one.

    With ``members`` (id, rep) links are between ids, and sources and nodes are reps: a hop leads from all ids of
    a rep, and ids without a rep lead nowhere.
    """
    start = cut_lineage(dense_number(sources.select(F.col("id").alias("source")).distinct(), ["source"], "number"))
    place = F.col("number") - 1
    frontier = start.select(
        F.col("source").alias("node"), F.floor(place / SOURCES_A_BITMAP).cast("int").alias("batch"),
        F.expr(f"shiftleft(1L, cast((number - 1) % {SOURCES_A_BITMAP} AS int))").alias("bits"))
    named = None if members is None else cut_lineage(members.select("id", "rep").filter("id IS NOT NULL").distinct())
    before, levels = frontier.filter("false"), []
    for hop in range(1, depth + 1):
        step = _neighbour_bits(links, frontier if named is None else frontier.join(
            named, F.col("node") == F.col("rep")).select(F.col("id").alias("node"), "batch", "bits"))
        if named is not None:
            step = _added_up(step.join(named, F.col("node") == F.col("id")).select(F.col("rep").alias("node"), "batch", "bits"))
        # links go both ways: a step leads at most one level back
        known = _added_up(frontier.unionByName(before)).withColumnRenamed("bits", "known")
        fresh = step.join(known, ["node", "batch"], "left").select(
            "node", "batch", F.expr("bits & ~coalesce(known, 0L)").alias("bits")).filter("bits <> 0")
        before, frontier = frontier, cut_lineage(fresh)
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("hops", F.lit(hop)))
    every = before.filter("false").withColumn("hops", F.lit(0))
    for level in levels:
        every = every.unionByName(level)
    held = F.filter(F.sequence(F.lit(0), F.lit(SOURCES_A_BITMAP - 1)),
                    lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    return (every.select("node", "hops", "batch", F.explode(held).alias("bit"))
            .withColumn("number", F.col("batch").cast("long") * SOURCES_A_BITMAP + F.col("bit") + 1)
            .join(start, "number").select("source", "node", "hops"))


def _added_up(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node", "batch").agg(F.bit_or("bits").alias("bits"))


def _neighbour_bits(links: DataFrame, level: DataFrame) -> DataFrame:
    """(node, batch, bits): the bitmaps of the level's (node, batch, bits) put together for each neighbour."""
    level = level.select(F.col("node").alias("near"), "batch", "bits")
    steps = [links.join(part, F.col(here) == F.col("near")).select(F.col(there).alias("node"), "batch", "bits")
             for part in broadcast_parts(level, "near") for here, there in (("a", "b"), ("b", "a"))]
    return _added_up(reduce(DataFrame.unionByName, steps))


def broadcast_parts(rows: DataFrame, key: str) -> list[DataFrame]:
    """``rows`` in parts of about ``MOST_BROADCAST`` rows by a hash of the key, each with a broadcast hint."""
    parts = max(1, ceil(rows.count() / MOST_BROADCAST))
    if parts == 1:
        return [F.broadcast(rows)]
    return [F.broadcast(rows.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == part)) for part in range(parts)]


def folder_chains(folders: DataFrame) -> DataFrame:
    """(id, parent_id, name, path, depth, chain): names and ids from the root down to the folder.

    Pointer doubling: every round joins each folder's prefix with its ancestor's, so the number of
    rounds is the logarithm of the tree depth. A parent that does not exist counts as no parent.
    """
    state = folders.select(
        "id", "parent_id", "name",
        F.col("parent_id").alias("above"),
        F.col("name").alias("path"),
        F.array("id").alias("chain"),
    )
    for _ in range(MAX_ROUNDS):
        upper = state.select(
            F.col("id").alias("_id"), F.col("above").alias("_above"),
            F.col("path").alias("_path"), F.col("chain").alias("_chain"),
        )
        state = cut_lineage(
            state.join(upper, F.col("above") == F.col("_id"), "left").select(
                "id", "parent_id", "name",
                F.col("_above").alias("above"),
                F.when(F.col("_id").isNull(), F.col("path"))
                .otherwise(F.concat_ws("/", "_path", "path")).alias("path"),
                F.when(F.col("_id").isNull(), F.col("chain"))
                .otherwise(F.concat("_chain", "chain")).alias("chain"),
            )
        )
        if state.filter(F.col("above").isNotNull()).isEmpty():
            return state.select(
                "id", "parent_id", "name", "path", F.size("chain").alias("depth"), "chain"
            )
    raise RuntimeError("folder tree has a cycle")
