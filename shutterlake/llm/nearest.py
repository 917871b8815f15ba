"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes.

Codes are learnt from a bounded sample (``sample_rows``): principal directions, then the rotation that
fits their signs best. Every row is coded and indexed. A code is split into substrings of 8 bits, each
with its own table from value to rows. Two codes within Hamming distance r agree in at least one
substring up to its share of r, so probing the values within these shares retrieves every code within
r; these candidates are then ranked by the exact inner product. The radius is learnt too: the true
nearest rows of ``radius_queries`` sample queries are found among all rows, and r covers the distances
of all but a small share of them. Queries that find fewer than k rows within it are asked again with a
wider radius, at last with one that no code exceeds, so every query gets its k rows (all, if fewer).

Rows and queries are dealt by a hash of their row numbers to blocks of bounded size, and each pair of a query
block and a row block is one task's work, so equal vectors and popular regions are spread evenly. Norms
may differ: codes are those of vectors extended by one coordinate to equal norms, which keeps the order
of inner products.

Null ids, null and zero vectors, and vectors holding null or non-finite components take no part; nor do
vectors of another length than the most frequent one (the longer of equally frequent ones). Rows that
repeat an id, with equal or other vectors, are rows of their own: each is a candidate of the others, and
each asks for itself. Only the query's own row is no neighbour of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from shutterlake.session import cut_lineage

PIECE_BITS = 8


@dataclass(frozen=True)
class Codes:
    """Turns vectors into binary codes."""

    longest: float          # largest norm among all rows
    centre: np.ndarray
    directions: np.ndarray  # (dim + 1, bits)
    radius: int = 0

    @property
    def pieces(self) -> int:
        return self.directions.shape[1] // PIECE_BITS

    def of_rows(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest ** 2 - (vectors ** 2).sum(axis=1), 0.0))
        return self._bits(np.column_stack([vectors, rest]) / self.longest)

    def of_queries(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.sqrt((vectors ** 2).sum(axis=1))[:, None]
        return self._bits(np.column_stack([unit, np.zeros(len(unit))]))

    def _bits(self, extended: np.ndarray) -> np.ndarray:
        """(rows, pieces) bytes."""
        return np.packbits((extended - self.centre) @ self.directions > 0, axis=1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, vector) of the rows that take part; ``row`` numbers them."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = (vectors.filter(F.col(id_col).isNotNull() & v.isNotNull())
            .filter(F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
            .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
                    v.alias("vector")))
    good = cut_lineage(good)
    common = good.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return good.filter(F.size("vector") == common["dim"]) if common else good


def matrix(column) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def _sample(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    found = rows.select("row", "vector").orderBy(F.xxhash64("row"), "row").limit(size).toArrow()
    return np.asarray(found["row"]), matrix(found["vector"])


def learn_codes(rows: DataFrame, bits: int = 64, sample_rows: int = 4096, rounds: int = 30) -> Codes:
    """Iterative quantisation: rotate the principal directions so that signs lose least."""
    square = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    longest = math.sqrt(rows.agg(F.max(square)).first()[0])
    _, vectors = _sample(rows, sample_rows)
    rest = np.sqrt(np.maximum(longest ** 2 - (vectors ** 2).sum(axis=1), 0.0))
    x = np.column_stack([vectors, rest]) / longest
    centre = np.append(x[:, :-1].mean(axis=0), 0.0)
    x = x - centre
    width = max(PIECE_BITS, min(bits, vectors.shape[1]) // PIECE_BITS * PIECE_BITS)
    _, _, directions = np.linalg.svd(x, full_matrices=True)
    if len(directions) < width:  # fewer dimensions than bits: further random directions
        more = np.random.default_rng(7).normal(size=(width - len(directions), x.shape[1]))
        directions = np.vstack([directions, more])
    basis = directions[:width].T
    projected = x @ basis
    rotation = np.linalg.qr(np.random.default_rng(7).normal(size=(width, width)))[0]
    for _ in range(rounds):
        signs = np.where(projected @ rotation > 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(signs.T @ projected)
        rotation = (u @ vt).T
    return Codes(longest, centre, basis @ rotation)


def learn_radius(rows: DataFrame, queries: DataFrame, codes: Codes, k: int, radius_queries: int = 64,
                 covered: float = 0.97) -> Codes:
    """The codes with the Hamming radius that covers this share of the sample queries' true neighbours."""
    ids, asked = _sample(queries, radius_queries)
    if not len(ids):
        return codes
    own = codes.of_queries(asked)
    shared = rows.sparkSession.sparkContext.broadcast((codes, ids, asked, own))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, ids, asked, own = shared.value
        scores = np.zeros((len(ids), 0))  # of the best k rows this task has seen, and their distances
        apart = np.zeros((len(ids), 0), dtype=np.int32)
        for batch in batches:
            numbers, vectors = np.asarray(batch.column(0)), matrix(batch.column(1))
            if not len(numbers):
                continue
            fresh = asked @ vectors.T
            fresh[ids[:, None] == numbers[None, :]] = -np.inf
            distance = np.bitwise_count(own[:, None, :] ^ codes.of_rows(vectors)[None, :, :]).sum(axis=2)
            scores, apart = np.hstack([scores, fresh]), np.hstack([apart, distance.astype(np.int32)])
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            scores, apart = np.take_along_axis(scores, top, 1), np.take_along_axis(apart, top, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, scores.shape[1])), pa.array(scores.ravel()), pa.array(apart.ravel())],
            names=["query_id", "score", "apart"])

    found = rows.select("row", "vector").mapInArrow(nearest, "query_id long, score double, apart int")
    ranked = found.filter(F.col("score") > float("-inf")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    apart = sorted(r["apart"] for r in ranked.filter(F.col("rank") <= k).select("apart").collect())
    radius = apart[min(len(apart) - 1, int(covered * len(apart)))] if apart else 0
    return Codes(codes.longest, codes.centre, codes.directions, radius)


class PieceTables:
    """For each substring, the rows of each value."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes = codes
        self.radius = radius
        pieces = codes.shape[1]
        share, extra = divmod(radius, pieces)
        # r = share * pieces + extra: one of the first extra + 1 agrees within share, or another within share - 1
        self.shares = [share if j <= extra else share - 1 for j in range(pieces)]
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(pieces)]
        self.start = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]
        values = np.arange(256, dtype=np.uint8)
        apart = np.bitwise_count(values[:, None] ^ values[None, :])
        self.near = {s: [np.flatnonzero(row <= s) for row in apart] for s in set(self.shares) if s >= 0}

    def within(self, code: np.ndarray) -> np.ndarray:
        """The places of all rows whose code is within the radius."""
        hit = np.zeros(len(self.codes), dtype=bool)
        for j, share in enumerate(self.shares):
            if share < 0:
                continue
            if share >= PIECE_BITS:
                hit[:] = True
                break
            start, order = self.start[j], self.order[j]
            for value in self.near[share][code[j]]:
                hit[order[start[value]:start[value + 1]]] = True
        found = np.flatnonzero(hit)
        apart = np.bitwise_count(self.codes[found] ^ code).sum(axis=1)
        return found[apart <= self.radius]


def search(rows: DataFrame, queries: DataFrame, codes: Codes, k: int = 20, row_block: int = 32_768,
           query_block: int = 8_192) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score): the best k rows within the radius, ties to the smaller id."""
    n_rows, n_queries = rows.count(), queries.count()
    busy = rows.sparkSession.sparkContext.defaultParallelism * 2
    row_blocks = max(1, math.ceil(n_rows / row_block), min(busy, math.ceil(n_rows / 1024)))
    query_blocks = max(1, math.ceil(n_queries / query_block))
    shared = rows.sparkSession.sparkContext.broadcast(codes)

    def block(column: str, count: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = queries.select("row", "vec_id", "vector", F.lit(True).alias("asks"), block("row", query_blocks).alias("q"),
                          every(row_blocks).alias("r"))
    right = rows.select("row", "vec_id", "vector", F.lit(False).alias("asks"), every(query_blocks).alias("q"),
                        block("row", row_blocks).alias("r"))

    def compare(table: pa.Table) -> pa.Table:
        codes = shared.value
        asks = np.asarray(table["asks"].combine_chunks().cast(pa.uint8())).astype(bool)
        ids, vectors, numbers = np.asarray(table["vec_id"]), matrix(table["vector"]), np.asarray(table["row"])
        row_ids, row_numbers, row_vectors = ids[~asks], numbers[~asks], vectors[~asks]
        out: tuple[list, ...] = ([], [], [], [])
        if asks.any() and len(row_ids):
            tables = PieceTables(codes.of_rows(row_vectors), codes.radius)
            for number, query_id, vector, code in zip(numbers[asks], ids[asks], vectors[asks],
                                                      codes.of_queries(vectors[asks])):
                found = tables.within(code)
                found = found[row_numbers[found] != number]
                scores = (row_vectors[found] * vector).sum(axis=1)
                best = np.lexsort((row_ids[found], -scores))[:k]
                out[0].append(np.full(len(best), number))
                out[1].append(np.full(len(best), query_id))
                out[2].append(row_ids[found][best])
                out[3].append(scores[best])
        columns = [np.concatenate(c) if c else np.array([]) for c in out]
        return pa.table({"query_row": pa.array(columns[0].astype(np.int64)),
                         "query_id": pa.array(columns[1].astype(np.int64)),
                         "vec_id": pa.array(columns[2].astype(np.int64)),
                         "score": pa.array(columns[3].astype(np.float64))})

    found = left.unionByName(right).groupBy("q", "r").applyInArrow(
        compare, "query_row long, query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")


def search_widening(rows: DataFrame, queries: DataFrame, codes: Codes, k: int) -> DataFrame:
    """``search``, with twice the radius for the queries it leaves with fewer rows than there are, until all have them."""
    wanted = min(k, rows.count() - 1)
    bits = codes.pieces * PIECE_BITS
    found = cut_lineage(search(rows, queries, codes, k))
    while codes.radius < bits:
        full = found.groupBy("query_row").count().filter(F.col("count") >= wanted)
        short = cut_lineage(queries.join(full, queries["row"] == full["query_row"], "left_anti"))
        if wanted < 1 or short.isEmpty():
            break
        codes = replace(codes, radius=min(bits, max(2 * codes.radius, PIECE_BITS)))
        asked = short.select(F.col("row").alias("query_row"))
        found = cut_lineage(found.join(asked, "query_row", "left_anti").unionByName(search(rows, short, codes, k)))
    return found


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
                       vector_col: str = "embedding", bits: int = 64) -> DataFrame:
    """The k nearest rows of every row for which ``is_query`` (over the id ``vec_id``) holds."""
    rows = usable(vectors, id_col, vector_col)
    queries = rows.filter(is_query)
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = learn_radius(rows, queries, learn_codes(rows, bits), k)
    return search_widening(rows, queries, codes, k).drop("query_row")
