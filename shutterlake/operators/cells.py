"""Joins of vectors by dot product that do not compare everything: pivot cells (exact), hyperplanes (approximate).

Both fill the blocks of ``operators.tiles``; what they save is the copies of a row and the blocks it meets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.tiles import MOST_TILE_ROWS, compare_tiles, cross_tiles, matrix, self_tiles, tile_count
from shutterlake.session import cut_lineage

MOST_PIVOTS = 1024
CELL_ROWS = 4096      # rows of a cell, on average, until there are MOST_PIVOTS cells
SLACK = 1e-6          # distances are rounded
MOST_VISITED = 0.5    # share of the tiles a row meets on average, beyond which cells are not worth it
BUCKET_ROWS = 4096    # rows of a hyperplane bucket, on average
RECALL = 0.95
SEED = 20240229


# --- exact: pivot cells -----------------------------------------------------------------------

class Cells:
    """Pivots with what bounds the rows of their cells; at most MOST_PIVOTS of them."""

    def __init__(self, pivots: np.ndarray, bounds: pd.DataFrame, threshold: float, tile_rows: int):
        self.pivots, self.threshold = pivots, threshold
        bounds = bounds.set_index("cell").reindex(range(len(pivots)))
        self.nearest = bounds["nearest"].fillna(np.inf).to_numpy()
        self.farthest = bounds["farthest"].fillna(-np.inf).to_numpy()
        self.norm = bounds["norm"].fillna(-np.inf).to_numpy()   # largest squared length
        self.subs = np.ceil(bounds["n"].fillna(0) / tile_rows).astype(int).to_numpy()
        self.first = np.concatenate([[0], np.cumsum(self.subs)])

    def visited(self, vectors: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which cells can hold a vector whose product with the row reaches the threshold.

        a.b >= t means d(a, b)**2 <= |a|**2 + |b|**2 - 2t = R**2. A vector b of cell j lies between the nearest
        and farthest distance from its pivot and is no nearer to any other pivot, so that by the
        triangle inequality nearest - R <= d(a, p_j) <= farthest + R and d(a, p_j) <= d(a, own pivot) + 2R.
        """
        gap = distances(vectors, self.pivots)
        square = (vectors * vectors).sum(axis=1)[:, None] + self.norm[None, :] - 2 * self.threshold
        reach = np.sqrt(np.maximum(square, 0)) + SLACK
        at_home = gap[np.arange(len(gap)), own][:, None]
        return ((square >= -SLACK) & (gap <= self.farthest + reach) & (gap >= self.nearest - reach)
                & (gap <= at_home + 2 * reach))


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = ((vectors * vectors).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :]
              - 2 * vectors @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def pivot_visits(vectors: DataFrame, id_col: str, threshold: float, pivots: int,
                 tile_rows: int = MOST_TILE_ROWS) -> DataFrame:
    """(id, embedding, _own, tiles): the row's tile, and the tiles it has to meet, its own included.

    A tile is a part of a cell with about ``tile_rows`` rows at most. Two rows that reach the threshold each list
    the other's tile.
    """
    chosen = vectors.orderBy(F.xxhash64(id_col), id_col).limit(min(pivots, MOST_PIVOTS)).select("embedding")
    points = matrix(pd.Series([r["embedding"] for r in chosen.collect()]))
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast(points)
    id_type = vectors.schema[id_col].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = matrix(batch["embedding"])
            gap = distances(rows, shared.value)
            cell = gap.argmin(axis=1)
            yield pd.DataFrame({id_col: batch[id_col], "embedding": batch["embedding"], "cell": cell,
                                "gap": gap[np.arange(len(gap)), cell], "norm": (rows * rows).sum(axis=1)})

    named = cut_lineage(vectors.select(id_col, "embedding").mapInPandas(
        assign, f"{id_col} {id_type}, embedding ARRAY<FLOAT>, cell INT, gap DOUBLE, norm DOUBLE"))
    bounds = named.groupBy("cell").agg(
        F.min("gap").alias("nearest"), F.max("gap").alias("farthest"), F.max("norm").alias("norm"),
        F.count("*").alias("n")).toPandas()  # a row per pivot
    cells = context.broadcast(Cells(points, bounds, threshold, tile_rows))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = cells.value
        for batch in batches:
            own = batch["cell"].to_numpy()
            meets = known.visited(matrix(batch["embedding"]), own)
            tiles = [np.concatenate([np.arange(known.first[j], known.first[j + 1]) for j in np.flatnonzero(row)])
                     .astype(np.int32) for row in meets]
            part = batch["part"].to_numpy() % known.subs[own]
            yield pd.DataFrame({id_col: batch[id_col], "embedding": batch["embedding"],
                                "_own": (known.first[own] + part).astype(np.int32), "tiles": tiles})

    dealt = named.withColumn("part", F.pmod(F.xxhash64(id_col), F.lit(1 << 30)))
    return dealt.drop("gap", "norm").mapInPandas(
        visit, f"{id_col} {id_type}, embedding ARRAY<FLOAT>, _own INT, tiles ARRAY<INT>")


def cell_tiles(vectors: DataFrame, id_col: str, kernel: Callable, schema: str, threshold: float,
               pivots: int, tile_rows: int = MOST_TILE_ROWS) -> DataFrame:
    """As ``self_tiles``, for kernels that only keep pairs with a product >= ``threshold``.

    Where the bounds rule out less than half of the tiles, all rows meet in ``self_tiles``, which are larger than
    cells, so that a row is copied less often.
    """
    visits = cut_lineage(pivot_visits(vectors, id_col, threshold, pivots, tile_rows))
    seen = visits.agg(F.count("*").alias("rows"), F.sum(F.size("tiles")).alias("copies"),
                      F.count_distinct("_own").alias("tiles")).first()
    if seen["copies"] > MOST_VISITED * seen["rows"] * seen["tiles"]:
        return self_tiles(vectors, id_col, kernel, schema, tile_count(vectors))
    spread = (
        visits
        .withColumn("_other", F.explode("tiles"))
        .withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
        .drop("_other", "tiles")
    )
    return compare_tiles(spread, kernel, schema)


# --- approximate: hyperplanes -----------------------------------------------------------------

def table_count(bits: int, threshold: float, recall: float) -> int:
    """Hash tables so that a pair of unit vectors at the threshold shares a bucket with this probability.

    A random hyperplane leaves two vectors on one side with probability 1 - angle / pi.
    """
    together = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return 1 if together >= recall else math.ceil(math.log(1 - recall) / math.log(1 - together))


def bucket_bits(rows: int) -> int:
    """Hyperplanes of a table so that its buckets hold about BUCKET_ROWS rows."""
    return max(1, round(math.log2(max(1, rows) / BUCKET_ROWS) + 0.5))


def hashing_saves(rows: int, threshold: float, recall: float) -> bool:
    """Whether the tables that the recall asks for compare fewer rows than each pair once does.

    A table compares a share of 2**-bits of all pairs, from both sides. Low thresholds and high recalls ask for so many
    tables that comparing everything is less work, and misses nothing.
    """
    bits = bucket_bits(rows)
    return 2 * table_count(bits, threshold, recall) < 1 << bits


def hyperplane_pairs(vectors: DataFrame, id_col: str, kernel: Callable, schema: str, threshold: float,
                     recall: float = RECALL, bits: int | None = None, seed: int = SEED) -> DataFrame:
    """Pairs of unit vectors that share a bucket of some hash table, compared by ``kernel(left, right)``.

    Each table hashes a row to the sides of ``bits`` random hyperplanes, as many as make buckets of about BUCKET_ROWS
    rows; larger buckets are compared in tiles. A pair at the threshold is met with probability
    ``recall`` at least, a more similar one with a higher one, and may be met in several tables.
    """
    if not 0 < recall < 1:
        raise ValueError("recall must lie between 0 and 1")
    bits = bits or bucket_bits(vectors.count())
    tables = table_count(bits, threshold, recall)
    id_type = vectors.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            rows = matrix(batch["embedding"])
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(rows.shape[1], tables * bits))
            sides = (rows @ planes > 0).reshape(len(rows), tables, bits)
            yield pd.DataFrame({id_col: batch[id_col], "embedding": batch["embedding"],
                                "buckets": list((sides * weights).sum(axis=2))})

    codes = vectors.select(id_col, "embedding").mapInPandas(
        hashed, f"{id_col} {id_type}, embedding ARRAY<FLOAT>, buckets ARRAY<BIGINT>")
    rows = cut_lineage(codes).select(id_col, "embedding", F.posexplode("buckets").alias("_table", "_bucket"))
    keys = ["_table", "_bucket"]
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / (2 * BUCKET_ROWS)).cast("int").alias("_tiles"),
                                    F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    left = rows.join(sizes, keys)
    right = left.select(*[F.col(c).alias(c) for c in left.columns])
    return cross_tiles(left, right, id_col, id_col, kernel, schema, F.col("_tiles"), F.col("_tiles"), keys=keys)
