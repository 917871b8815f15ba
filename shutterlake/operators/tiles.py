"""All-against-all comparison in bounded blocks.

Rows are hashed to tiles of some thousand rows; each pair of tiles is one group that numpy
compares strip by strip, and only rows the kernel keeps leave the task. Nothing here depends on how the
values are distributed: a tile's size is set by the row count alone, so skewed values cannot
produce a large task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any, Iterator, Tuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TILE_ROWS = 16_384   # 64 MB of doubles at 512 dimensions
LEAST_TILE_ROWS = 1024
STRIP_ROWS = 512          # rows of the left block handled per matrix product


def tile_count(df: DataFrame) -> int:
    """How many tiles to cut a table into.

    Every row is copied once per tile, so tiles are as large as memory allows, but small enough to
    give all cores a pair of tiles to work on.
    """
    rows = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    busy = math.ceil(math.sqrt(4 * cores))
    return max(1, math.ceil(rows / MOST_TILE_ROWS), min(busy, math.ceil(rows / LEAST_TILE_ROWS)))


def self_tiles(df: DataFrame, id_col: str, kernel: Callable, schema: str,
               tiles: int) -> DataFrame:
    """Every unordered pair of rows meets exactly once in ``kernel(left, right, same)``.

    The kernel yields frames strip by strip, so a task holds one strip of results at a time.
    """
    own = F.pmod(F.xxhash64(id_col), F.lit(tiles)).cast("int")
    spread = (
        df.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        .withColumn("_i", F.least("_own", "_other"))
        .withColumn("_j", F.greatest("_own", "_other"))
        .drop("_other")
    )

    return compare_tiles(spread, kernel, schema)


def compare_tiles(spread: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """Runs ``kernel`` on every pair of tiles (_i, _j) of rows that carry their own tile as ``_own``."""
    def compare(
        key: Tuple[Any, ...], batches: Iterator[pd.DataFrame]
    ) -> Iterator[pd.DataFrame]:
        block = pd.concat(batches, ignore_index=True)
        i, j = key
        if i == j:
            yield from kernel(block, block, True)
        else:
            first = (block["_own"] == i).to_numpy()
            if first.any() and not first.all():
                yield from kernel(block[first], block[~first], False)

    return spread.groupBy("_i", "_j").applyInPandas(compare, schema)


def cross_tiles(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
                kernel: Callable, schema: str, left_tiles: int | Column,
                right_tiles: int | Column, keys: list[str] | None = None) -> DataFrame:
    """Every left row meets every right row (of the same ``keys``) in ``kernel(left, right)``.

    Tile counts may be columns, so that only oversized key groups are cut up.
    """
    keys = keys or []

    def as_col(tiles):
        return F.lit(tiles) if isinstance(tiles, int) else tiles

    lt, rt = as_col(left_tiles), as_col(right_tiles)
    spread_left = left.withColumn("_i", F.pmod(F.xxhash64(left_id), lt).cast("int")).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), (rt - 1).cast("int")))
    )
    spread_right = right.withColumn("_j", F.pmod(F.xxhash64(right_id), rt).cast("int")).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), (lt - 1).cast("int")))
    )
    # fresh column identities: both sides may come from the same table
    spread_right = spread_right.select(*[F.col(c).alias(c) for c in spread_right.columns])
    on = [*keys, "_i", "_j"]
    names = [part.split()[0] for part in schema.split(",")]

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({n: [] for n in names})
        return kernel(a, b)

    return (
        spread_left.groupBy(*on)
        .cogroup(spread_right.groupBy(*on))
        .applyInPandas(compare, schema)
    )


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_list()).astype(np.float64)


def scored_pairs(left: pd.DataFrame, right: pd.DataFrame, same: bool, id_col: str,
                 score: Callable, keep: Callable) -> Iterator[tuple]:
    """(smaller ids, larger ids, scores) of the kept pairs, one strip at a time."""
    lid, rid = left[id_col].to_numpy(), right[id_col].to_numpy()
    for start in range(0, len(lid), STRIP_ROWS):
        stop = min(start + STRIP_ROWS, len(lid))
        scores = score(start, stop)
        hit = keep(scores)
        if same:
            hit &= lid[start:stop, None] < rid[None, :]
        rows, cols = np.nonzero(hit)
        a, b = lid[start:stop][rows], rid[cols]
        yield np.minimum(a, b), np.maximum(a, b), scores[rows, cols]


def products_from(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of ``a``, rows of ``b``, products) of the pairs with a product >= ``threshold``, strip by strip.

    Products in single precision, less their rounding, rule pairs out; those that remain are computed in double
    precision. Vectors too long for single precision are compared in double precision at once.
    """
    longest = [float(np.sqrt((x * x).sum(axis=1).max(initial=0))) for x in (a, b)]
    # any order of summing is off by n * eps * |a| * |b| at most, twice that for rounding the values
    slack = 2 * (a.shape[1] + 2) * float(np.finfo(np.float32).eps) * longest[0] * longest[1] + 1e-30
    narrow = np.float32 if max(longest) < 1e15 else np.float64
    left, right = a.astype(narrow), b.astype(narrow).T
    least = np.nextafter(narrow(threshold - slack), narrow(-np.inf)) if narrow is np.float32 else threshold
    for start in range(0, len(left), STRIP_ROWS):
        places = np.flatnonzero(left[start:start + STRIP_ROWS] @ right >= least)
        rows, cols = np.divmod(places, right.shape[1])
        rows += start
        scores = np.einsum("ij,ij->i", a[rows], b[cols])
        kept = scores >= threshold
        yield rows[kept], cols[kept], scores[kept]
