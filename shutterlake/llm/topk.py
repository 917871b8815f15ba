"""Exact top-k search by inner product: postings, term-at-a-time accumulation, partition selection, merge.

Vectors are sparse rows of (term, weight), a term being a component's place and its weight
floor(scale * x); zero weights are left out. The table is cut into blocks of bounded size, each kept as
postings: per term the places of its rows and their weights (one weight per row, without places, for a
term that more than half of the rows hold). A query walks its own terms, adds weight times postings into
a dense array with one score per row of the block, and takes the block's best k by partition selection;
the blocks' bests are merged by rank. Queries and blocks meet in a grid of groups, so a task holds one
block, one group of queries and one array of scores, at every size of the table.

Defined results: vectors that are null or hold a null or non-finite component take no part. Shorter
vectors hold no weight in the missing terms; empty and zero vectors score 0 with everything. Every row is
a candidate of every query but its own row, also where ids repeat; repeated query ids give their ranks
once per row. A null id is no query; as a candidate it comes last among equal scores. Sums are exact;
weights and scores beyond 64 bits count as the nearest 64-bit number. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import arrow_schema
from shutterlake.session import cut_lineage

BLOCK_ROWS = 16_384    # rows of a block: the length of a dense array of scores
LEAST_BLOCK = 1024     # smaller blocks are not worth a task
GROUP_QUERIES = 4096   # queries that meet a block in one task, on average
LONGEST = 2 ** 63 - 1

BLOCKS = ("cell int, block long, ids array<long>, terms binary, sizes binary, places binary, weights binary, "
          "asked binary, query_ends binary, query_terms binary, query_weights binary, n_queries long")
FOUND = "query_block long, query_place int, query_id long, vec_id long, score long"


def whole_weights(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles as 64-bit integers, the nearest ones beyond their range."""
    scaled = np.floor(values * float(scale))
    inside = np.abs(scaled) < 2.0 ** 63
    limit = np.where(scaled > 0, LONGEST, -LONGEST - 1)
    return np.where(inside, np.where(inside, scaled, 0).astype(np.int64), limit)


def _block_row(cell: int, block: int, table: pa.Table, scale: int) -> dict:
    """One block: postings of its rows (places in order of their ids) and its queries as sparse rows."""
    ids = table["id"].combine_chunks()
    missing = np.asarray(ids.is_null())
    keys = np.asarray(ids.fill_null(0))
    order = np.lexsort((keys, missing))
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    lists = table["vector"].combine_chunks()
    offsets = np.asarray(lists.offsets).astype(np.int64)
    lengths = np.diff(offsets)
    rows = np.repeat(place, lengths)
    terms = (np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lengths)).astype(np.int32)
    values = np.asarray(lists.values)[offsets[0]:offsets[-1]].astype(np.float64)
    weights = whole_weights(values, scale)
    held = weights != 0
    rows, terms, weights = rows[held], terms[held], weights[held]

    asked = np.sort(place[np.asarray(table["asked"].combine_chunks())])
    of_query = np.isin(rows, asked)
    by_row = np.lexsort((terms[of_query], rows[of_query]))
    query_rows = rows[of_query][by_row]
    found = {
        "asked": asked.tobytes(), "n_queries": len(asked),
        "query_ends": np.searchsorted(query_rows, asked, side="right").astype(np.int64).tobytes(),
        "query_terms": terms[of_query][by_row].tobytes(),
        "query_weights": weights[of_query][by_row].tobytes(),
    }
    by_term = np.lexsort((rows, terms))
    rows, terms, weights = rows[by_term], terms[by_term], weights[by_term]
    names, starts = np.unique(terms, return_index=True)
    stops = np.append(starts[1:], len(terms))
    places, kept, sizes = [], [], []  # sizes: numbers of places and of weights, term by term
    for start, stop in zip(starts, stops):
        if 2 * (stop - start) > len(order):  # the whole column
            column = np.zeros(len(order), dtype=np.int64)
            column[rows[start:stop]] = weights[start:stop]
            kept.append(column)
            sizes += (0, len(order))
        else:
            places.append(rows[start:stop])
            kept.append(weights[start:stop])
            sizes += (stop - start, stop - start)
    return {
        "cell": cell, "block": block, "ids": ids.take(pa.array(order)).to_pylist(), "terms": names.tobytes(),
        "sizes": np.array(sizes, dtype=np.int64).tobytes(),
        "places": b"".join(p.tobytes() for p in places), "weights": b"".join(w.tobytes() for w in kept), **found,
    }


def postings(vectors: DataFrame, is_query: Column, scale: int, id_col: str, vector_col: str,
             block_rows: int) -> DataFrame:
    """The written table of blocks; ``cell`` numbers the partitions they were made in."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    ).filter(F.col("vector").isNotNull() & finite)
    total = rows.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    cells = max(1, -(-total // block_rows), min(cores, -(-total // LEAST_BLOCK)))

    kind = arrow_schema(BLOCKS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = TaskContext.get().partitionId()
        waiting: list[pa.RecordBatch] = []
        made = held = 0
        for batch in batches:
            waiting.append(batch)
            held += len(batch)
            while held >= block_rows:
                table = pa.Table.from_batches(waiting)
                row = _block_row(cell % cells, (cell << 32) + made, table.slice(0, block_rows), scale)
                yield pa.RecordBatch.from_pylist([row], schema=kind)
                waiting = table.slice(block_rows).combine_chunks().to_batches()
                made, held = made + 1, held - block_rows
        if held:
            row = _block_row(cell % cells, (cell << 32) + made, pa.Table.from_batches(waiting), scale)
            yield pa.RecordBatch.from_pylist([row], schema=kind)

    return cut_lineage(rows.repartition(cells).mapInArrow(build, BLOCKS))


class Block:
    """Postings of one block, ready to be added up."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.number = row["block"]
        places = np.frombuffer(row["places"], dtype=np.int32)
        weights = np.frombuffer(row["weights"], dtype=np.int64)
        sizes = np.frombuffer(row["sizes"], dtype=np.int64).reshape(-1, 2)
        self.lists: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
        placed = start = 0
        for term, (listed, size) in zip(np.frombuffer(row["terms"], dtype=np.int32).tolist(), sizes.tolist()):
            where = places[placed:placed + listed] if listed else None
            self.lists[term] = (where, weights[start:start + size])
            placed, start = placed + listed, start + size
        self.largest = int(max(weights.max(), -int(weights.min()))) if len(weights) else 0

    def scores(self, terms: list[int], weights: list[int]) -> np.ndarray:
        """One exact score per row, term after term."""
        largest = max(map(abs, weights), default=0)
        small = largest * self.largest * max(1, len(terms)) < 2 ** 62
        total = np.zeros(len(self.ids), dtype=np.int64 if small else object)
        for term, weight in zip(terms, weights):
            if term not in self.lists:
                continue
            places, held = self.lists[term]
            held = held if small else held.astype(object)
            if places is None:
                total += weight * held
            else:
                total[places] += weight * held
        if small:
            return total
        return np.array([min(max(s, -LONGEST - 1), LONGEST) for s in total], dtype=np.int64)


def best_places(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, ties to the lower place."""
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > limit)
        chosen = np.concatenate([above, np.flatnonzero(scores == limit)[:k - len(above)]])
    else:
        chosen = np.arange(len(scores))
    chosen = np.sort(chosen)
    # the complement turns the order of 64-bit integers round without leaving their range
    return chosen[np.argsort(~scores[chosen], kind="stable")]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
                vector_col: str = "embedding", block_rows: int = BLOCK_ROWS,
                group_queries: int = GROUP_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product for every query row."""
    blocks = postings(vectors, is_query, scale, id_col, vector_col, block_rows)
    size = blocks.agg(F.sum("n_queries").alias("queries"), F.max("cell").alias("cell")).first()
    groups = max(1, -(-(size["queries"] or 0) // group_queries))
    cells = (size["cell"] or 0) + 1

    def copies(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    rows = blocks.select("cell", "block", "ids", "terms", "sizes", "places", "weights",
                         copies(groups).alias("group"))
    queries = blocks.filter("n_queries > 0").select(
        F.pmod("cell", F.lit(groups)).alias("group"), F.col("block").alias("query_block"), "ids", "asked",
        "query_ends", "query_terms", "query_weights", copies(cells).alias("cell"))

    kind = arrow_schema(FOUND)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in kind.names}
        if len(left) and len(right):
            for row in left.to_pylist():
                _search(Block(row), right, k, out)
        return pa.table(out, schema=kind)

    found = rows.groupBy("group", "cell").cogroup(queries.groupBy("group", "cell")).applyInArrow(meet, FOUND)
    order = Window.partitionBy("query_block", "query_place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _search(block: Block, queries: pa.Table, k: int, out: dict[str, list]) -> None:
    for row in queries.to_pylist():
        asked = np.frombuffer(row["asked"], dtype=np.int32).tolist()
        ends = np.frombuffer(row["query_ends"], dtype=np.int64).tolist()
        terms = np.frombuffer(row["query_terms"], dtype=np.int32).tolist()
        weights = np.frombuffer(row["query_weights"], dtype=np.int64).tolist()
        for start, end, place in zip([0, *ends], ends, asked):
            scores = block.scores(terms[start:end], weights[start:end])
            best = best_places(scores, k + 1).tolist()  # one more: the query's own row may be among them
            if row["query_block"] == block.number:
                best = [p for p in best if p != place]
            best = best[:k]
            out["query_block"] += [row["query_block"]] * len(best)
            out["query_place"] += [place] * len(best)
            out["query_id"] += [row["ids"][place]] * len(best)
            out["vec_id"] += [block.ids[p] for p in best]
            out["score"] += scores[best].tolist()
