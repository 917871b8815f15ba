"""Best-fit packing of texts into bins of a fixed number of words, without conflicts inside a bin.

A bin holds at most one text of each source and one of each duplicate cluster: it carries a bitmap of
both. Texts longer than a bin are cut into pieces; nothing is dropped. Pieces are dealt by a hash of
their id to shards of about ``shard_rows`` rows, whatever their source or cluster, so a hot source or
a large group of copies is spread evenly; each shard is packed by itself, the largest piece first.
Bins are kept in the order of their residual room. From the first bin with enough room the search goes
on to the successor until a compatible one is found, which is therefore the tightest.

Only ids, sizes, sources and cluster keys are shuffled, never texts. Null and empty texts have no words
and no bin (``bin_id`` null). A null source or cluster conflicts with nothing. Repeated rows are packed
each for itself.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField

from shutterlake.llm.common import with_columns_from_text
from shutterlake.session import cut_lineage

BINS_PER_SHARD = 1 << 20


def measured(documents: DataFrame, id_col: str, text_col: str, source_col: str,
             cluster_col: str | None = None) -> DataFrame:
    """(doc_id, source, words, cluster): without ``cluster_col``, a cluster is the hash of the lower-cased words."""
    fields = [StructField("words", IntegerType()), StructField("own", LongType())]

    def prepare():
        def measure(data: bytes | None):
            words = data.lower().split() if data else []
            if not words:
                return 0, None
            return len(words), xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63)

        return measure

    rows = documents.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(source_col).alias("source_key"),
        F.col(source_col).isNotNull().alias("has_source"),
        (F.xxhash64(cluster_col) if cluster_col else F.lit(None).cast("long")).alias("given"),
        F.col(text_col).alias("text"))
    made = with_columns_from_text(rows, "text", fields, prepare)
    return made.select(
        "doc_id", F.when(F.col("has_source"), F.col("source_key")).alias("source"), "words",
        ("given" if cluster_col else F.col("own").alias("given")),
    ).withColumnRenamed("given", "cluster")


def cut_pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """One row per piece of at most ``capacity`` words, with ``piece`` and ``first_word`` counted from 0."""
    last = F.greatest(F.ceil(F.col("words") / capacity).cast("int") - 1, F.lit(0))
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("piece") * capacity
    return pieces.withColumn("first_word", first).withColumn(
        "n_words", F.least(F.col("words") - first, F.lit(capacity)))


def pack(sizes: list[int], masks: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item, the items coming in the given order; masks that meet do not share a bin."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[int] = []
    bins, offsets = [], []
    for size, mask in zip(sizes, masks):
        at = bisect.bisect_left(order, (size, -1))
        while at < len(order) and held[order[at][1]] & mask:
            at += 1
        if at < len(order):
            residual, chosen = order.pop(at)
        else:
            residual, chosen = capacity, len(held)
            held.append(0)
        held[chosen] |= mask
        bisect.insort(order, (residual - size, chosen))
        bins.append(chosen)
        offsets.append(capacity - residual)
    return bins, offsets


def conflict_masks(sources: list, clusters: list) -> list[int]:
    """A bit for each source and for each cluster that occur more than once; others cannot conflict."""
    place: dict = {}
    for kind, values in (("source", sources), ("cluster", clusters)):
        for value, n in Counter(v for v in values if v is not None).items():
            if n > 1:
                place[kind, value] = 1 << len(place)
    return [place.get(("source", s), 0) | place.get(("cluster", c), 0) for s, c in zip(sources, clusters)]


def pack_documents(documents: DataFrame, capacity: int = 2048, shard_rows: int = 4096, id_col: str = "doc_id",
                   text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """(doc_id, piece, first_word, n_words, bin_id, bin_offset), one row per piece."""
    pieces = cut_lineage(cut_pieces(measured(documents, id_col, text_col, source_col, cluster_col), capacity).select(
        "doc_id", "piece", "first_word", "n_words", "source", "cluster"))
    filled = pieces.filter("n_words > 0")
    shards = max(1, math.ceil(filled.count() / shard_rows))
    dealt = filled.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)))

    def pack_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"),
                               ("cluster", "ascending")])
        masks = conflict_masks(table["source"].to_pylist(), table["cluster"].to_pylist())
        bins, offsets = pack(table["n_words"].to_pylist(), masks, capacity)
        first = table["shard"][0].as_py() * BINS_PER_SHARD if len(table) else 0
        return pa.table({
            "doc_id": table["doc_id"], "piece": table["piece"], "first_word": table["first_word"],
            "n_words": table["n_words"], "bin_id": pa.array([first + b for b in bins], pa.int64()),
            "bin_offset": pa.array(offsets, pa.int32())})

    id_type = documents.schema[id_col].dataType.simpleString()
    packed = dealt.groupBy("shard").applyInArrow(
        pack_shard, f"doc_id {id_type}, piece int, first_word int, n_words int, bin_id long, bin_offset int")
    empty = pieces.filter("n_words = 0").select(
        "doc_id", "piece", "first_word", "n_words", F.lit(None).cast("long").alias("bin_id"),
        F.lit(None).cast("int").alias("bin_offset"))
    return packed.unionByName(empty)
