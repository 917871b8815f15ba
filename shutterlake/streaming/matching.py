"""Matching a micro-batch against the growing pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.operators.facegraph import similarity_join, similarity_search, vector_groups
from shutterlake.operators.neardup import (BAND_BITS, BANDS, DEFAULT_DISTANCE, band_join, hash_bands, hash_groups)
from shutterlake.session import cut_lineage
from shutterlake.sources.tables import TableStore

BUCKET_BITS = 6  # of the 16 bits of a band; so there are at most 4 * 64 buckets
CATALOGUE = -1


def face_pairs_for_batch(batch: DataFrame, pool: DataFrame, threshold: float) -> DataFrame:
    """(feature_id, matching_feature_id, similarity) of pairs with at least one new face.

    Copies are linked to their lowest id of the batch and, across, to the lowest id of the pool.

    ``batch`` and ``pool`` have id and embedding. Each distinct new vector is compared with each
    distinct old one (a scan of the pool, or bounded blocks for a large batch), then the batch with
    itself; copies are linked to their lowest id as in ``similarity_join``.
    """
    old = vector_groups(pool.join(batch.select("id"), "id", "left_anti"))
    new = vector_groups(batch)
    across = similarity_search(
        new.select(F.col("rep").alias("id"), "embedding"),
        old.select(F.col("rep").alias("id"), "embedding"),
        threshold,
    ).select(
        F.least("query_id", "feature_id").alias("feature_id"),
        F.greatest("query_id", "feature_id").alias("matching_feature_id"),
        "similarity",
    )
    return across.unionByName(similarity_join(batch, threshold))


def _bucket(band: Column, value: Column) -> Column:
    return band * (1 << BUCKET_BITS) + F.shiftright(value, BAND_BITS - BUCKET_BITS)


class HashPool:
    """The bands of all different hashes seen so far, on storage in folders by batch and bucket.

    A bucket holds the hashes that agree in the first bits of a band, so a batch reads only the buckets that
    the hashes it looks for can differ into. Each batch owns a folder and is matched with those before it:
    a replay reads what the first run read and overwrites what it wrote. Each hash is held once, under the
    lowest id of the first batch that had it.
    """

    SCHEMA = "rep BIGINT, h BIGINT, band INT, value INT, batch BIGINT, bucket INT"

    def __init__(self, spark: SparkSession, root: str, threshold: int = DEFAULT_DISTANCE):
        if threshold >= BAND_BITS:
            raise ValueError(f"bands serve distances below {BAND_BITS}")
        self.spark, self.root, self.threshold = spark, root.rstrip("/"), threshold

    def build(self, catalogued: DataFrame | None = None) -> None:
        """Lists the hashes of ``catalogued(id, hash)``, unless this has been done."""
        if str(CATALOGUE) not in TableStore(self.spark, self.root).finished("", "batch="):
            if catalogued is None:
                catalogued = self.spark.createDataFrame([], "id long, hash string")
            self._add(hash_groups(catalogued), CATALOGUE)

    def _add(self, groups: DataFrame, batch: int) -> None:
        listed = hash_bands(groups).withColumn("bucket", _bucket(F.col("band"), F.col("value")))
        # one file per bucket and batch; adaptive execution splits a bucket that many hashes share
        listed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.root}/batch={batch}")

    def touched(self, groups: DataFrame) -> list[int]:
        """The buckets that hold hashes within the threshold of those of ``groups``; at most all 256."""
        bucket = _bucket(F.col("band"), F.col("value")).alias("bucket")
        own = [r["bucket"] for r in hash_bands(groups).select(bucket).distinct().collect()]
        radius = self.threshold // BANDS
        masks = [m for m in range(1 << BUCKET_BITS) if m.bit_count() <= radius]
        return sorted({b ^ m for b in own for m in masks})

    def known(self, batch: int, buckets: list[int]) -> DataFrame:
        """(rep, h, band, value) of these buckets, from the batches before ``batch``."""
        whole = self.spark.read.schema(self.SCHEMA).parquet(self.root)
        return whole.filter((F.col("batch") < batch) & F.col("bucket").isin(buckets)).select(
            "rep", "h", "band", "value")

    def match(self, items: DataFrame, batch: int) -> DataFrame:
        """Links of new ``items(id, hash)`` to the pool and to each other; their hashes join the pool.

        (media_item_id, matching_item_id, hamming_distance): each hash the pool lacks is linked with all
        different hashes within the threshold, from lowest id to lowest id, and every further item of a hash
        with the id that represents it. Items without a hash are linked with nothing.
        """
        groups = cut_lineage(hash_groups(items))
        pool = self.known(batch, self.touched(groups))
        held = pool.filter("band = 0").select("h", F.col("rep").alias("first"))
        groups = cut_lineage(groups.join(held, "h", "left"))
        fresh = groups.filter("first IS NULL").select("rep", "h")
        copies = (items.join(groups.select("hash", F.coalesce("first", "rep").alias("rep")), "hash")
                  .select(F.least("id", "rep").alias("media_item_id"), F.greatest("id", "rep").alias("matching_item_id"),
                          F.lit(0).alias("hamming_distance")))
        found = (band_join(fresh, self.threshold, against=pool)
                 .unionByName(band_join(fresh, self.threshold)).unionByName(copies)
                 .filter("media_item_id <> matching_item_id"))
        self._add(fresh, batch)
        return found
