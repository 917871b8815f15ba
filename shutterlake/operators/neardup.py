"""Perceptual hashing and near-duplicate search."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.hashing import bits_to_long, hamming_long, hash_bits
from shutterlake.operators.tiles import cross_tiles, scored_pairs, self_tiles, tile_count

DCT_SIZE = 32
BLOCK_SIZE = 8
DEFAULT_DISTANCE = 10
BANDS = 4
BAND_BITS = 16
BUSY_BUCKET = 4096

PAIR_SCHEMA = "media_item_id BIGINT, matching_item_id BIGINT, hamming_distance INT"


# --- image -> hash ----------------------------------------------------------------------------

def _dct_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    k = np.arange(n)[:, None]
    x = np.arange(n)[None, :]
    basis = np.sqrt(2 / n) * np.cos((2 * x + 1) * k * np.pi / (2 * n))
    basis[0] /= np.sqrt(2)
    return basis


def _area_weights(source: int, target: int) -> np.ndarray:
    """Rows average the source span of each target pixel (stretching when the source is smaller)."""
    edges = np.linspace(0, source, target + 1)
    starts = np.arange(source)
    overlap = np.minimum(edges[1:, None], starts + 1) - np.maximum(edges[:-1, None], starts)
    weights = np.clip(overlap, 0, None)
    return weights / weights.sum(axis=1, keepdims=True)


def _grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    pixels = np.frombuffer(data, np.uint8, height * width * channels).reshape(
        height, width, channels
    )
    if channels == 1:
        return pixels[:, :, 0].astype(np.float64)
    blue, green, red = (pixels[:, :, c].astype(np.float64) for c in range(3))
    return 0.299 * red + 0.587 * green + 0.114 * blue


def low_frequency_blocks(images: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, block): the 8x8 low-frequency DCT coefficients of each image, row by row.

    ``images`` has id, width, height, channels and data (BGR or grey bytes). Row-local: no shuffle.
    """
    id_type = images.schema[id_col].dataType.simpleString()

    def transform(batches):
        basis = _dct_matrix(DCT_SIZE)[:BLOCK_SIZE]
        for batch in batches:
            shrunk = np.empty((len(batch), DCT_SIZE, DCT_SIZE))
            rows = zip(batch["data"], batch["height"], batch["width"], batch["channels"])
            for n, (data, height, width, channels) in enumerate(rows):
                grey = _grey(data, height, width, channels)
                shrunk[n] = (
                    _area_weights(height, DCT_SIZE) @ grey @ _area_weights(width, DCT_SIZE).T
                )
            # rounded, so that coefficients that should be zero do not differ in noise
            blocks = np.round(basis @ shrunk @ basis.T, 6).reshape(len(batch), -1) + 0.0
            yield pd.DataFrame({id_col: batch[id_col], "block": list(blocks)})

    return images.select(id_col, "width", "height", "channels", "data").mapInPandas(
        transform, f"{id_col} {id_type}, block ARRAY<DOUBLE>"
    )


def phash(images: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, hash): 64-character perceptual hash."""
    blocks = low_frequency_blocks(images, id_col)
    return blocks.select(id_col, hash_bits(F.col("block")).alias("hash"))


# --- near-duplicate join ----------------------------------------------------------------------

def hash_groups(items: DataFrame) -> DataFrame:
    """(rep, h, copies): one row per distinct non-null hash, represented by its lowest id."""
    return (
        items.filter(F.col("hash").isNotNull() & (F.col("hash") != ""))
        .groupBy("hash")
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        .select("rep", bits_to_long(F.col("hash")).alias("h"), "hash", "copies")
    )


def copy_links(items: DataFrame, groups: DataFrame) -> DataFrame:
    """Links every further copy of a hash to its representative, at distance 0."""
    return (
        items.join(groups.filter("copies > 1").select("hash", "rep"), "hash")
        .filter(F.col("id") != F.col("rep"))
        .select(
            F.col("rep").alias("media_item_id"),
            F.col("id").alias("matching_item_id"),
            F.lit(0).alias("hamming_distance"),
        )
    )


def near_duplicate_join(items: DataFrame, threshold: int = DEFAULT_DISTANCE) -> DataFrame:
    """Near-duplicates of ``items(id, hash)``: (media_item_id, matching_item_id, hamming_distance).

    Items with one and the same hash are first folded into their lowest id. The result has every
    pair of distinct hashes within ``threshold`` (between those lowest ids), plus one link from
    each lowest id to each of its copies. Two items match exactly when their representatives are
    equal or linked, so nothing is lost while a hash shared by a third of the library adds one row
    per copy and not one per pair of copies; ``near_duplicates_of`` spells pairs out for given items.
    """
    groups = hash_groups(items)
    if threshold < BAND_BITS:
        pairs = band_join(groups, threshold)
    else:
        pairs = _tile_join(groups, threshold)
    return pairs.unionByName(copy_links(items, groups))


def _neighbour_masks(radius: int) -> list[int]:
    masks = []
    for weight in range(radius + 1):
        for bits in combinations(range(BAND_BITS), weight):
            masks.append(sum(1 << b for b in bits))
    return masks


def _band(h: Column, index: int) -> Column:
    return F.shiftrightunsigned(h, BAND_BITS * index).bitwiseAND(F.lit(0xFFFF)).cast("int")


def _first_close_band(a: Column, b: Column, radius: int) -> Column:
    """The lowest band that differs in at most ``radius`` bits: the one that reports the pair."""
    diff = a.bitwiseXOR(b)
    choice = F.lit(None).cast("int")
    for index in reversed(range(BANDS)):
        choice = F.when(F.bit_count(_band(diff, index)) <= radius, index).otherwise(choice)
    return choice


def hash_bands(groups: DataFrame) -> DataFrame:
    """(rep, h, band, value): the four 16-bit bands of each hash."""
    bands = F.array(
        *[
            F.struct(F.lit(i).alias("band"), _band(F.col("h"), i).alias("value"))
            for i in range(BANDS)
        ]
    )
    return groups.select("rep", "h", F.explode(bands).alias("b")).select("rep", "h", "b.*")


def _mask(h: Column, band: Column, value: Column) -> Column:
    """The bits in which a listed value differs from the hash's own band."""
    own = F.call_function("shiftrightunsigned", h, band * BAND_BITS).bitwiseAND(F.lit(0xFFFF)).cast("int")
    return own.bitwiseXOR(value)


def _listed(bands: DataFrame, radius: int) -> DataFrame:
    """``bands`` with every value within ``radius`` bits instead of the hash's own."""
    if not radius:
        return bands.select("rep", "h", "band", "value")
    masks = F.array(*[F.lit(m) for m in _neighbour_masks(radius)])
    near = F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m))).alias("value")
    return bands.select("rep", "h", "band", near)


def band_join(groups: DataFrame, threshold: int, against: DataFrame | None = None) -> DataFrame:
    """Exact: at distance <= T some 16-bit band differs in at most T // 4 bits.

    Both sides list the values around their bands, each up to half of that radius, and meet at a value between
    them; that is far fewer rows than all values within the whole radius on one side. The one side's mask takes
    the lowest bits of the difference, so two bands meet once. Buckets that hold
    more than BUSY_BUCKET hashes (flat images share bands) are compared block-wise instead of by
    listing candidates. A pair is reported by its first close band only, so no distinct is needed.
    ``groups`` is compared with itself (each pair once) or with the ``hash_bands`` of ``against``.
    """
    radius = threshold // BANDS
    half = radius - radius // 2
    bands = hash_bands(groups)
    base = bands if against is None else against
    # At most 4 * 65536 distinct buckets exist, so this list is bounded whatever the input.
    busy = (
        base.groupBy("band", "value").count().filter(F.col("count") > BUSY_BUCKET)
        .select("band", "value", F.ceil(F.col("count") / BUSY_BUCKET).cast("int").alias("base_tiles"))
    )
    crowded = not busy.isEmpty()
    quiet_base = base.join(F.broadcast(busy), ["band", "value"], "left_anti") if crowded else base
    distance = hamming_long(F.col("a.h"), F.col("b.h"))
    # the size of exploded rows is not estimated, so a broadcast would pass them all through the driver
    joined = _listed(bands, half).alias("a").join(
        _listed(quiet_base, radius // 2).alias("b").hint("merge"), ["band", "value"])
    if against is None:
        joined = joined.filter(F.col("a.rep") < F.col("b.rep"))
    low, high = (_mask(F.col(f"{side}.h"), F.col("band"), F.col("value")) for side in "ab")
    once = (high == 0) | ((F.bit_count(low) == half) & (low < high.bitwiseAND(-high)))
    quiet = (
        joined.filter(distance <= threshold)
        .filter(once)
        .filter(F.col("band") == _first_close_band(F.col("a.h"), F.col("b.h"), radius))
        .select(
            F.least("a.rep", "b.rep").alias("media_item_id"),
            F.greatest("a.rep", "b.rep").alias("matching_item_id"),
            distance.cast("int").alias("hamming_distance"),
        )
    )
    if not crowded:
        return quiet
    return quiet.unionByName(
        _busy_buckets(base, _listed(bands, radius), busy, threshold, radius, against is None)
    )


def _busy_buckets(base: DataFrame, probes: DataFrame, busy: DataFrame, threshold: int,
                  radius: int, same: bool) -> DataFrame:
    hot_probes = probes.join(F.broadcast(busy), ["band", "value"])
    probe_tiles = hot_probes.groupBy("band", "value").agg(
        F.ceil(F.count("*") / BUSY_BUCKET).cast("int").alias("probe_tiles")
    )
    left = hot_probes.join(F.broadcast(probe_tiles), ["band", "value"])
    right = base.join(F.broadcast(busy), ["band", "value"]).join(
        F.broadcast(probe_tiles), ["band", "value"]
    )

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        band = int(a["band"].iloc[0])
        ha = a["h"].to_numpy().view(np.uint64)
        hb = b["h"].to_numpy().view(np.uint64)
        ida, idb = a["rep"].to_numpy(), b["rep"].to_numpy()
        out = []
        for start in range(0, len(ha), 512):
            diff = ha[start:start + 512, None] ^ hb[None, :]
            distance = np.bitwise_count(diff)
            hit = distance <= threshold
            if same:
                hit &= ida[start:start + 512, None] < idb[None, :]
            for earlier in range(band):
                part = (diff >> np.uint64(BAND_BITS * earlier)) & np.uint64(0xFFFF)
                hit &= np.bitwise_count(part) > radius
            rows, cols = np.nonzero(hit)
            out.append(
                pd.DataFrame({
                    "media_item_id": np.minimum(ida[start:start + 512][rows], idb[cols]),
                    "matching_item_id": np.maximum(ida[start:start + 512][rows], idb[cols]),
                    "hamming_distance": distance[rows, cols].astype(np.int32),
                })
            )
        return pd.concat(out)

    return cross_tiles(
        left, right, "rep", "rep", kernel, PAIR_SCHEMA,
        F.col("probe_tiles"), F.col("base_tiles"), keys=["band", "value"],
    )


def _close_hashes(left: pd.DataFrame, right: pd.DataFrame, same: bool, threshold: int):
    hl, hr = (part["h"].to_numpy().view(np.uint64) for part in (left, right))
    strips = scored_pairs(
        left, right, same, "rep",
        lambda start, stop: np.bitwise_count(hl[start:stop, None] ^ hr[None, :]),
        lambda distance: distance <= threshold,
    )
    for small, large, distance in strips:
        yield pd.DataFrame({
            "media_item_id": small, "matching_item_id": large,
            "hamming_distance": distance.astype(np.int32),
        })


def _tile_join(groups: DataFrame, threshold: int) -> DataFrame:
    """Block-wise XOR and popcount, for thresholds too wide for bands."""
    hashes = groups.select("rep", "h")
    tiles = tile_count(hashes)

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool):
        return _close_hashes(left, right, same, threshold)

    return self_tiles(hashes, "rep", kernel, PAIR_SCHEMA, tiles)


def near_duplicates_between(arrivals: DataFrame, pool: DataFrame,
                            threshold: int = DEFAULT_DISTANCE) -> DataFrame:
    """Links of new items to the pool and to each other, in the form of ``near_duplicate_join``.

    Only the arrivals probe; the pool is listed by band once and never compared with itself.
    """
    old = hash_groups(pool.join(arrivals.select("id"), "id", "left_anti"))
    new = hash_groups(arrivals)
    if threshold < BAND_BITS:
        across = band_join(new, threshold, against=hash_bands(old))
    else:
        across = _cross_hash_tiles(new, old, threshold)
    return across.unionByName(near_duplicate_join(arrivals, threshold))


def _cross_hash_tiles(new: DataFrame, old: DataFrame, threshold: int) -> DataFrame:
    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(_close_hashes(a, b, False, threshold))

    return cross_tiles(
        new.select("rep", "h"), old.select("rep", "h"), "rep", "rep", kernel, PAIR_SCHEMA,
        tile_count(new), tile_count(old),
    )


# --- match tables -----------------------------------------------------------------------------

def canonical_match_insert(existing: DataFrame, found: DataFrame, left: str,
                           right: str) -> DataFrame:
    """Rows of ``found`` whose pair, in either order, ``existing`` lacks; endpoints ordered."""
    def ordered(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in (left, right)]
        return df.select(
            F.least(left, right).alias(left), F.greatest(left, right).alias(right), *rest
        )

    rest = [c for c in found.columns if c not in (left, right)]
    candidates = (
        ordered(found)
        .groupBy(left, right)
        .agg(F.min(F.struct(*rest)).alias("_info"))
        .select(left, right, "_info.*")
        if rest else ordered(found).distinct()
    )
    return candidates.join(ordered(existing).select(left, right), [left, right], "left_anti")


def matches_of_items(matches: DataFrame, items: DataFrame | None = None, left: str = "media_item_id",
                     right: str = "matching_item_id") -> DataFrame:
    """Match rows seen from an item: (item_id, other_id, ...), whichever side the item is on.

    ``items(id)`` restricts the listing; two equi semi-joins instead of an OR predicate.
    """
    rest = [c for c in matches.columns if c not in (left, right)]
    forward = matches.select(F.col(left).alias("item_id"), F.col(right).alias("other_id"), *rest)
    backward = matches.select(F.col(right).alias("item_id"), F.col(left).alias("other_id"), *rest)
    if items is not None:
        wanted = items.select(F.col("id").alias("item_id"))
        forward = forward.join(wanted, "item_id", "left_semi")
        backward = backward.join(wanted, "item_id", "left_semi")
    return forward.unionByName(backward)


def near_duplicates_of(items: DataFrame, wanted: DataFrame,
                       threshold: int = DEFAULT_DISTANCE) -> DataFrame:
    """Every item within ``threshold`` of each wanted id, copies spelled out.

    (item_id, other_id, hamming_distance); the output is as large as the answer for those items.
    """
    groups = hash_groups(items)
    member = items.join(groups.select("hash", "rep"), "hash").select("id", "rep")
    pairs = band_join(groups, threshold) if threshold < BAND_BITS else _tile_join(groups, threshold)
    own = groups.select(
        F.col("rep").alias("item_id"), F.col("rep").alias("other_id"),
        F.lit(0).alias("hamming_distance"),
    )
    reps = matches_of_items(pairs).unionByName(own)
    asked = member.join(wanted.select("id"), "id", "left_semi")
    near = asked.join(reps, F.col("rep") == F.col("item_id")).select(
        F.col("id").alias("item"), F.col("other_id").alias("near_rep"), "hamming_distance"
    )
    others = member.select(F.col("id").alias("other_id"), F.col("rep").alias("near_rep"))
    return (
        near.join(others, "near_rep")
        .filter(F.col("item") != F.col("other_id"))
        .select(F.col("item").alias("item_id"), "other_id", "hamming_distance")
    )
