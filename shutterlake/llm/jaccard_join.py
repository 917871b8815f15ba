"""N-gram Jaccard join with signature trees, and the components of its links.

1. Equal shingle sets form a class (one aggregate on a 128-bit hash), so copies cost one row each.
2. Each class gets keys of which linked classes share several, by the pigeonhole principle
   (``PigeonholeKeys``). Pairs that share as many uncommon keys as linked classes must are candidates: a
   class passes over its common keys, those of passages that many texts share, as long as other shared keys
   must remain; classes with too many common keys (those with many near-copies) are also joined to their
   neighbours in the order of these. The connected candidates are a block; every link lies inside one.
3. The sets of a block's classes are joined by signature trees: leaves are sets, a node holds the
   bitmap of all tokens below it, OR-combined, and the range of sizes. Both trees are descended together,
   and a pair of nodes goes no further when the largest overlap that bitmaps and sizes allow is below
   what the smallest sets under it would need. Leaf pairs that remain are verified exactly. Blocks larger than
   ``chunk_sets`` are cut up by hash and every pair of chunks is one task. Where link counts
   are wanted all remaining pairs are verified, and a task adds up its links per class, weighted by
   the rows of the other class. For components alone, pairs already connected inside a task are not
   compared again.
4. Components of the links (alternating large and small stars).

Null and empty texts have an empty set and are linked with nothing. A row without an id gets the
component of the equal texts that have one, else null. Rows that repeat an id are documents of their own:
sets are told apart by a number of their class, never by an id, and each row shows its own text's component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from shutterlake.llm.bloom import build_bloom
from shutterlake.llm.common import byte_texts, fresh_prefix, tidy
from shutterlake.llm.shingles import PigeonholeKeys, WordHashes, set_hash, shingle_set
from shutterlake.operators.graph import connected_components
from shutterlake.session import cut_lineage

FANOUT = 8
PAIRS_AT_ONCE = 1 << 22  # bitmap words compared at a time
EXACT_WORDS = 1 << 12    # a chunk pair with more shared tokens than fit so many bitmap words is compared set by set
SEEN_SETS = 100_000
COMMON_KEY = 4  # a key of more sets is common


def set_sizes(documents: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2): the size and the 128-bit hash of each text's set."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, first, second = [], [], []
            for texts in byte_texts(batch.column(1)):
                for data in texts:
                    shingles = shingle_set(hashes.of(data.lower().split() if data else []), width)
                    h1, h2 = set_hash(shingles)
                    sizes.append(len(shingles))
                    first.append(h1)
                    second.append(h2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, first, second))],
                names=["doc_id", "n_shingles", "h1", "h2"])

    return rows.mapInArrow(tidy(measure), "doc_id long, n_shingles long, h1 long, h2 long")


def candidate_keys(documents: DataFrame, text_col: str, width: int, percent: int) -> DataFrame:
    """(key, h1, slot) of every non-empty set; a task passes equal sets on once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys, seen = WordHashes(), PigeonholeKeys(percent), set()
        for batch in batches:
            for texts in byte_texts(batch.column(0)):
                made, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
                places = [np.zeros(0, dtype=np.int32)]
                for data in texts:
                    shingles = shingle_set(hashes.of(data.lower().split() if data else []), width)
                    h1 = set_hash(shingles)[0]
                    if not len(shingles) or h1 in seen:
                        continue
                    if len(seen) > SEEN_SETS:
                        seen.clear()
                    seen.add(h1)
                    own, slots = keys.of(shingles)
                    made.append(own)
                    places.append(slots)
                    owners.append(np.full(len(own), h1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(made).view(np.int64)), pa.array(np.concatenate(owners)),
                     pa.array(np.concatenate(places))], names=["key", "h1", "slot"])

    return documents.select(text_col).mapInArrow(tidy(emit), "key long, h1 long, slot int")


def candidate_edges(keys: DataFrame) -> DataFrame:
    """(src, dst): the pairs of sets that share as many uncommon keys as linked sets must.

    Linked sets share, at one level, at least each one's room of keys; those that are not common are at least
    its room less its common keys, its need. Sets that could share common keys alone (need 0 or less)
    are also joined to their neighbours among such sets, in the order of each common key.
    """
    order = Window.partitionBy("key").orderBy("h1")
    fresh = ~F.col("h1").eqNullSafe(F.lag("h1").over(order))  # copies come from several tasks
    shared = cut_lineage(
        keys.withColumn("fresh", fresh).filter("fresh").drop("fresh")
        .withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1"))
    common = F.col("n") > COMMON_KEY
    hot = F.sum(common.cast("int")).over(Window.partitionBy("h1", "slot"))
    needing = cut_lineage(shared.select("key", "h1", "slot", common.alias("common"),
                                        (F.floor(F.col("slot") / 2) - hot).alias("need")))
    own = F.struct("h1", "need")
    before = F.array(*[F.lag(own, i).over(order) for i in range(1, COMMON_KEY)])
    pairs = (needing.filter("NOT common")
             .select((F.col("slot") % 2).alias("parity"), own.alias("b"), before.alias("before"))
             .select("parity", "b", F.explode(F.array_compact("before")).alias("a"))
             .groupBy("a", "b", "parity").count()
             .filter(F.col("count") >= F.greatest("a.need", "b.need")))
    chained = needing.filter("common AND need <= 0").withColumn("src", F.lag("h1").over(order))
    return (pairs.select(F.col("a.h1").alias("src"), F.col("b.h1").alias("dst"))
            .unionByName(chained.filter("src IS NOT NULL").select("src", F.col("h1").alias("dst"))).distinct())


def block_sets(documents: DataFrame, members: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``members`` (doc_id, h1, h2, ...) with their sets; only texts that a Bloom filter passes are shuffled."""
    bloom = documents.sparkSession.sparkContext.broadcast(build_bloom(members.select(F.xxhash64("doc_id"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keep = bloom.value.holds(np.asarray(batch.column(2)).astype(np.int64).view(np.uint64))
            kept = batch.filter(pa.array(keep))
            for start in range(0, kept.num_rows, 256):
                part = kept.slice(start, 256)
                sets, first, second = [], [], []
                for data in part.column(1).cast(pa.binary()).to_pylist():
                    shingles = shingle_set(hashes.of(data.lower().split() if data else []), width)
                    h1, h2 = set_hash(shingles)
                    sets.append(shingles.view(np.int64))
                    first.append(h1)
                    second.append(h2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                     pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "shingles"])

    rows = documents.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(id_col).cast("long")).alias("probe"))
    made = rows.mapInArrow(tidy(pick), "doc_id long, h1 long, h2 long, shingles array<bigint>")
    return made.join(members, ["doc_id", "h1", "h2"])


# --- signature trees ---

class SignatureTree:
    """Bulk-loaded: sets that share their smallest shingle lie side by side."""

    def __init__(self, sets: list[np.ndarray], words: int):
        self.sets = sets
        bits = np.uint64(words * 64)
        bitmaps = np.zeros((len(sets), words), dtype=np.uint64)
        for row, shingles in zip(bitmaps, sets):
            position = shingles % bits
            np.bitwise_or.at(row, (position >> np.uint64(6)).astype(np.int64),
                             np.uint64(1) << (position & np.uint64(63)))
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        surplus = sizes - np.bitwise_count(bitmaps).sum(axis=1).astype(np.int64)
        self.levels = [(bitmaps, sizes, sizes, surplus)]
        while len(self.levels[-1][0]) > 1:
            bitmaps, low, high, surplus = self.levels[-1]
            cuts = np.arange(0, len(bitmaps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bitmaps, cuts), np.minimum.reduceat(low, cuts),
                                np.maximum.reduceat(high, cuts), np.maximum.reduceat(surplus, cuts)))

    def __len__(self) -> int:
        return len(self.sets)


def possible(left: SignatureTree, right: SignatureTree, level: int, a: np.ndarray, b: np.ndarray,
             percent: int) -> np.ndarray:
    """Whether sets under nodes ``a`` and ``b`` of a level can be similar enough.

    Common tokens set common bits; a set's surplus is how many of its tokens share a bit with others.
    """
    lbits, llow, lhigh, lsurplus = (x[a] for x in left.levels[level])
    rbits, rlow, rhigh, rsurplus = (x[b] for x in right.levels[level])
    overlap = np.bitwise_count(lbits & rbits).sum(axis=1).astype(np.int64) + np.minimum(lsurplus, rsurplus)
    overlap = np.minimum(overlap, np.minimum(lhigh, rhigh))
    fits = (100 * lhigh >= percent * rlow) & (100 * rhigh >= percent * llow)
    return fits & ((100 + percent) * overlap >= percent * (llow + rlow))


def leaf_pairs(left: SignatureTree, right: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Descends both trees together; yields the pairs of leaves that remain. A tree meets itself once."""
    same = left is right
    top = max(len(left.levels), len(right.levels)) - 1
    for tree in (left, right):  # equal heights: a root stands for itself above
        while len(tree.levels) <= top:
            tree.levels.append(tree.levels[-1])
    todo = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while todo:
        level, a, b = todo.pop()
        step = max(1, PAIRS_AT_ONCE // left.levels[level][0].shape[1])
        if len(a) > step:
            todo += [(level, a[i:i + step], b[i:i + step]) for i in range(0, len(a), step)]
            continue
        keep = possible(left, right, level, a, b, percent)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if level == 0:
            yield a, b
            continue
        a, b = _children(left, level, a, b, 0), _children(right, level, a, b, 1)
        inside = (a < len(left.levels[level - 1][0])) & (b < len(right.levels[level - 1][0]))
        inside &= (a < b) if same and level == 1 else (a <= b) if same else True
        todo.append((level - 1, a[inside], b[inside]))


def _children(tree: SignatureTree, level: int, a: np.ndarray, b: np.ndarray, side: int) -> np.ndarray:
    """All pairs of children; a root that stands for itself has itself as its only child."""
    parent = (a, b)[side]
    shift = np.tile(np.arange(FANOUT), FANOUT) if side else np.repeat(np.arange(FANOUT), FANOUT)
    if len(tree.levels[level][0]) == len(tree.levels[level - 1][0]) == 1:
        own = np.where(shift == 0, 0, 1)  # 1 lies outside the level
        return np.broadcast_to(own, (len(parent), FANOUT * FANOUT)).ravel()
    return (parent[:, None] * FANOUT + shift[None, :]).ravel()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


class Connected:
    """Which of the numbers 0..n-1 are connected so far."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def root(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = self.above[self.above[i]]
            i = self.above[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.above[max(i, j)] = min(i, j)


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect what all links connect, as (place, place), the right places following the left ones."""
    largest = max(len(s) for s in [*left, *(right or [])])
    words = 1 << max(3, min(11, math.ceil(math.log2(max(4 * largest, 1))) - 6))
    first = SignatureTree(left, words)
    second = first if right is None else SignatureTree(right, words)
    shift = 0 if right is None else len(left)
    connected, links = Connected(len(left) + (len(right) if right else 0)), []
    for a, b in leaf_pairs(first, second, percent):
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = connected.root(i), connected.root(j + shift)
            if x != y and similar(first.sets[i], second.sets[j], percent):
                connected.join(x, y)
                links.append((i, j + shift))
    return links


def exact_bitmaps(sets: list[np.ndarray]) -> np.ndarray | None:
    """One bit for every token that several of ``sets`` hold; None where these are too many."""
    tokens, places, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    words = int(shared.sum()) // 64 + 1
    if words > EXACT_WORDS:
        return None
    position = np.cumsum(shared) - 1
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kept = shared[places]
    rows, bits = rows[kept], position[places[kept]]
    bitmaps = np.zeros((len(sets), words), dtype=np.uint64)
    np.bitwise_or.at(bitmaps, (rows, bits >> 6), np.uint64(1) << (bits & 63).astype(np.uint64))
    return bitmaps


def every_pair(left: list[np.ndarray], right: list[np.ndarray] | None,
               percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links, as arrays of places, the right places following the left ones."""
    sets = [*left, *(right or [])]
    words = 1 << max(3, min(11, math.ceil(math.log2(max(4 * max(map(len, sets)), 1))) - 6))
    first = SignatureTree(left, words)
    second = first if right is None else SignatureTree(right, words)
    shift = 0 if right is None else len(left)
    bitmaps, sizes = exact_bitmaps(sets), np.array([len(s) for s in sets])
    step = PAIRS_AT_ONCE // (1 if bitmaps is None else bitmaps.shape[1])
    for a, b in leaf_pairs(first, second, percent):
        for start in range(0, len(a), step):
            i, j = a[start:start + step], b[start:start + step] + shift
            if bitmaps is None:
                fits = np.array([similar(sets[x], sets[y], percent) for x, y in zip(i.tolist(), j.tolist())], dtype=bool)
            else:
                common = np.bitwise_count(bitmaps[i] & bitmaps[j]).sum(axis=1).astype(np.int64)
                fits = 100 * common >= percent * (sizes[i] + sizes[j] - common)
            yield i[fits], j[fits]


def counted_links(left: list[np.ndarray], right: list[np.ndarray] | None, weights: np.ndarray,
                  percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(summed weights of the sets that each set is linked with, links that connect what all links connect)."""
    counts = np.zeros(len(weights), dtype=np.int64)
    connected, links = Connected(len(weights)), []
    for i, j in every_pair(left, right, percent):
        np.add.at(counts, i, weights[j])
        np.add.at(counts, j, weights[i])
        while len(i):
            roots = np.array([connected.root(x) for x in range(len(weights))])
            apart = roots[i] != roots[j]
            i, j = i[apart], j[apart]
            for x, y in zip(i[:len(weights)].tolist(), j[:len(weights)].tolist()):
                if connected.root(x) != connected.root(y):
                    connected.join(connected.root(x), connected.root(y))
                    links.append((x, y))
    return counts, links


def block_links(sets: DataFrame, percent: int, chunk_sets: int, kind: str = "forest",
                node: str = "doc_id") -> DataFrame:
    """Links among the nodes of each block; ``sets`` has block, shingles and the column ``node``, which
    tells different sets apart.

    ``kind`` "forest" gives (src, dst) that connect what all links connect, "pairs" all links. "counts", for
    which ``sets`` has the class sizes as weight, gives (src, dst, n_links): the forest's rows with 0 and
    for each node, as src and dst, the weights of those it is linked with, in parts to be summed.
    """
    sizes = sets.groupBy("block").agg(F.ceil(F.count("*") / chunk_sets).cast("int").alias("chunks"))
    dealt = sets.join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64(node), "chunks").cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "block", F.col(node).alias("node"), "shingles", "chunk", *(["weight"] if kind == "counts" else []),
        F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))

    def join_chunks(table: pa.Table) -> pa.Table:
        ids, chunk = np.asarray(table["node"]), np.asarray(table["chunk"])
        column = table["shingles"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        values, cuts = np.asarray(column.values).view(np.uint64), np.asarray(column.offsets)
        sets = [values[cuts[k]:cuts[k + 1]] for k in range(len(ids))]
        order = sorted({i: k for k, i in enumerate(ids.tolist())}.values(),
                       key=lambda k: (int(sets[k][0]), len(sets[k]), int(ids[k])))
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left = [k for k in order if chunk[k] == i]
        right = None if i == j else [k for k in order if chunk[k] == j]
        places = np.array(left + (right or []), dtype=np.int64)
        links, counts = np.zeros((0, 2), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        if left and (right is None or right):
            sides = [sets[k] for k in left], None if right is None else [sets[k] for k in right]
            if kind == "counts":
                counts, found = counted_links(*sides, np.asarray(table["weight"])[places], percent)
            elif kind == "pairs":
                found = [np.stack(pair, axis=1) for pair in every_pair(*sides, percent)]
                found = np.concatenate(found) if found else []
            else:
                found = linked_pairs(*sides, percent)
            links = ids[places[np.array(found, dtype=np.int64).reshape(-1, 2)]]
        if kind != "counts":
            return pa.table({"src": pa.array(links[:, 0]), "dst": pa.array(links[:, 1])})
        held = np.flatnonzero(counts)
        own = ids[places[held]]
        return pa.table({"src": pa.array(np.concatenate([links[:, 0], own])),
                         "dst": pa.array(np.concatenate([links[:, 1], own])),
                         "n_links": pa.array(np.concatenate([np.zeros(len(links), dtype=np.int64), counts[held]]))})

    # dealt anew: the join above may have put all of a block in one partition
    return spread.repartition("block", "i", "j").groupBy("block", "i", "j").applyInArrow(
        join_chunks, "src long, dst long" + (", n_links long" if kind == "counts" else ""))


# --- the join ---

def classes_and_sets(sized: DataFrame, documents: DataFrame, width: int, percent: int, id_col: str,
                     text_col: str) -> tuple[DataFrame, DataFrame]:
    """The classes of equal sets (h1, h2, rep, weight, set_id), and the representatives' sets by block."""
    classes = cut_lineage(
        sized.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"))
        .withColumn("set_id", F.monotonically_increasing_id()))
    edges = candidate_edges(candidate_keys(documents, text_col, width, percent))
    blocks = connected_components(edges).select(F.col("id").alias("h1"), F.col("component").alias("block"))
    members = cut_lineage(classes.join(blocks, "h1").withColumnRenamed("rep", "doc_id"))
    return classes, cut_lineage(block_sets(documents, members, id_col, text_col, width))


def linked_classes(sized: DataFrame, documents: DataFrame, width: int, percent: int, id_col: str, text_col: str,
                   chunk_sets: int, count_links: bool) -> DataFrame:
    """(h1, h2, part, component_id) of every class of equal sets, with ``count_links`` also n_links.

    ``part`` numbers the components; component_id is the smallest id in them.
    """
    classes, sets = classes_and_sets(sized, documents, width, percent, id_col, text_col)
    named = classes
    if count_links:
        parts = cut_lineage(block_links(sets, percent, chunk_sets, "counts", "set_id"))
        forest = parts.filter("src <> dst").select("src", "dst")
        counts = parts.filter("src = dst").groupBy(F.col("src").alias("set_id")).agg(F.sum("n_links").alias("near"))
        named = classes.join(counts, "set_id", "left")
    else:
        forest = block_links(sets, percent, chunk_sets, node="set_id")
    found = cut_lineage(connected_components(forest).select(F.col("id").alias("set_id"), F.col("component").alias("root"))
                        .join(classes.select("set_id", "rep"), "set_id"))
    lowest = found.groupBy("root").agg(F.min("rep").alias("low"))
    found = found.join(lowest, "root").select("set_id", "root", "low")
    more = [(F.coalesce("near", F.lit(0)) + F.col("weight") - 1).alias("n_links")] if count_links else []
    return named.join(found, "set_id", "left").select(
        "h1", "h2", F.coalesce("root", "set_id").alias("part"), F.coalesce("low", "rep").alias("component_id"), *more)


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text", chunk_sets: int = 512, count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``documents``; with ``count_links`` also n_links.

    component_id is the smallest id reachable by links between texts whose sets have a Jaccard
    similarity of ``percent`` hundredths or more. n_links is the number of other rows with an id that the
    row is linked with, those of equal sets included; 0 for a row without an id.
    """
    sized = cut_lineage(set_sizes(documents, id_col, text_col, width))
    named = linked_classes(sized, documents, width, percent, id_col, text_col, chunk_sets, count_links)
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("n_links")).otherwise(0)
    return sized.join(named, ["h1", "h2"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        *([linked.cast("long").alias("n_links")] if count_links else []))


def similar_pairs(documents: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                  text_col: str = "text", chunk_sets: int = 512) -> tuple[DataFrame, DataFrame]:
    """(rep, other) of all linked classes of equal sets, ``rep`` <= ``other``, and the membership (doc_id, rep).

    A class is named by its smallest id, and copies are not expanded: documents are linked if they have the same
    representative or their representatives are a pair. Where rows repeat an id, two classes can have one name.
    """
    sized = cut_lineage(set_sizes(documents, id_col, text_col, width))
    classes, sets = classes_and_sets(sized, documents, width, percent, id_col, text_col)
    names = classes.select("set_id", "rep")
    links = (block_links(sets, percent, chunk_sets, "pairs", "set_id")
             .join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst"))
    pairs = links.select(F.least("a", "b").alias("rep"), F.greatest("a", "b").alias("other"))
    members = sized.filter("doc_id IS NOT NULL").join(classes, ["h1", "h2"]).select("doc_id", "rep")
    return pairs, members


def keep_one_per_component(documents: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                           text_col: str = "text") -> DataFrame:
    """One row of ``documents`` for each component, that with the smallest id, with all its columns.

    Where rows of one component repeat its smallest id, the one with the smallest text stays; rows that
    repeat an id and lie in different components are judged apart. Rows without an id, and those without
    words, stay. Only rows that a Bloom filter takes for dropped or repeated ones are shuffled.
    """
    sized = cut_lineage(set_sizes(documents, id_col, text_col, width))
    named = linked_classes(sized, documents, width, percent, id_col, text_col, 512, False)
    found = cut_lineage(sized.filter("n_shingles > 0 AND doc_id IS NOT NULL").join(named, ["h1", "h2"])
                        .select("doc_id", "h1", "h2", "part", (F.col("component_id") == F.col("doc_id")).alias("stays")))
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("stays").alias("stays"))
    doubtful = cut_lineage(ids.filter("n > 1 OR NOT stays").select("doc_id"))
    bloom = documents.sparkSession.sparkContext.broadcast(build_bloom(doubtful.select(F.xxhash64("doc_id"))))
    prefix = fresh_prefix(documents)
    probe, hit, first, second = (f"{prefix}{name}" for name in ("probe", "hit", "h1", "h2"))
    key = F.col(id_col).cast("long")
    probed = documents.withColumn(probe, F.when(key.isNotNull(), F.xxhash64(key)))
    at, text_at = len(documents.columns), documents.columns.index(text_col)
    schema = StructType([*documents.schema.fields, StructField(hit, BooleanType()),
                         StructField(first, LongType()), StructField(second, LongType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            known = np.asarray(batch.column(at).is_valid())
            values = np.asarray(batch.column(at).fill_null(0)).astype(np.int64).view(np.uint64)
            held = bloom.value.holds(values) & known
            marks = [(None, None)] * batch.num_rows
            for place in np.flatnonzero(held).tolist():
                text = batch.column(text_at)[place].as_py()
                shingles = shingle_set(hashes.of(text.encode().lower().split() if text else []), width)
                held[place] = len(shingles) > 0
                marks[place] = set_hash(shingles)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(held), pa.array([m[0] for m in marks], pa.int64()),
                 pa.array([m[1] for m in marks], pa.int64())], names=schema.names)

    judged = probed.mapInArrow(tidy(judge), schema)
    sure = judged.filter(~F.col(hit))
    doubt = judged.filter(F.col(hit)).withColumn(probe, key)
    info = found.groupBy("doc_id", "h1", "h2").agg(F.first("part").alias("part"), F.first("stays").alias("stays"))
    info = info.join(doubtful, "doc_id", "left_semi").toDF(probe, first, second, f"{prefix}part", f"{prefix}stays")
    resolved = doubt.join(info, [probe, first, second], "left").filter(F.coalesce(f"{prefix}stays", F.lit(True)))
    single = resolved.filter(F.col(f"{prefix}stays").isNull())
    order = Window.partitionBy(probe, f"{prefix}part").orderBy(F.col(text_col))
    smallest = (resolved.filter(F.col(f"{prefix}stays"))
                .withColumn(f"{prefix}place", F.row_number().over(order)).filter(F.col(f"{prefix}place") == 1))
    columns = documents.columns
    return sure.select(*columns).unionByName(single.select(*columns)).unionByName(smallest.select(*columns))
