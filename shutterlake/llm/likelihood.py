"""Two discounted models of word sequences, one a class of texts, and their log-likelihoods of any text.

Each class has a bigram model of absolute discounting with Kneser-Ney continuation counts (discount 1):

    p(b | a) = (n(a, b) - 1)+ / n(a)  +  types(a) / n(a) * p(b)
    p(b)     = (contexts(b) - 1)+ / contexts  +  words / contexts * 1 / (V + 1)

with n the counts of pairs in the class, types(a) the different words after a, contexts(b) the different words
before b, contexts their sum over all words and words the number of words of the class. V, the different words
of both classes, makes the base that the classes share, with one part for all words never seen. A text is read
as its words between two marks, which count as a word, so a text of n words has n + 1 pairs.

The logarithm of a text's likelihood is a sum of terms: one a pair (nothing, unless a class holds the pair twice), one
a word (its own probability and its weight as a history) and a constant. Counting and terms stay distributed;
the terms of the most frequent words and pairs (``head_entries``) go to the tasks. The other terms lie in shards by
key: a block of texts asks a shard for what a Bloom filter passes, as one row of arrays, and adds up the
answers, a row a shard. The filter grows with the terms (to 32 MB), so that few words are asked for in vain. So
every term counts, however rare.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.bloom import build_bloom
from shutterlake.llm.common import TEXTS_AT_ONCE, byte_texts, tidy, word_table
from shutterlake.session import cut_lineage

WORDS = word_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
MARK = np.uint64(0x9E3779B97F4A7C15)  # before and after a text
PAIRS_AT_ONCE = 1_000_000  # pairs a task holds before it adds them up
BUCKETS = 1 << 20          # of the frequent terms' keys, by their first bits
KNOWN_TEXTS = 200_000      # hashes of texts a task keeps, to read copies once
TAIL_BITS = 1 << 25        # 4 MB, the least
MOST_TAIL_BITS = 1 << 28   # 32 MB
BITS_A_TERM = 8
SHARD_TERMS = 1_000_000    # terms of a shard, on average, from LEAST_SHARDS shards on
LEAST_SHARDS = 32
TERMS_AT_ONCE = 200_000    # terms a task packs into rows at a time
TERMS, TEXTS, ASKED = range(3)  # kinds of rows, in their order in a shard
PACKED = ("shard int, kind int, block long, keys array<bigint>, owners array<int>, toxic array<double>, "
          "ordinary array<double>")


def words_of(data: bytes | None) -> list[str]:
    if not data:
        return []
    return data.decode("utf-8", "replace").lower().encode().translate(WORDS).decode().split()


@dataclass(frozen=True)
class ClassModels:
    """Terms (key, toxic, ordinary): ``head`` as arrays sorted by key, ``tail`` as a table or None."""

    head: tuple[np.ndarray, np.ndarray, np.ndarray]
    tail: DataFrame | None
    unseen: tuple[float, float]  # log-probability of a word never seen
    tail_terms: int = 0


def _sequence(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of several texts as hashes, with a mark before each text and one at the end; symbols per text."""
    words: list[str] = []
    sizes = np.empty(len(texts), dtype=np.int64)
    for i, data in enumerate(texts):
        own = words_of(data)
        words += own
        sizes[i] = len(own) + 1
    symbols = np.full(len(words) + len(texts) + 1, MARK, dtype=np.uint64)
    is_word = np.ones(len(symbols), dtype=bool)
    is_word[np.concatenate([[0], np.cumsum(sizes)])] = False
    symbols[is_word] = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    return symbols, sizes


def pair_keys(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    turned = (first << np.uint64(23)) | (first >> np.uint64(41))
    mixed = (turned * np.uint64(0xC2B2AE3D27D4EB4F)) ^ last
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return mixed ^ (mixed >> np.uint64(32))


# --- training ---

def count_pairs(texts: DataFrame) -> DataFrame:
    """(a, b, toxic, ordinary): in how many places of each class ``b`` follows ``a``, as hashes."""
    text_at, toxic_at = texts.columns.index("text"), texts.columns.index("toxic")

    def added_up(first, last, toxic) -> pa.RecordBatch:
        a, b, y = np.concatenate(first), np.concatenate(last), np.concatenate(toxic)
        _, at, group, n = np.unique(pair_keys(a, b), return_index=True, return_inverse=True, return_counts=True)
        n_toxic = np.bincount(group, weights=y, minlength=len(n)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64)), pa.array(n_toxic), pa.array(n - n_toxic)],
            names=["a", "b", "toxic", "ordinary"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        first, last, toxic = [], [], []
        for batch in batches:
            marks, start = np.asarray(batch.column(toxic_at)).astype(np.int64), 0
            for block in byte_texts(batch.column(text_at)):
                symbols, sizes = _sequence(block)
                first.append(symbols[:-1])
                last.append(symbols[1:])
                toxic.append(np.repeat(marks[start:start + len(block)], sizes))
                start += len(block)
                held += len(symbols)
                if held > PAIRS_AT_ONCE:
                    yield added_up(first, last, toxic)
                    first, last, toxic, held = [], [], [], 0
        if held:
            yield added_up(first, last, toxic)

    parts = texts.mapInArrow(tidy(count), "a long, b long, toxic long, ordinary long")
    return parts.groupBy("a", "b").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _seen(name: str) -> Column:
    return F.sum((F.col(name) > 0).cast("long")).alias(f"seen_{name}")


def train_classes(texts: DataFrame, head_entries: int) -> ClassModels | None:
    """Both models from (text, toxic); None unless both classes have texts."""
    classes = ("toxic", "ordinary")
    every = count_pairs(texts)
    # one table from one shuffle of the pairs: histories, contexts, and the pairs that have terms
    kept = cut_lineage(
        every.groupBy("a").agg(*map(_seen, classes), *[F.sum(c).alias(f"n_{c}") for c in classes])
        .select(F.lit("after").alias("kind"), "a", F.lit(None).cast("long").alias("b"), *[f"seen_{c}" for c in classes],
                *[f"n_{c}" for c in classes])
        .unionByName(every.groupBy(F.col("b").alias("a")).agg(*map(_seen, classes)).withColumn("kind", F.lit("before")),
                     allowMissingColumns=True)
        .unionByName(every.filter("toxic > 1 OR ordinary > 1").select(
            F.lit("pair").alias("kind"), "a", "b", *[F.col(c).alias(f"n_{c}") for c in classes]), allowMissingColumns=True))
    after = kept.filter("kind = 'after'").select(F.col("a").alias("word"), *[
        f for c in classes for f in (f"n_{c}", F.col(f"seen_{c}").alias(f"types_{c}"))])
    before = kept.filter("kind = 'before'").select(
        F.col("a").alias("word"), *[F.col(f"seen_{c}").alias(f"contexts_{c}") for c in classes])
    pairs = kept.filter("kind = 'pair'").select("a", "b", *[F.col(f"n_{c}").alias(c) for c in classes])
    counted = cut_lineage(after.join(before, "word"))
    total = counted.agg(F.count("*").alias("v"), *[
        f for c in classes for f in (F.sum(f"contexts_{c}").alias(f"contexts_{c}"), _seen(f"contexts_{c}").alias(f"words_{c}"))
    ]).first()
    if not all(total[f"words_{c}"] for c in classes):
        return None
    unseen = {c: total[f"words_{c}"] / total[f"contexts_{c}"] / (total["v"] + 1) for c in classes}
    words = cut_lineage(counted.withColumns({
        f"p_{c}": F.greatest(F.col(f"contexts_{c}") - 1, F.lit(0)) / float(total[f"contexts_{c}"]) + unseen[c]
        for c in classes}))

    def word_term(c):
        history = F.when(F.col(f"n_{c}") > 0, F.log(F.col(f"types_{c}") / F.col(f"n_{c}"))).otherwise(0.0)
        return (F.log(F.col(f"p_{c}") / unseen[c]) + history).alias(c)

    def pair_term(c):
        held = F.log1p((F.col(c) - 1) / (F.col(f"types_{c}") * F.col(f"last_{c}")))
        return F.when(F.col(c) > 1, held).otherwise(0.0).alias(c)

    single = words.select("word", F.lit(None).cast("long").alias("b"), *map(word_term, classes),
                          (F.col("n_toxic") + F.col("n_ordinary")).alias("n")).filter("toxic <> 0 OR ordinary <> 0")
    first = words.select(F.col("word").alias("a"), *[f"types_{c}" for c in classes])
    last = words.select(F.col("word").alias("b"), *[F.col(f"p_{c}").alias(f"last_{c}") for c in classes])
    double = pairs.join(first, "a").join(last, "b").select(
        F.col("a").alias("word"), "b", *map(pair_term, classes), (F.col("toxic") + F.col("ordinary")).alias("n"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            pair = np.asarray(batch.column(1).is_valid())
            b = np.asarray(batch.column(1).fill_null(0)).astype(np.int64).view(np.uint64)
            keys = np.where(pair, pair_keys(a, b), a)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *batch.columns[2:]],
                                             names=["key", "toxic", "ordinary", "n"])

    terms = cut_lineage(single.unionByName(double).mapInArrow(keyed, "key long, toxic double, ordinary double, n long")
                        .withColumn("size", F.floor(8 * F.log2("n"))))
    least, held = None, 0
    sizes = sorted(terms.groupBy("size").count().collect(), reverse=True)
    for row in sizes:
        if held + row["count"] > head_entries:
            break
        least, held = row["size"], held + row["count"]
    frequent = F.lit(False) if least is None else F.col("size") >= least
    table = terms.filter(frequent).select("key", "toxic", "ordinary").toArrow()
    keys = np.asarray(table["key"]).astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    head = tuple([keys[order], *[np.asarray(table[c]).astype(float)[order] for c in classes]])
    tail_terms = sum(row["count"] for row in sizes) - held
    tail = terms.filter(~frequent).select("key", "toxic", "ordinary") if tail_terms else None
    return ClassModels(head, tail, tuple([math.log(unseen[c]) for c in classes]), tail_terms)


# --- likelihoods ---

def log_likelihoods(documents: DataFrame, models: ClassModels, text_col: str) -> DataFrame:
    """(text_hash, toxic, ordinary): both log-likelihoods of every different text, by its xxhash64.

    A task reads copies once; copies in different tasks come to the same sums.
    """
    session = documents.sparkSession.sparkContext
    rare, head, unseen = models.tail is not None, session.broadcast(models.head), models.unseen
    bits = 1 << max(0, math.ceil(math.log2(BITS_A_TERM * max(1, models.tail_terms))))
    bits = min(max(TAIL_BITS, bits), MOST_TAIL_BITS)
    bloom = session.broadcast(build_bloom(models.tail.select("key"), bits) if rare else None)
    shards = max(LEAST_SHARDS, math.ceil(models.tail_terms / SHARD_TERMS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *terms = head.value
        starts = np.concatenate([[0], np.cumsum(np.bincount(_bucket(keys), minlength=BUCKETS))])
        known, block_id = set(), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, start = np.asarray(batch.column(0)).astype(np.int64), 0
            for block in byte_texts(batch.column(1)):
                own, start = ids[start:start + len(block)], start + len(block)
                fresh = []
                for i, text in enumerate(own.tolist()):
                    if text not in known:
                        known.add(text)
                        fresh.append(i)
                if len(known) > KNOWN_TEXTS:
                    known.clear()
                if not fresh:
                    continue
                sums, asked, owners = _asked(
                    _sequence([block[i] for i in fresh]), (keys, starts), terms, unseen, bloom.value)
                if rare:
                    yield _block_rows(block_id, own[fresh], sums, asked, owners, shards)
                    block_id += 1
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[fresh], *sums)],
                                                     names=["text_hash", "toxic", "ordinary"])

    texts = documents.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    summed = "text_hash long, toxic double, ordinary double"
    if rare:
        rows = texts.mapInArrow(tidy(ask), PACKED).unionByName(_packed_terms(models.tail, shards))
        dealt = rows.repartition("shard").sortWithinPartitions("shard", "kind")
        answers = dealt.mapInArrow(
            tidy(_answer), "block long, keys array<bigint>, owners array<int>, toxic array<double>, ordinary array<double>")
        found = answers.groupBy("block").applyInArrow(_add_up, summed)
    else:
        found = texts.mapInArrow(tidy(ask), summed)
    return found.groupBy("text_hash").agg(F.min("toxic").alias("toxic"), F.min("ordinary").alias("ordinary"))


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)


def _places(keys: np.ndarray, starts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each hash stands among the sorted ``keys``, or -1."""
    bucket = _bucket(asked)
    at, end = starts[bucket], starts[bucket + 1]
    found = np.full(len(asked), -1)
    left = np.flatnonzero(at < end)
    while len(left):
        same = keys[at[left]] == asked[left]
        found[left[same]] = at[left[same]]
        left = left[~same]
        at[left] += 1
        left = left[at[left] < end[left]]
    return found


def _asked(sequence, index, terms, unseen, bloom) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The sums of each text's frequent terms, and the keys of rare terms that it may have, with their texts."""
    symbols, sizes = sequence
    asked = np.concatenate([symbols[:-1], pair_keys(symbols[:-1], symbols[1:])])
    owner = np.tile(np.repeat(np.arange(len(sizes)), sizes), 2)
    at = _places(*index, asked)
    hit = at >= 0
    sums = [sizes * none + np.bincount(owner[hit], weights=t[at[hit]], minlength=len(sizes))
            for t, none in zip(terms, unseen)]
    rest = np.flatnonzero(~hit)
    rest = rest[bloom.holds(asked[rest])] if bloom is not None else rest[:0]
    return sums, asked[rest], owner[rest]


# --- rare terms ---

def _lists(lengths: np.ndarray, values: np.ndarray | None) -> pa.Array:
    """A list of each length, cut from ``values``; without these as many nulls."""
    if values is None:
        return pa.nulls(len(lengths), pa.list_(pa.int32()))
    cuts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))


def _packed(shards, kind, block, lengths, keys, owners, toxic, ordinary) -> pa.RecordBatch:
    n = len(lengths)
    doubles = [pa.nulls(n, pa.list_(pa.float64())) if x is None else _lists(lengths, x) for x in (toxic, ordinary)]
    return pa.RecordBatch.from_arrays(
        [pa.array(shards, pa.int32()), pa.array(np.full(n, kind, dtype=np.int32)),
         pa.array(np.full(n, block, dtype=np.int64)), _lists(lengths, keys.view(np.int64)),
         _lists(lengths, owners), *doubles],
        names=["shard", "kind", "block", "keys", "owners", "toxic", "ordinary"])


def _by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the shards that the keys lie in, how many lie in each, the keys' order by shard)."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    counts = np.bincount(shard, minlength=shards)
    used = np.flatnonzero(counts)
    return used, counts[used], np.argsort(shard, kind="stable")


def _block_rows(block: int, ids, sums, asked, owners, shards: int) -> pa.RecordBatch:
    """A row with the texts of a block and their sums, then a row for each shard that they ask."""
    texts = _packed([block % shards], TEXTS, block, np.array([len(ids)]), ids, None, *sums)
    used, counts, order = _by_shard(asked, shards)
    more = _packed(used, ASKED, block, counts, asked[order], owners[order].astype(np.int32), None, None)
    return pa.Table.from_batches([texts, more]).combine_chunks().to_batches()[0]


def _packed_terms(tail: DataFrame, shards: int) -> DataFrame:
    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys, toxic, ordinary = (np.concatenate([np.asarray(p.column(i)) for p in parts]) for i in range(3))
        keys = keys.astype(np.int64).view(np.uint64)
        used, counts, order = _by_shard(keys, shards)
        return _packed(used, TERMS, 0, counts, keys[order], None, toxic[order], ordinary[order])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            parts.append(batch)
            held += batch.num_rows
            if held >= TERMS_AT_ONCE:
                yield packed(parts)
                parts, held = [], 0
        if held:
            yield packed(parts)

    return tail.select("key", "toxic", "ordinary").mapInArrow(tidy(pack), PACKED)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and kind: its terms, then rows of texts, which go through, and what blocks ask."""
    shard, terms, table = None, [], None
    for batch in batches:
        place, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(kinds) != 0)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(place)]):
            if start == stop:
                continue
            part = batch.slice(start, stop - start)
            if place[start] != shard:
                shard, terms, table = place[start], [], None
            if kinds[start] == TERMS:
                terms.append([np.asarray(part.column(i).flatten()) for i in (3, 5, 6)])
            elif kinds[start] == TEXTS:
                yield part.select(["block", "keys", "owners", "toxic", "ordinary"])
            elif terms:
                if table is None:
                    keys, *values = (np.concatenate(x) for x in zip(*terms))
                    order = np.argsort(keys)
                    table = keys[order], *[v[order] for v in values]
                yield _answers(part, *table)


def _answers(part: pa.RecordBatch, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    asked, owners = (np.asarray(part.column(i).flatten()) for i in (3, 4))
    slot = np.repeat(np.arange(part.num_rows), np.asarray(part.column(3).value_lengths())) * TEXTS_AT_ONCE + owners
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = keys[at] == asked
    at, slot = at[hit], slot[hit]
    slots, inverse = np.unique(slot, return_inverse=True)
    lengths = np.bincount(slots // TEXTS_AT_ONCE, minlength=part.num_rows)
    sums = [np.bincount(inverse, weights=v[at], minlength=len(slots)) for v in values]
    return pa.RecordBatch.from_arrays(
        [part.column(2), pa.nulls(part.num_rows, pa.list_(pa.int64())),
         _lists(lengths, (slots % TEXTS_AT_ONCE).astype(np.int32)), *[_lists(lengths, x) for x in sums]],
        names=["block", "keys", "owners", "toxic", "ordinary"])


def _add_up(table: pa.Table) -> pa.Table:
    """(text_hash, toxic, ordinary) of the texts of a block: their own sums and all answers."""
    own = table["keys"].is_valid()
    texts, answers = table.filter(own), table.filter(pc.invert(own))
    ids, owners = texts["keys"].combine_chunks().flatten(), np.asarray(answers["owners"].combine_chunks().flatten())
    sums = [np.asarray(texts[c].combine_chunks().flatten()) + np.bincount(
        owners, weights=np.asarray(answers[c].combine_chunks().flatten()), minlength=len(ids)) for c in ("toxic", "ordinary")]
    return pa.table({"text_hash": ids, "toxic": pa.array(sums[0]), "ordinary": pa.array(sums[1])})
