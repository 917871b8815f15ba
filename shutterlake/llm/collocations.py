"""Phrase collocations: best-first branch-and-bound growth of phrases, one pass over the corpus per round.

Texts are lower-cased (A-Z), split into pieces at sentence marks and line ends and into words at spaces and
tabs. A phrase of 2 to ``longest`` words that occurs at least ``least`` times in its language is a
candidate; cut after its first k words it scores floor(1000 * a * n / (l * r)), the lowest cut counts.

The search grows phrases word by word to the right. A frontier holds words and phrases with the count of
their first word as bound: a phrase that starts with w has r >= a in its first cut, so no growth of w scores
above 1000 * n / f(w). Every round pops the nodes of the best bounds: bands of first words, rarest first,
and all children found in the round before, unless their bound lies below the language's settled
``keep``-th score (equal bounds are still grown). One pass then counts, exactly and over the whole corpus,
the growth of the popped nodes on both sides (the left side decides whether a longer candidate swallows the
node) and the tails that new children need for their cuts. The search ends when no node can reach the
settled score of its language.

Texts are read twice, for the words' counts and to write the corpus down as numbers of its frequent words
(a word below ``least`` can be in no candidate); rounds read these numbers. What a pass must count travels
as Bloom filters of fixed size; a phrase they let pass by chance is counted exactly too, and is
only taken up when its node was popped. Each task adds up its phrases before the shuffle, so a phrase or a
language with most of the corpus costs one row per task and flush.

Defined results: null texts are empty; a null language is ``und``. Repeated rows count each time. Other
columns, whatever their names, are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.bloom import Bloom, build_bloom
from shutterlake.llm.common import GrowingTable, arrow_schema, byte_texts, tidy
from shutterlake.session import cut_lineage

BREAKS = b".,;:!?\n\x0b\x0c\r"
LEAST, LONGEST, KEEP = 100, 5, 2000
BAND = 32                 # each round's first words may be so many times as frequent as the last round's
CHUNK_WORDS = 1 << 18     # numbers of a row of the written corpus
FLUSH = 1 << 19           # phrases or words a task adds up before it sends them on
PHRASE_BITS = 1 << 24     # 2 MB a filter
COUNTED = "lang string, phrase string, f long"
SETTLED = "lang string, phrase string, a long, l long, r long, n long, score long"
ASKED = "lang string, phrase string"
#: a filter holds phrases in three roles, told apart by what is added to their hashes: nodes, tails, and
#: whatever was a node or a tail so far
NODE, TAIL, EVER = np.array([0, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], dtype=np.uint64)
CHUNKS = "lang string, words array<string>, hashes binary, numbers binary"

_LOWER = bytes(10 if b in BREAKS else b for b in bytes(range(256)).lower())


def pieces_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of every piece of a text."""
    for piece in data.translate(_LOWER).split(b"\n"):
        words = piece.split()  # space and tab only: the other white space ends a piece
        if words:
            yield words


def _language_texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    langs = batch.column(0).to_pylist()
    at = 0
    for texts in byte_texts(batch.column(1)):
        for data in texts:
            if data:
                yield langs[at], data
            at += 1


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text_col).alias("text"))


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, f) of all words, and per language a row with a null phrase: all occurrences."""
    kind = arrow_schema(COUNTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        size = 0

        def flush():
            for lang, counts in found.items():
                words, numbers = [*counts, None], [*counts.values(), sum(counts.values())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(words)), pa.array(words, pa.binary()).cast(pa.string()),
                    pa.array(numbers, pa.int64())], schema=kind)
            found.clear()

        for batch in batches:
            for lang, data in _language_texts(batch):
                counts = found[lang]
                before = len(counts)
                for words in pieces_of(data):
                    counts.update(words)
                size += len(counts) - before
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    made = _rows(docs, text_col, lang_col).mapInArrow(tidy(count), COUNTED)
    return made.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


# --- the corpus as numbers --------------------------------------------------------------------

def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _word_hash(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)


def _joined(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one word more."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + more
    return mixed ^ (mixed >> np.uint64(32))


def phrase_hashes(phrases: DataFrame) -> DataFrame:
    """(hash) of (lang, phrase, role) rows, as the passes compute it from the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(len(batch), dtype=np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                words = _word_hash(phrase.encode().split(b" "))
                total = words[:1] + _seed(lang)
                for word in words[1:]:
                    total = _joined(total, word)
                out[i] = total[0]
            out ^= np.array([NODE, TAIL, EVER])[np.asarray(batch.column(2))]
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["hash"])

    return phrases.select("lang", "phrase", "role").mapInArrow(tidy(run), "hash long")


def numbered_corpus(docs: DataFrame, frequent: DataFrame, text_col: str = "text",
                    lang_col: str = "lang") -> DataFrame:
    """The corpus as written rows (lang, words, their hashes, numbers): numbers[i] - 1 is a place in ``words``.

    0 ends a piece or stands for words that are not frequent; runs of 0 are one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        build_bloom(phrase_hashes(frequent.withColumn("role", F.lit(0))), PHRASE_BITS).words)
    kind = arrow_schema(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(shared.value)
        held: dict[str, tuple[dict[bytes, int], list[int]]] = defaultdict(lambda: ({}, []))
        size = 0

        def chunk(lang: str) -> pa.RecordBatch:
            places, numbers = held.pop(lang)
            words = list(places)
            hashes = _word_hash(words)
            known = bloom.holds(hashes + _seed(lang))
            renumbered = np.zeros(len(words) + 1, dtype=np.int32)
            renumbered[1:][known] = np.arange(1, known.sum() + 1)
            out = renumbered[np.array(numbers, dtype=np.int32)]
            again = np.zeros(len(out), dtype=bool)
            again[1:] = (out[1:] == 0) & (out[:-1] == 0)
            kept = [w.decode() for w, k in zip(words, known) if k]
            return pa.RecordBatch.from_pylist([{"lang": lang, "words": kept, "hashes": hashes[known].tobytes(),
                                                "numbers": out[~again].tobytes()}], schema=kind)

        for batch in batches:
            for lang, data in _language_texts(batch):
                places, numbers = held[lang]
                size -= len(numbers)
                for words in pieces_of(data):
                    numbers += [places.setdefault(w, len(places) + 1) for w in words]
                    numbers.append(0)
                size += len(numbers)
                if len(numbers) >= CHUNK_WORDS:
                    size -= len(numbers)
                    yield chunk(lang)
                if size >= 4 * CHUNK_WORDS:  # many languages
                    for other in list(held):
                        yield chunk(other)
                    size = 0
        for lang in list(held):
            yield chunk(lang)

    return cut_lineage(_rows(docs, text_col, lang_col).mapInArrow(tidy(run), CHUNKS))


# --- one pass ---------------------------------------------------------------------------------

def count_phrases(corpus: DataFrame, wanted: Bloom, longest: int) -> DataFrame:
    """(lang, phrase, f): all occurrences of the phrases that extend a node by one word, or are tails.

    Nodes of one word are extended to the right only, longer ones on both sides.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(wanted.words)
    kind = arrow_schema(COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(shared.value)
        for batch in batches:
            for at in range(len(batch)):  # a row is large
                lang, hashes, numbers = (batch.column(c)[at].as_py() for c in (0, 2, 3))
                words = batch.column(1).slice(at, 1).flatten()
                for phrases, counts in _chunk_phrases(lang, words, np.frombuffer(hashes, dtype=np.uint64),
                                                      np.frombuffer(numbers, dtype=np.int32), bloom, longest):
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(lang, len(counts)), phrases, pa.array(counts)], schema=kind)

    passed = corpus.mapInArrow(tidy(run), COUNTED)
    return passed.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _holds(bloom: Bloom, hashes: np.ndarray) -> np.ndarray:
    """As ``bloom.holds``, for hashes most of which are not in it: the others are looked at once."""
    bits = np.uint64(64 * len(bloom.words) - 1)
    place = hashes & bits
    found = (bloom.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    found[found] = bloom.holds(hashes[found])
    return found


def _chunk_phrases(lang: str, words: pa.Array, hashes: np.ndarray, numbers: np.ndarray, bloom: Bloom,
                   longest: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Distinct phrases of one chunk that a pass counts, with their numbers of occurrences.

    The last number is 0, so that the word behind any phrase, and before the first, can be looked at.
    """
    if not len(words):
        return
    hashes = np.concatenate([np.zeros(1, dtype=np.uint64), hashes])
    of_word = hashes[numbers]
    named = pa.concat_arrays([pa.array([""], words.type), words])
    alive = np.flatnonzero(numbers)  # starts of words, then of longer phrases that were ever asked for
    total = of_word[alive] + _seed(lang)
    word_nodes = np.concatenate([[False], bloom.holds(hashes[1:] + _seed(lang) ^ NODE)])
    nodes = alive[word_nodes[numbers[alive]]]
    for size in range(2, longest + 1):
        wanted = [nodes[numbers[nodes + size - 1] > 0]]
        if size > 2:
            wanted.append(nodes[numbers[nodes - 1] > 0] - 1)
        if size < longest:
            whole = numbers[alive + size - 1] > 0
            alive, total = alive[whole], total[whole]
            total = _joined(total, of_word[alive + size - 1])
            ever = _holds(bloom, total ^ EVER)
            alive, total = alive[ever], total[ever]
            nodes = alive[bloom.holds(total ^ NODE)]
            wanted.append(alive[bloom.holds(total ^ TAIL)])
        starts = np.unique(np.concatenate(wanted))
        if len(starts):
            yield _added_up(starts, numbers, size, named, len(words) + 1)


def _added_up(starts: np.ndarray, numbers: np.ndarray, size: int, named: pa.Array,
              vocabulary: int) -> tuple[pa.Array, np.ndarray]:
    codes = numbers[starts].astype(np.int64)
    for step in range(1, size):  # exact: a pair (code so far, next word) becomes the next code
        codes, _ = pd.factorize(codes * vocabulary + numbers[starts + step])
    counts = np.bincount(codes)
    first = np.empty(len(counts), dtype=np.int64)
    first[codes[::-1]] = starts[::-1]
    parts = [named.take(pa.array(numbers[first + step])) for step in range(size)]
    return pc.binary_join_element_wise(*parts, " "), counts.astype(np.int64)


# --- the search -------------------------------------------------------------------------------

def _length() -> Column:
    return F.size(F.split("phrase", " "))


def _head(size: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), F.lit(1), size), " ")


def _rest(first: Column) -> Column:
    """The phrase without its first words."""
    return F.array_join(F.slice(F.split("phrase", " "), first + 1, _length()), " ")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (l * r)), exactly: the products are decimals of 38 digits."""
    def product(x: Column, y: Column) -> Column:
        return (x.cast("decimal(19,0)") * y.cast("decimal(18,0)")).cast("decimal(38,0)")

    return F.call_function("div", product(1000 * a, n), product(left, right)).cast("long")


def _scored(found: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) by the lowest cut, the first of equals."""
    cuts = found.select("lang", "phrase", F.col("f").alias("a"),
                        F.explode(F.sequence(F.lit(1), _length() - 1)).alias("k"))
    cuts = cuts.withColumns({"head": _head(F.col("k")), "rest": _rest(F.col("k"))})
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    full = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(totals, "lang")
    full = full.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = full.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def _survivors(scored: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Without the phrases that a longer candidate holds in ``percent`` of their occurrences.

    Counts fall as phrases grow, so that one word more decides for all longer ones.
    """
    parts = F.array(_head(_length() - 1), _rest(F.lit(1)))
    longer = counts.filter(_length() > 2).select("lang", "f", F.explode(parts).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = scored.join(most, ["lang", "phrase"], "left")
    return kept.filter(F.coalesce(100 * F.col("most") < percent * F.col("a"), F.lit(True))).drop("most")


def _first(settled: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return settled.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                 longest: int = LONGEST, keep: int = KEEP, percent: int = 100, band: int = BAND) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``keep`` phrases.

    By score, then a, both descending, then phrase ascending (bytes). Candidates whose words lie within a
    longer candidate b with 100 * f(b) >= percent * a are left out. Needs longest >= 2, percent 1 to 100.
    """
    if longest < 2 or least < 1 or not 0 < percent <= 100:
        raise ValueError("longest must be 2 or more, least 1 or more, percent within 1 and 100")
    counted = cut_lineage(word_counts(docs, text_col, lang_col).filter(
        F.col("phrase").isNull() | (F.col("f") >= least)))
    totals = cut_lineage(counted.filter("phrase IS NULL").select("lang", F.col("f").alias("n")))
    words = counted.filter("phrase IS NOT NULL")
    corpus = numbered_corpus(docs, words, text_col, lang_col)
    first = words.select("lang", F.col("phrase").alias("word"), F.col("f").alias("of_word"))

    most = words.agg(F.max("f")).first()[0] or 0
    counts = GrowingTable(docs.sparkSession, COUNTED)      # all counts known so far, each phrase once
    settled = GrowingTable(docs.sparkSession, SETTLED)     # phrases whose cuts and longer phrases are known
    ever = GrowingTable(docs.sparkSession, ASKED)          # nodes of two or more words, and tails, so far
    counts.add(words)
    found = words.filter("false")                          # children of the last round's nodes
    limits = totals.withColumn("limit", F.lit(0).cast("long"))
    lower = least

    def hopeful(phrases: DataFrame) -> DataFrame:
        bound = F.call_function("div", 1000 * F.col("n"), F.col("of_word"))
        named = phrases.withColumn("word", F.substring_index("phrase", " ", 1))
        return (named.join(first, ["lang", "word"]).join(limits, "lang").filter(bound >= F.col("limit"))
                .select("lang", "phrase", "f"))

    while lower <= most or not found.isEmpty():
        started = words.filter((F.col("f") >= lower) & (F.col("f") < lower * band))
        lower *= band
        # the first words of this round, and the children of the last one, without the hopeless
        popped = cut_lineage(hopeful(found.unionByName(started)))
        children = popped.filter(_length() > 1)
        nodes = popped.filter(_length() < longest).select("lang", "phrase")
        tails = popped.filter(_length() > 2).select(
            "lang", "phrase", F.explode(F.sequence(F.lit(1), _length() - 2)).alias("k")
        ).select("lang", _rest(F.col("k")).alias("phrase")).distinct()
        ever.add(children.select("lang", "phrase").unionByName(tails))
        roles = (nodes.withColumn("role", F.lit(0)).unionByName(tails.withColumn("role", F.lit(1)))
                 .unionByName(ever.read().withColumn("role", F.lit(2))))
        passed = count_phrases(corpus, build_bloom(phrase_hashes(roles), PHRASE_BITS), longest)
        counts.add(passed.filter(F.col("f") >= least).join(
            counts.read().select("lang", "phrase"), ["lang", "phrase"], "left_anti"))
        settled.add(_survivors(_scored(children, counts.read(), totals), counts.read(), percent))
        low = _first(settled.read(), keep).groupBy("lang").agg(
            F.min("score").alias("low"), F.count("*").alias("c"))
        limits = cut_lineage(totals.join(low, "lang", "left").select(
            "lang", "n", F.when(F.col("c") >= keep, F.col("low")).otherwise(F.lit(0)).alias("limit")))
        found = cut_lineage(
            counts.read().filter(_length() > 1).withColumn("parent", _head(_length() - 1))
            .join(nodes.select("lang", F.col("phrase").alias("parent")), ["lang", "parent"], "left_semi")
            .select("lang", "phrase", "f"))
    return _first(settled.read(), keep).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
