"""Repeated passages: compact windows of min-hashes, joined across texts and verified word by word.

A text's tokens are its word shingles. Under one hash function the Cartesian tree of the token hashes
groups all subsequences by their smallest token: the node (l, c, r) stands for every subsequence of
[l, r] that holds c. Only nodes of ``passage`` words or more are kept, about two for every ``passage``
words. Passages of two texts that hold the same words have the same smallest token, so their windows
share a signature: the hash function and the words at c. Similar passages do so for most functions.

1. One aggregate finds the signatures that occur in different documents, and their smallest document,
   the representative. It combines before the shuffle, so a passage in a third of all documents costs
   one row per task.
2. Windows of these signatures (a Bloom filter of fixed size, then an exact join) meet the
   representative's window. Two windows are aligned at c; the stretch both cover is an interval, the
   distance of their places its delta. The smallest document may hold no more than the signature, so a
   window of the first function also meets others by its runs: exact stretches of ``run_words`` words around
   c, of which two texts that share ``passage`` words around c share one. Windows whose run differs from the
   representative's meet the smallest document that holds the same run. A common run is itself a similar
   stretch, so equal passages are always linked through its smallest document. The work is linear in the windows.
3. Intervals of the same documents are joined where they overlap and their deltas differ by no more than
   the allowance, as an added or dropped word moves all that follows; ``needed`` different hash
   functions or a common run make a candidate.
4. The candidates' words are compared: two stretches of ``passage`` words or more, one in each text, count
   where the Jaccard similarity of their shingles is ``percent`` hundredths or more. Shingles are common
   where they are equal and no further apart than the candidate's deltas and the allowance.

The allowance is how many shingles longer than a passage a stretch can be that is similar to one.

Equal passages are all found. A passage with edits closer together than a run is found by its signatures alone: where their smallest
documents hold other words around them, it can be missed.

Null ids, null and empty texts and texts shorter than ``passage`` words have no passages. Rows that
repeat an id are parts of one document; passages inside one document do not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from shutterlake.llm.bloom import Bloom, build_bloom
from shutterlake.llm.common import byte_texts
from shutterlake.llm.shingles import WordHashes, mixed, sequence_hashes
from shutterlake.session import cut_lineage

HASHES = 6
CONTEXT = 10                # words of a signature, from c on; one shingle for the first function
SIGNATURE_BITS = 1 << 26    # Bloom filter of shared signatures: 8 MB
SEGMENT = 448               # words compared in one row, besides the overlap
GRID = 64                   # the representative's words are cut out in multiples of this
ROWS_AT_ONCE = 4096         # rows a task passes on together
WINDOW_FIELDS = "key long, doc_id long, f int, l int, c int, r int, runs array<int>"
MULTIPLIER = 0x9E3779B97F4A7C15  # of the hash of a run; odd


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r), both ends included, of the Cartesian tree's nodes of ``least`` or more positions."""
    found, todo = [], [(0, len(values))]
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        c = low + int(values[low:high].argmin())
        found.append((low, c, high - 1))
        todo.append((low, c))
        todo.append((c + 1, high))
    return found


def signed_windows(words: np.ndarray, width: int, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, (f, l, c, r) rows) of one text, given its word hashes."""
    rows: list[tuple[int, int, int, int]] = []
    if len(words) >= passage:
        tokens = sequence_hashes(words, width)
        for f in range(HASHES):
            rows += [(f, *w) for w in compact_windows(mixed(tokens + np.uint64(f << 56)), passage - width + 1)]
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 4), dtype=np.int32)
    places = np.array(rows, dtype=np.int32)
    context = sequence_hashes(words, CONTEXT)
    at = np.minimum(places[:, 2], len(context) - 1)
    # words behind a passage must not part equal ones for the function that has runs
    signed = np.where(places[:, 0] == 0, tokens[places[:, 2]], context[at])
    return mixed(signed + places[:, 0].astype(np.uint64)).view(np.int64), places


def run_words(width: int, passage: int, percent: int) -> int:
    """The fewest words that two texts must share in a row for ``passage`` words there to be similar."""
    tokens = passage - width + 1
    common = -(-2 * tokens * percent // (100 + percent))  # common >= percent of (2 tokens - common)
    return min(common + width - 1, passage)


def runs_of(width: int, passage: int, percent: int) -> list[tuple[int, int]]:
    """(words before c, words from c on) of the runs of a window.

    Texts that share a before c and b from c on, a + b >= passage, share the run of the largest second
    number up to b: these are so close together that the rest of its words lies within a.
    """
    words = run_words(width, passage, percent)
    step = passage - words + 1
    return [(max(words - n, 0), n) for n in range(0, words + step, step)]


class RunHashes:
    """Hashes of stretches of a text's words, any of them from two sums."""

    def __init__(self, runs: list[tuple[int, int]]):
        self.runs = runs
        self.powers = self.inverse = np.zeros(0, dtype=np.uint64)

    def of(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row for each of the places ``at`` with the hashes of its runs; 0 where the text ends before the run does."""
        if len(self.powers) <= len(words):
            more = 2 * len(words) + 1
            self.powers, self.inverse = (
                np.cumprod(np.array([1] + [m] * more, dtype=np.uint64), dtype=np.uint64)
                for m in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * self.powers[:len(words)], dtype=np.uint64)])
        found = []
        for before, on in self.runs:
            inside = (at >= before) & (at + on <= len(words))
            low, high = np.where(inside, at - before, 0), np.where(inside, at + on, 0)
            made = (mixed((sums[high] - sums[low]) * self.inverse[low]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            found.append(np.where(inside, np.where(made == 0, 1, made), 0).astype(np.int32))
        return np.column_stack(found)


def window_table(documents: DataFrame, width: int, passage: int, only: Bloom | None = None,
                 places: bool = True, runs: list[tuple[int, int]] = ()) -> DataFrame:
    """The windows of ``documents`` (doc_id, text); without ``places`` just (key, doc_id).

    With ``places`` also the hashes of the ``runs`` of the first function's windows; the others have none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(only)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bloom, run_hashes = WordHashes(), shared.value, RunHashes(list(runs))
        for batch in batches:
            ids, start = np.asarray(batch.column(0)), 0
            for texts in byte_texts(batch.column(1)):
                keys, rows, owners, held = [], [], [], []
                for doc_id, data in zip(ids[start:start + len(texts)], texts):
                    words = hashes.of(data.lower().split() if data else [])
                    made, placed = signed_windows(words, width, passage)
                    if bloom is not None and len(made):
                        keep = bloom.holds(made.view(np.uint64))
                        made, placed = made[keep], placed[keep]
                    if len(made):
                        keys.append(made)
                        rows.append(placed)
                        owners.append(np.full(len(made), doc_id))
                        if places:
                            held.append(run_hashes.of(words, placed[placed[:, 0] == 0, 2].astype(np.int64)))
                start += len(texts)
                if not keys:
                    continue
                columns = [pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))]
                names = ["key", "doc_id"]
                if places:
                    all_rows = np.concatenate(rows)
                    columns += [pa.array(np.ascontiguousarray(all_rows[:, i])) for i in range(4)]
                    sizes = np.where(all_rows[:, 0] == 0, len(runs), 0)
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).ravel())))
                    names += ["f", "l", "c", "r", "runs"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.mapInArrow(emit, WINDOW_FIELDS if places else "key long, doc_id long")


def shared_signatures(documents: DataFrame, width: int, passage: int) -> DataFrame:
    """(key, rep) of the signatures that occur in different documents; rep is the smallest of these."""
    return (window_table(documents, width, passage, places=False)
            .groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
            .filter("rep < last").select("key", "rep"))


def allowance(tokens: int, percent: int) -> int:
    """By how many shingles a stretch can be longer than one of ``tokens`` that it is similar to."""
    return tokens * (100 - percent) // percent


def met_windows(windows: DataFrame, runs: list[tuple[int, int]]) -> DataFrame:
    """``windows`` with the window ``at`` of their representative, and which ``runs`` are not equal to its own."""
    first = windows.filter("doc_id = rep").groupBy("key").agg(F.min(F.struct("c", "l", "r", "runs")).alias("at"))
    held = [F.coalesce(F.get("runs", F.lit(i)), F.lit(0)) for i in range(len(runs))]
    same = [h == F.coalesce(F.get("at.runs", F.lit(i)), F.lit(0)) for i, h in enumerate(held)]
    equal = reduce(Column.__or__, [(h != 0) & s for h, s in zip(held, same)])
    # the runs of one text at one place, told apart by their number
    left = F.array_compact(F.array(*[F.when((h != 0) & ~s, F.struct(F.lit(i).alias("run"), h.alias("words")))
                                     for i, (h, s) in enumerate(zip(held, same))]))
    return windows.join(first, "key").select(
        "key", "doc_id", "rep", "f", "l", "c", "r", F.struct("at.c", "at.l", "at.r").alias("at"),
        equal.alias("sure"), left.alias("runs"))


def run_intervals(met: DataFrame, runs: list[tuple[int, int]], width: int) -> DataFrame:
    """Intervals (doc_id, rep, delta, f, low, high) of windows that hold one run with the smallest document that does."""
    single = cut_lineage(met.select("key", "doc_id", "f", "c", F.explode("runs").alias("r"))
                         .select("key", "doc_id", "f", "c", "r.run", "r.words"))
    group = ["key", "run", "words"]
    reps = (single.groupBy(*group).agg(F.min(F.struct("doc_id", "c")).alias("at"), F.max("doc_id").alias("last"))
            .filter("at.doc_id < last").drop("last"))
    before, on = (F.element_at(F.array(*[F.lit(r[side]) for r in runs]), F.col("run") + 1) for side in (0, 1))
    return single.join(reps, group).filter("doc_id <> at.doc_id").select(
        "doc_id", F.col("at.doc_id").alias("rep"), (F.col("c") - F.col("at.c")).alias("delta"), "f",
        (F.col("c") - before).alias("low"), (F.col("c") + on - width).alias("high"))


def candidates(windows: DataFrame, runs: list[tuple[int, int]], width: int, passage_tokens: int, needed: int,
               slack: int) -> DataFrame:
    """(doc_id, rep, least, most, low, high): token ranges that ``needed`` hash functions or a run join to a representative.

    ``windows`` are the shared ones with ``rep``; ``least`` and ``most`` are the ends of the deltas found,
    a delta being the document's place less the representative's.
    """
    met = cut_lineage(met_windows(windows, runs))
    intervals = met.filter("doc_id <> rep").select(
        "doc_id", "rep", (F.col("c") - F.col("at.c")).alias("delta"), "f",
        (F.col("c") - F.least(F.col("c") - F.col("l"), F.col("at.c") - F.col("at.l"))).alias("low"),
        (F.col("c") + F.least(F.col("r") - F.col("c"), F.col("at.r") - F.col("at.c"))).alias("high"), "sure",
    ).filter(F.col("sure") | (F.col("high") - F.col("low") + 1 >= passage_tokens))
    intervals = intervals.unionByName(run_intervals(met, runs, width).withColumn("sure", F.lit(True)))
    # every interval goes to the two bands of deltas that hold it, so any two within the slack share one; what
    # lies in the lower half of a band only is also in the band before
    size = slack + 1
    step = F.floor(F.col("delta") / size)
    banded = intervals.withColumn("band", F.explode(F.array(step - 1, step)))
    group = ["doc_id", "rep", "band"]
    islands = merged_islands(banded, group, overlap=True)
    return (islands.groupBy(*group, "island")
            .agg(F.min("delta").alias("least"), F.max("delta").alias("most"), F.min("low").alias("low"),
                 F.max("high").alias("high"), F.count_distinct("f").alias("hashes"), F.max("sure").alias("sure"))
            .filter((F.col("sure") | (F.col("hashes") >= needed)) & (F.col("most") >= (F.col("band") + 1) * size))
            .drop("band", "island", "hashes", "sure"))


def merged_islands(intervals: DataFrame, group: list[str], overlap: bool) -> DataFrame:
    """``intervals`` (low, high) with ``island``: overlapping ones of a group, or also adjacent ones, share it."""
    order = Window.partitionBy(*group).orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("low") > reach + F.lit(0 if overlap else 1)
    return intervals.withColumn("_new", F.when(reach.isNull() | gap, 1).otherwise(0)).withColumn(
        "island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def cut_words(requests: DataFrame, documents: DataFrame, name: str) -> DataFrame:
    """``requests`` (doc_id, low, high in words, ...) with the hashes of these words as ``name``.

    Only texts that a Bloom filter of the requested ids passes are shuffled, and each meets all
    requests of its document at once; these are bounded by the document's own length.
    """
    wanted = documents.sparkSession.sparkContext.broadcast(
        build_bloom(requests.select(F.xxhash64("doc_id")).distinct()))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = wanted.value.holds(np.asarray(batch.column(2)).astype(np.int64).view(np.uint64))
            yield batch.filter(pa.array(keep))

    probed = documents.select("doc_id", "text", F.xxhash64("doc_id").alias("probe"))
    texts = probed.mapInArrow(pick, "doc_id long, text string, probe long").drop("probe")
    kept = [c for c in requests.columns if c != "doc_id"]
    asked = requests.groupBy("doc_id").agg(F.collect_list(F.struct(*kept)).alias("asked"))
    schema = StructType([requests.schema["doc_id"], *[requests.schema[c] for c in kept],
                         StructField(name, ArrayType(IntegerType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def made(ids: list, parts: list, words_out: list) -> pa.RecordBatch:
            fields = pa.concat_arrays(parts).flatten()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(ids)), *fields, pa.array(words_out, pa.list_(pa.int32()))],
                names=["doc_id", *kept, name])

        for batch in batches:
            row, held = 0, 0
            ids, parts, words_out = [], [], []
            for texts in byte_texts(batch.column(1)):
                for data in texts:
                    words = (hashes.of(data.lower().split() if data else []) & np.uint64(0x7FFFFFFF)).astype(np.int32)
                    whole = batch.column(2)[row].values
                    for start in range(0, len(whole), ROWS_AT_ONCE):
                        part = whole.slice(start, ROWS_AT_ONCE)
                        low, high = (np.asarray(part.field(kept.index(c))) for c in ("low", "high"))
                        words_out += [words[max(a, 0):b + 1] for a, b in zip(low, high)]
                        ids.append(np.full(len(part), batch.column(0)[row].as_py()))
                        parts.append(part)
                        held += len(part)
                        if held >= ROWS_AT_ONCE:
                            yield made(ids, parts, words_out)
                            ids, parts, words_out, held = [], [], [], 0
                    row += 1
            if parts:
                yield made(ids, parts, words_out)

    return texts.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(cut, schema)


def matched_places(a: np.ndarray, b: np.ndarray, width: int, least: int, most: int) -> np.ndarray:
    """For every shingle of ``a`` the place of an equal one in ``b``, ``least`` to ``most`` words before it, or -1.

    Of several, that at the distance with the most equal shingles.
    """
    own, other = (sequence_hashes(x.astype(np.uint64), width) for x in (a, b))
    places = np.full(len(own), -1, dtype=np.int64)
    if not len(own) or not len(other):
        return places
    order = np.argsort(other, kind="stable")
    ranked = other[order]
    if not (ranked[1:] == ranked[:-1]).any():
        at = np.minimum(np.searchsorted(ranked, own), len(other) - 1)
        shift = np.arange(len(own)) - order[at]
        found = (ranked[at] == own) & (shift >= least) & (shift <= most)
        places[found] = order[at][found]
        return places
    hits = []
    for shift in range(least, most + 1):
        low, high = max(0, shift), min(len(own), len(other) + shift)
        if low < high:
            equal = low + np.flatnonzero(own[low:high] == other[low - shift:high - shift])
            if len(equal):
                hits.append((-len(equal), shift, equal))
    for _, shift, equal in sorted(hits, key=lambda h: h[:2]):
        free = equal[places[equal] < 0]
        places[free] = free - shift
    return places


def matched_stretches(places: np.ndarray, others: int, tokens: int, percent: int) -> list[tuple[int, int]]:
    """(first, last) shingle of the stretches of a text that are similar to one of the other text.

    Similar stretches can be taken to begin and end with runs of common shingles. Of a long first or last run
    only the part next to the rest is counted, so a gap is judged by what surrounds it.
    """
    hits = np.flatnonzero(places >= 0)
    if not len(hits) or min(len(places), others) < tokens:
        return []
    ends = np.flatnonzero((np.diff(hits) > 1) | (np.diff(places[hits]) != 1))
    first, last = hits[np.concatenate([[0], ends + 1])], hits[np.concatenate([ends, [len(hits) - 1]])]
    most = tokens + allowance(tokens, percent)
    near, far = np.maximum(first, last - most + 1), np.minimum(last, first + most - 1)
    count = np.concatenate([[0], np.cumsum(places >= 0)])
    own = far[None, :] - near[:, None] + 1
    theirs = places[far][None, :] - places[near][:, None] + 1
    common = count[far + 1][None, :] - count[near][:, None]
    single = np.eye(len(first), dtype=bool)
    length = last - first + 1
    own, theirs, common = (np.where(single, length[:, None], x) for x in (own, theirs, common))
    fits = (np.arange(len(first))[:, None] <= np.arange(len(first))[None, :]) & (theirs > 0)
    fits &= 100 * common >= percent * (np.maximum(own, tokens) + np.maximum(theirs, tokens) - common)
    found: list[tuple[int, int]] = []
    for p in np.flatnonzero(fits.any(axis=1)):
        low, high = int(first[p]), int(last[np.flatnonzero(fits[p])[-1]])
        if found and low <= found[-1][1] + 1:
            found[-1] = found[-1][0], max(found[-1][1], high)
        else:
            found.append((low, high))
    return found


def alike_stretches(a: np.ndarray, b: np.ndarray, width: int, passage: int, percent: int) -> list[tuple[int, int]]:
    """(first, last word) of the stretches of two aligned word sequences that are similar enough; both ends are
    those of an equal shingle."""
    places = matched_places(a, b, width, 0, 0)
    return [(first, last + width - 1) for first, last in
            matched_stretches(places, len(b) - width + 1, passage - width + 1, percent)]


def verified(found: DataFrame, documents: DataFrame, width: int, passage: int, percent: int) -> DataFrame:
    """(doc_id, rep, low, high, rep_low, rep_high): word ranges, ends included, that are alike."""
    tokens = passage - width + 1
    slack = allowance(tokens, percent)
    spans = found.select("doc_id", "rep", (F.col("least") - slack).alias("least"), (F.col("most") + slack).alias("most"),
                         (F.col("low") - passage).alias("low"), (F.col("high") + width - 1 + passage).alias("high"))
    # ranges start where the representative has words; long ones are cut into bounded ones that overlap by two
    # passages, beyond which a similar stretch has a similar part
    spans = spans.withColumn("low", F.greatest("low", F.lit(0), "least"))
    cut = spans.withColumn("low", F.explode(F.sequence("low", F.greatest("low", "high"), F.lit(SEGMENT)))).withColumn(
        "high", F.least(F.col("high"), F.col("low") + SEGMENT + 2 * passage + slack))
    own = cut_words(cut, documents, "own")
    rep_low, rep_high = F.greatest(F.col("low") - F.col("most"), F.lit(0)), F.col("high") - F.col("least")
    gridded = own.withColumns({"cell_low": F.floor(rep_low / GRID) * GRID,
                               "cell_high": F.ceil((rep_high + 1) / GRID) * GRID - 1})
    gridded = cut_lineage(gridded.withColumns({c: F.col(c).cast("int") for c in ("cell_low", "cell_high")}))
    cells = gridded.select(F.col("rep").alias("doc_id"), F.col("cell_low").alias("low"),
                           F.col("cell_high").alias("high")).distinct()
    theirs = cut_words(cells, documents, "theirs").select(
        F.col("doc_id").alias("rep"), F.col("low").alias("cell_low"), F.col("high").alias("cell_high"), "theirs")
    both = gridded.join(theirs, ["rep", "cell_low", "cell_high"]).select(
        "doc_id", "rep", "least", "most", "low", "cell_low", "own", "theirs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, reps, least, most, low, cell = (np.asarray(batch.column(i)) for i in range(6))
            rows = []
            for i in range(batch.num_rows):
                own, rest = (np.asarray(batch.column(c)[i].values) for c in (6, 7))
                ahead = int(low[i]) - int(cell[i])
                places = matched_places(own, rest, width, int(least[i]) - ahead, int(most[i]) - ahead)
                for first, last in matched_stretches(places, len(rest) - width + 1, tokens, percent):
                    there = places[first:last + 1]
                    there = there[there >= 0]
                    rows.append((ids[i], reps[i], low[i] + first, low[i] + last + width - 1,
                                 cell[i] + there.min(), cell[i] + there.max() + width - 1))
            made = np.array(rows, dtype=np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[:, 0]), pa.array(made[:, 1]), *(pa.array(made[:, i].astype(np.int32)) for i in range(2, 6))],
                names=["doc_id", "rep", "low", "high", "rep_low", "rep_high"])

    return both.mapInArrow(compare, "doc_id long, rep long, low int, high int, rep_low int, rep_high int")


def repeated_passages(documents: DataFrame, width: int = 5, percent: int = 80, passage: int = 50,
                      needed: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first_word, last_word, rep_doc_id, rep_first_word): every document's passages, each with the
    representative it repeats. Representatives have rows of their own, with themselves as representative."""
    texts = documents.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = cut_lineage(shared_signatures(texts, width, passage))
    bloom = build_bloom(shared.select("key"), SIGNATURE_BITS)
    runs = runs_of(width, passage, percent)
    windows = cut_lineage(window_table(texts, width, passage, bloom, runs=runs).join(shared, "key"))
    slack = allowance(passage - width + 1, percent)
    found = cut_lineage(candidates(windows, runs, width, passage - width + 1, needed, slack))
    links = cut_lineage(verified(found, texts, width, passage, percent))

    def spans(df: DataFrame, group: list[str], *more: Column) -> DataFrame:
        return merged_islands(df.distinct(), group, overlap=False).groupBy(*group, "island").agg(
            F.min("low").alias("first_word"), F.max("high").alias("last_word"), *more).drop("island")

    # pieces of one passage have deltas within the slack of each other
    delta = F.col("low") - F.col("rep_low")
    order = Window.partitionBy("doc_id", "rep").orderBy("delta")
    near = links.withColumn("delta", delta).withColumn(
        "new", F.when(F.col("delta") - F.lag("delta").over(order) <= slack, 0).otherwise(1)).withColumn(
        "shift", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    members = spans(near.select("doc_id", "rep", "shift", "low", "high", "rep_low"), ["doc_id", "rep", "shift"],
                    F.min(F.struct("low", "rep_low"))["rep_low"].alias("rep_first_word")).select(
        "doc_id", "first_word", "last_word", F.col("rep").alias("rep_doc_id"), "rep_first_word")
    own = spans(links.select("rep", F.col("rep_low").alias("low"), F.col("rep_high").alias("high")), ["rep"]).select(
        F.col("rep").alias("doc_id"), "first_word", "last_word", F.col("rep").alias("rep_doc_id"),
        F.col("first_word").alias("rep_first_word"))
    return members.unionByName(own)
