"""Benchmark decontamination: Wu-Manber search for the benchmark's word windows.

Each benchmark item gives its windows of ``width`` consecutive words (an item of fewer words is one
window). The windows are the patterns of a Wu-Manber search over words: a shift table over blocks of
two words says how far the search may jump, a zero shift leads to the bucket of windows that end in
the block, and direct comparison confirms. Documents stay where they are: no text is shuffled.

The windows go to the tasks in slices of at most ``slice_windows``, so that a task holds a bounded
table however large the benchmark grows; every slice scans the documents once.

Null and empty texts have no words and are clean. Rows with equal or null ids are judged one by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from shutterlake.llm.common import with_columns_from_text, word_table
from shutterlake.session import cut_lineage

#: digits, a-z (after lower-casing) and every byte of a non-ASCII character
WORDS = word_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
BLOCK = 2


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(WORDS).split() if data else []


class WindowSearch:
    """Finds every occurrence of the given windows in a list of words."""

    def __init__(self, windows: dict[tuple[bytes, ...], list]):
        by_length = defaultdict(list)
        for window in windows:
            by_length[len(window)].append(window)
        self.single = {w[0]: windows[w] for w in by_length.pop(1, [])}
        self.tables = []
        for length, group in by_length.items():
            shift: dict[tuple, int] = {}
            bucket = defaultdict(list)
            for window in group:
                for end in range(BLOCK, length + 1):
                    block = window[end - BLOCK:end]
                    shift[block] = min(shift.get(block, length), length - end)
                bucket[window[-BLOCK:]].append((window, windows[window]))
            self.tables.append((length, shift, dict(bucket)))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int, list]]:
        """(first word, width, what the window carries)."""
        if self.single:
            for i, word in enumerate(words):
                if word in self.single:
                    yield i, 1, self.single[word]
        n = len(words)
        for length, shift, bucket in self.tables:
            far, last = length - BLOCK + 1, length - 1
            get = shift.get
            while last < n:
                block = (words[last - 1], words[last])
                jump = get(block, far)
                if jump:
                    last += jump
                    continue
                start = last - length + 1
                found = tuple(words[start:last + 1])
                for window, carried in bucket[block]:
                    if window == found:
                        yield start, length, carried
                last += 1


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """(item, window): the item id as text, the words of one window joined by spaces."""
    fields = [StructField("window", ArrayType(StringType()))]

    def prepare():
        def windows(data: bytes | None):
            words = words_of(data)
            size = min(width, len(words))
            starts = range(len(words) - size + 1) if words else []
            return ([b" ".join(words[i:i + size]).decode("utf-8", "replace") for i in starts],)

        return windows

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    made = with_columns_from_text(items, "text", fields, prepare)
    return made.select("item", F.explode("window").alias("window")).distinct()


def mark_contamination(documents: DataFrame, benchmark: DataFrame, text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", width: int = 10,
                       slice_windows: int = 200_000, prefix: str = "") -> DataFrame:
    """Every row and column of ``documents``, with n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the words inside any occurrence of a window; n_items the items with an occurring
    window, and items_sha256 hashes their ids, sorted as strings and joined by commas. Items without an id
    are searched too: their words are hit, they count as one item and add nothing to the hash. ``prefix``
    goes before the new names where ``documents`` has columns of these names.
    """
    windows = cut_lineage(benchmark_windows(benchmark, item_col, item_text_col, width))
    slices = max(1, -(-windows.count() // slice_windows))
    hits, items = f"{prefix}_hits", f"{prefix}_items"
    empty = F.array().cast("array<int>")
    marked = documents.withColumns({hits: empty, items: F.array().cast("array<string>"),
                                    f"{prefix}n_words": F.lit(0).cast("long")})
    for number in range(slices):
        part = windows.filter(F.pmod(F.xxhash64("window"), F.lit(slices)) == number)
        carried = defaultdict(list)
        for row in part.collect():  # at most about slice_windows rows
            carried[tuple(row["window"].encode().split(b" "))].append(row["item"])
        marked = _scan(marked, text_col, dict(carried), hits, items, f"{prefix}n_words")
        if number + 1 < slices:
            marked = cut_lineage(marked)
    return _summarise(marked, hits, items, prefix)


def _scan(df: DataFrame, text_col: str, windows: dict, hits: str, items: str, n_words: str) -> DataFrame:
    """Adds one slice's occurrences to the columns ``hits`` (start, width, ...) and ``items``."""
    fresh = [StructField(f"{hits}+", ArrayType(IntegerType())),
             StructField(f"{items}+", ArrayType(StringType())), StructField(f"{n_words}+", LongType())]
    shared = df.sparkSession.sparkContext.broadcast(windows)

    def prepare():
        search = WindowSearch(shared.value)

        def scan(data: bytes | None):
            places: list[int] = []
            found: set[str | None] = set()
            words = words_of(data)
            for start, size, carried in search.occurrences(words):
                places += (start, size)
                found.update(carried)
            return places, sorted(found, key=lambda item: (item is None, item or "")), len(words)

        return scan

    out = with_columns_from_text(df, text_col, fresh, prepare)
    return out.withColumns({
        hits: F.concat(hits, F.col(f"`{hits}+`")), items: F.array_union(items, F.col(f"`{items}+`")),
        n_words: F.col(f"`{n_words}+`"),
    }).drop(f"{hits}+", f"{items}+", f"{n_words}+")


def _summarise(df: DataFrame, hits: str, items: str, prefix: str) -> DataFrame:
    # occurrences are (start, width) pairs; their union is counted from the sorted starts
    pairs = F.array_sort(F.transform(
        F.sequence(F.lit(0), (F.size(hits) / 2).cast("int") - 1),
        lambda i: F.struct(F.element_at(hits, 2 * i + 1).alias("s"),
                           (F.element_at(hits, 2 * i + 1) + F.element_at(hits, 2 * i + 2)).alias("e")),
    ))
    covered = F.aggregate(
        pairs, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, p: F.struct(
            (acc["n"] + F.greatest(F.lit(0), p["e"] - F.greatest(acc["to"], p["s"]))).alias("n"),
            F.greatest(acc["to"], p["e"]).alias("to")),
        lambda acc: acc["n"].cast("long"),
    )
    n_hit = F.when(F.size(hits) > 0, covered).otherwise(F.lit(0).cast("long"))
    return df.withColumns({
        f"{prefix}n_hit": n_hit,
        f"{prefix}n_items": F.size(items).cast("long"),
        f"{prefix}items_sha256": F.sha2(F.array_join(F.array_sort(items), ","), 256),
        f"{prefix}contaminated": n_hit > 0,
    }).drop(hits, items)
