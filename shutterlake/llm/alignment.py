"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and how often which ids do.

A text is encoded twice, as space+text by a byte-level BPE (side A) and as text by a piece BPE that adds
the space itself (side B). Byte offsets at which a token of either side ends cut the tokens into groups; the two
tokens that end there are a link. The count of an id pair is the number of links that hold it corpus-wide.

Counting is external: a task collects the links of its documents as (pair, document) records, and when enough
are held it partitions them by radix of the B id, sorts them side-major (B id, then A id, then document)
and writes every part as one zstd run. Runs of one radix are merged through a k-way heap that adds up each
pair, as many at a time as ``FAN`` says and in as many levels as that takes; in side-major order all pairs of a B
id follow each other, so the last level knows each B id's highest count as soon as it leaves the id. The
records of each run then meet the counts of their radix, some runs at a time, and what each link
contributes streams back to its document as a sum per run.

A frequent id is no hot spot: a run holds a bounded number of records, merging reads only one entry per run
and pair, and a merged run cannot hold more pairs than the two vocabularies make.

Defined results: texts that are null, empty, or whose tokens' bytes are not those of space+text (on either
side) have no tokens: all numbers are 0 and groups_sha256 is ''. Repeated rows are texts of their own and
all count. A null id stays. Other columns are not looked at. The tokens of one text are held at once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import arrow_schema, byte_texts
from shutterlake.session import cut_lineage

FOLDER = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"      # side A
PIECE_BPE = "piece_bpe_32k.model"   # side B

#: how byte-level BPE cuts a text before merging (fixed value)
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: what is left to the slower library: characters whose class may differ between editions of Unicode,
#: and long runs without a space
UNCOMMON = re.compile("[^\x00-\u024f]|[^ \n]{1000}")
RADIX = 16              # parts of the pairs, by B id
RUN_LINKS = 1 << 21     # records a task holds before it writes its runs
RUN_DOCS = 1 << 16      # documents of a run: a place takes 16 bits
FAN = 64                # runs merged at a time
RUNS_AT_ONCE = 8        # runs whose records meet the counts in one task
MOST_IDS = 1 << 23      # of a vocabulary, so that (B id, A id, place) fits 63 bits

HEAD = "run long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RUN = "radix int, pairs binary, totals binary, spans binary, places binary, times binary"
MERGED = "radix int, run long, pairs binary, totals binary, best binary"
GIVEN = "run long, place int, n_best long, count_sum long"


# --- the two tokenizers -----------------------------------------------------------------------

def byte_symbols() -> dict[str, int]:
    """The byte each character of a byte-level entry stands for.

    Printable Latin-1 characters stand for themselves, the others for the bytes left over, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both encoders, and the bytes of every id."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(byte_path)
        self._a.encode_special_tokens = True  # their strings inside a text are text
        self._ranked = _by_rank(byte_path)
        self._b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        symbols = byte_symbols()
        entries = self._a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (1 + max(entries.values()))
        for entry, number in entries.items():
            plain = all(c in symbols for c in entry)
            self.bytes_a[number] = bytes(symbols[c] for c in entry) if plain else entry.encode()
        self.bytes_b = [self._piece_bytes(i) for i in range(self._b.get_piece_size())]
        if max(len(self.bytes_a), len(self.bytes_b)) > MOST_IDS:
            raise ValueError(f"a vocabulary has more than {MOST_IDS} ids")
        self.lengths_a = np.array([len(b) for b in self.bytes_a], dtype=np.int64)
        self.lengths_b = np.array([len(b) for b in self.bytes_b], dtype=np.int64)

    def _piece_bytes(self, number: int) -> bytes:
        if self._b.is_control(number) or self._b.is_unknown(number):
            return b""
        piece = self._b.id_to_piece(number)
        if self._b.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def _encode_a(self, text: str, whole: bytes) -> np.ndarray | None:
        """The two ways give the same ids; the first is several times as fast and always spells the text."""
        if self._ranked and not UNCOMMON.search(text):
            return self._ranked.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        ids = self._a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        if b"".join(map(self.bytes_a.__getitem__, ids)) != whole:
            return None
        return np.array(ids, dtype=np.int64)

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or None where a side's bytes are not space+text."""
        text = data.decode("utf-8")
        whole = b" " + data
        a = self._encode_a(" " + text, whole)
        if a is None:
            return None
        b = self._b.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        return a, np.array(b, dtype=np.int64)


def _by_rank(byte_path: str):
    """The same vocabulary as an encoder by rank; None where ids are not in the order of the merges."""
    import tiktoken

    with open(byte_path, encoding="utf-8") as file:
        read = json.load(file)
    symbols = byte_symbols()
    vocabulary, merges = read["model"]["vocab"], read["model"]["merges"]
    special = {token["content"] for token in read["added_tokens"]}
    ranks = {bytes(symbols[c] for c in entry): number for entry, number in vocabulary.items() if entry not in special}
    pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in merges]
    ordered = all(vocabulary["".join(pair)] == 256 + at for at, pair in enumerate(pairs))
    if not ordered or len(ranks) != 256 + len(merges):
        return None
    return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    return Tokenizers(byte_path, piece_path)


# --- one document -----------------------------------------------------------------------------

@dataclass
class Aligned:
    a: np.ndarray        # ids
    b: np.ndarray
    last_a: np.ndarray   # whether a group ends with the token
    last_b: np.ndarray

    @property
    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A and B ids of the tokens that end together, in order."""
        return self.a[self.last_a], self.b[self.last_b]


class Aligner:
    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.size_a, self.size_b = len(tokenizers.bytes_a), len(tokenizers.bytes_b)
        # decimal ids with what follows them inside and at the end of a group, for both sides
        self._written = [f"{i}{mark}".encode() for size, marks in ((self.size_a, ",|"), (self.size_b, ",;"))
                         for mark in marks for i in range(size)]

    def align(self, data: bytes | None) -> Aligned | None:
        encoded = self.tokenizers.encode(data) if data else None
        if encoded is None:
            return None
        a, b = encoded
        ends_a = np.cumsum(self.tokenizers.lengths_a[a])
        ends_b = np.cumsum(self.tokenizers.lengths_b[b])
        # tokens have at least one byte, so that an offset ends one token of a side at most
        in_a = np.zeros(len(data) + 2, dtype=bool)
        in_b = np.zeros(len(data) + 2, dtype=bool)
        in_a[ends_a] = True
        in_b[ends_b] = True
        return Aligned(a, b, in_b[ends_a], in_a[ends_b])

    def groups(self, found: Aligned) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of all groups."""
        codes = np.empty(len(found.a) + len(found.b), dtype=np.int64)
        first_a = np.concatenate([[0], np.flatnonzero(found.last_a) + 1])
        first_b = np.concatenate([[0], np.flatnonzero(found.last_b) + 1])
        group_a = np.cumsum(found.last_a) - found.last_a
        group_b = np.cumsum(found.last_b) - found.last_b
        codes[np.arange(len(found.a)) + first_b[group_a]] = found.a + self.size_a * found.last_a
        codes[np.arange(len(found.b)) + first_a[group_b + 1]] = (
            2 * self.size_a + found.b + self.size_b * found.last_b)
        return b"".join(map(self._written.__getitem__, codes.tolist()))[:-1]


def token_groups(docs: DataFrame, folder: str = FOLDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups): the aligned groups of every text, null where it has no tokens."""
    paths = f"{folder}/{BYTE_BPE}", f"{folder}/{PIECE_BPE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(_tokenizers(*paths))
        for batch in batches:
            found = [aligner.align(d) for texts in byte_texts(batch.column(1)) for d in texts]
            groups = [f and aligner.groups(f).decode() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(groups, pa.string())],
                                             names=["doc_id", "groups"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(
        run, "doc_id long, groups string")


# --- runs -------------------------------------------------------------------------------------

def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 3)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=0))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.int64))


class PairKeys:
    """Pairs of ids as numbers in side-major order within a radix; every radix is a range of them."""

    def __init__(self, size_a: int, size_b: int, radix: int):
        self.size_a, self.radix = size_a, radix
        self.width = -(-size_b // radix)

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (b % self.radix * self.width + b // self.radix) * self.size_a + a

    def ids(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = keys // self.size_a
        return keys % self.size_a, b % self.width * self.radix + b // self.width

    def bounds(self, keys: np.ndarray) -> np.ndarray:
        """Where each radix starts in sorted keys, and their end."""
        return np.searchsorted(keys, np.arange(self.radix + 1) * self.width * self.size_a)


def run_rows(run: int, links: list[np.ndarray], keys: PairKeys) -> Iterator[dict]:
    """The runs of some documents, given their links' keys: one row per radix that occurs."""
    places = np.repeat(np.arange(len(links)), [len(part) for part in links])
    records, times = np.unique(np.concatenate([*links, np.zeros(0, np.int64)]) * RUN_DOCS + places,
                               return_counts=True)
    pair_of, places = records // RUN_DOCS, (records % RUN_DOCS).astype(np.uint16)
    bounds = keys.bounds(pair_of)
    for radix, (start, stop) in enumerate(zip(bounds, bounds[1:])):
        if start < stop:
            pairs, at, spans = np.unique(pair_of[start:stop], return_index=True, return_counts=True)
            part = times[start:stop]
            yield {"run": run, "radix": radix, "pairs": _pack_sorted(pairs),
                   "totals": _pack(np.add.reduceat(part, at)), "spans": _pack(spans.astype(np.int32)),
                   "places": _pack(places[start:stop]), "times": _pack(part.astype(np.int32))}


def aligned_runs(docs: DataFrame, folder: str, id_col: str, text_col: str, radix: int, run_links: int) -> DataFrame:
    """The written table of document rows (radix null) and of their runs."""
    paths = f"{folder}/{BYTE_BPE}", f"{folder}/{PIECE_BPE}"
    ddl = f"{HEAD}, {RUN}"
    kind = arrow_schema(ddl)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(_tokenizers(*paths))
        keys = PairKeys(aligner.size_a, aligner.size_b, radix)
        run = TaskContext.get().partitionId() << 32
        heads: list[dict] = []
        links: list[np.ndarray] = []
        held = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            datas = (data for texts in byte_texts(batch.column(1)) for data in texts)
            for doc_id, data in zip(ids, datas):
                head = {"run": run, "place": len(heads), "doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0,
                        "n_links": 0, "groups_sha256": ""}
                found = aligner.align(data)
                own = np.zeros(0, dtype=np.int64)
                if found is not None:
                    own = keys.keys(*found.links)
                    head |= {"n_a": len(found.a), "n_b": len(found.b), "n_groups": len(own), "n_links": len(own),
                             "groups_sha256": hashlib.sha256(aligner.groups(found)).hexdigest()}
                heads.append(head)
                links.append(own)
                held += len(own)
                if held >= run_links or len(heads) == RUN_DOCS:
                    yield pa.RecordBatch.from_pylist([*heads, *run_rows(run, links, keys)], schema=kind)
                    run, heads, links, held = run + 1, [], [], 0
        if heads:
            yield pa.RecordBatch.from_pylist([*heads, *run_rows(run, links, keys)], schema=kind)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col)
    return cut_lineage(rows.mapInArrow(build, ddl))


# --- merging and counting ---------------------------------------------------------------------

def heap_merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """Sorted pairs and their totals over sorted runs of (pairs, totals)."""
    pairs: list[int] = []
    totals: list[int] = []
    last = None
    for pair, total in heapq.merge(*(zip(p.tolist(), t.tolist()) for p, t in runs)):
        if pair == last:
            totals[-1] += total
        else:
            pairs.append(pair)
            totals.append(total)
            last = pair
    return pairs, totals


def highest_of_side(pairs: list[int], totals: list[int], size_a: int) -> np.ndarray:
    """Whether a pair's total is the highest of its B id; a B id's pairs follow each other."""
    best = np.zeros(len(pairs), dtype=bool)
    start = 0
    while start < len(pairs):
        stop, limit = start, (pairs[start] // size_a + 1) * size_a
        highest = 0
        while stop < len(pairs) and pairs[stop] < limit:
            highest = max(highest, totals[stop])
            stop += 1
        for at in range(start, stop):
            best[at] = totals[at] == highest
        start = stop
    return best


def merge_runs(runs: DataFrame, size_a: int, fan: int = FAN) -> DataFrame:
    """One row per radix: all pairs with their counts, and which are the highest of their B id."""
    kind = arrow_schema(MERGED)

    def merge(group: pa.Table) -> pa.Table:
        parts = [(_unpack_sorted(p), _unpack(t, np.int64)) for p, t in
                 zip(group["pairs"].to_pylist(), group["totals"].to_pylist())]
        pairs, totals = heap_merge(parts)
        row = {"radix": group["radix"][0].as_py(), "run": group["bucket"][0].as_py(),
               "pairs": _pack_sorted(np.array(pairs, dtype=np.int64)), "totals": _pack(np.array(totals, np.int64)),
               "best": _pack(highest_of_side(pairs, totals, size_a))}
        return pa.Table.from_pylist([row], schema=kind)

    count = runs.select("run").distinct().count()
    runs = runs.select("radix", "run", "pairs", "totals")
    while True:
        buckets = max(1, -(-count // fan))
        dealt = runs.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(buckets)))
        merged = cut_lineage(dealt.groupBy("radix", "bucket").applyInArrow(merge, MERGED))
        if buckets == 1:
            return merged
        runs, count = merged.select("radix", "run", "pairs", "totals"), buckets


def stream_back(runs: DataFrame, counts: DataFrame, runs_at_once: int = RUNS_AT_ONCE) -> DataFrame:
    """(run, place, n_best, count_sum): what the pairs of one radix contribute to each document of a run."""
    buckets = max(1, -(-runs.select("run").distinct().count() // runs_at_once))
    records = runs.select("radix", F.pmod(F.xxhash64("run"), F.lit(buckets)).alias("bucket"), "run", "pairs", "spans",
                          "places", "times")
    known = counts.select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"),
                          F.col("pairs").alias("known"), "totals", "best")
    kind = arrow_schema(GIVEN)

    def give(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            known, totals, best = (right[n][0].as_py() for n in ("known", "totals", "best"))
            known, totals, best = _unpack_sorted(known), _unpack(totals, np.int64), _unpack(best, np.bool_)
            for at in range(len(left)):
                run, pairs, spans, places, times = (
                    left[n][at].as_py() for n in ("run", "pairs", "spans", "places", "times"))
                found = np.searchsorted(known, _unpack_sorted(pairs))
                of_record = np.repeat(found, _unpack(spans, np.int32))
                places, times = _unpack(places, np.uint16).astype(np.int64), _unpack(times, np.int32).astype(np.int64)
                docs, which = np.unique(places, return_inverse=True)
                n_best, count_sum = np.zeros((2, len(docs)), dtype=np.int64)
                np.add.at(n_best, which, times * best[of_record])
                np.add.at(count_sum, which, times * totals[of_record])
                out.append(pa.table([pa.repeat(run, len(docs)), pa.array(docs.astype(np.int32)), pa.array(n_best),
                                     pa.array(count_sum)], schema=kind))
        return pa.concat_tables(out) if out else kind.empty_table()

    keys = ["radix", "bucket"]
    return records.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(give, GIVEN)


def pair_counts(counts: DataFrame, size_a: int, size_b: int, radix: int = RADIX) -> DataFrame:
    """(a, b, links, best) of every linked id pair, from the rows of ``merge_runs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = PairKeys(size_a, size_b, radix)
        for batch in batches:
            for row in batch.to_pylist():
                a, b = keys.ids(_unpack_sorted(row["pairs"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.array(_unpack(row["totals"], np.int64)),
                     pa.array(_unpack(row["best"], np.bool_))], names=["a", "b", "links", "best"])

    return counts.mapInArrow(run, "a long, b long, links long, best boolean")


def align_tokenizers(docs: DataFrame, folder: str = FOLDER, id_col: str = "doc_id", text_col: str = "text",
                     radix: int = RADIX, run_links: int = RUN_LINKS, fan: int = FAN,
                     runs_at_once: int = RUNS_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): a row per text, and a row per linked id pair.

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest count of its B id),
    count_sum (of the pairs' counts over the links), groups_sha256. pairs: a, b, links, best.
    """
    units = aligned_runs(docs, folder, id_col, text_col, radix, run_links)
    tokenizers = _tokenizers(f"{folder}/{BYTE_BPE}", f"{folder}/{PIECE_BPE}")
    sizes = len(tokenizers.bytes_a), len(tokenizers.bytes_b)
    runs = units.filter("radix IS NOT NULL")
    counts = merge_runs(runs, sizes[0], fan)
    given = stream_back(runs, counts, runs_at_once).groupBy("run", "place").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    heads = units.filter("radix IS NULL").select(*[part.split()[0] for part in HEAD.split(", ")])
    documents = heads.join(given, ["run", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
    return documents, pair_counts(counts, *sizes, radix)
