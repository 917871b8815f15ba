"""Secret scan: fixed patterns label credentials, and automata inferred from these find more.

The patterns (assign, access, hex) give the base spans. Their matches are labelled credentials. From a
bounded sample per kind (``sample``, the values with the smallest hashes) a probabilistic automaton is
inferred: a prefix tree of character classes whose states are merged when their outgoing frequencies
are statistically compatible (Hoeffding bound). Like automata are inferred from ordinary tokens, one from
those with letters and one from those without (addresses, dates, numbers), which are too rare among
words to shape the other. Then every token of 12 or more credential characters outside the base spans
gets its format likelihood: the log-likelihood per character under the best credential automaton less
that under the best ordinary one. Tokens above ``least_gain`` are spans of the kind ``format``.

Null and empty texts have no spans; without any match in the table only patterns apply. Rows with
equal or null ids are judged one by one.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, StringType, StructField,
                               StructType)

from shutterlake.llm.common import byte_texts, code_point_offsets, with_columns_from_text
from shutterlake.session import cut_lineage

KINDS = ("assign", "access", "hex", "format")
ORDINARY = ("ordinary", "numeric")
BASE_KINDS = 3

# --- fixed values: the base patterns ---
ASSIGN = re.compile(
    rb"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ of 16 or more
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_HEX_RUN = bytes(0x68 if c in b"0123456789abcdef" else 0x20 for c in range(256))
_TOKEN_CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_LETTER = re.compile(rb"[A-Za-z]")
_TOKENS = bytes(c if c in _TOKEN_CHARS else 0x20 for c in range(256))
LEAST_TOKEN = LEAST_ASSIGN  # the shortest value a label makes a secret

SPANS = ArrayType(StructType([
    StructField("start", IntegerType()), StructField("kind", IntegerType()),
    StructField("end", IntegerType()), StructField("score", DoubleType())]))


def base_spans(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) in bytes, by start, then kind."""
    found = []
    low = data.lower()
    if any(k in low for k in _KEYWORDS):
        for m in ASSIGN.finditer(data):
            if m.end(1) - m.start(1) >= LEAST_ASSIGN:
                found.append((m.start(), 0, m.end(), m.start(1), m.end(1)))
    if b"AKIA" in data:
        for m in ACCESS.finditer(data):
            if m.end() - m.start() >= LEAST_ACCESS:
                found.append((m.start(), 1, m.end(), m.start(), m.end()))
    if b"h" * 16 in data.translate(_HEX_RUN):
        found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(data)]
    return sorted(found)


def long_tokens(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of every token of ``LEAST_TOKEN`` or more credential characters."""
    spaced = data.translate(_TOKENS)
    at = 0
    for token in spaced.split():
        if len(token) >= LEAST_TOKEN:
            start = spaced.index(token, at)
            at = start + len(token)
            yield start, at


def outside(token: tuple[int, int], spans: list[tuple]) -> bool:
    return all(token[1] <= s[0] or token[0] >= s[2] for s in spans)


# --- grammar inference ---

_CLASSES = bytes(
    0x61 if c in b"abcdef" else 0x67 if 0x67 <= c <= 0x7A else 0x41 if c in b"ABCDEF"
    else 0x47 if 0x47 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256))
SYMBOLS = 5 + 6 + 1  # letter and digit classes, punctuation, end
SMOOTHING = 0.1


class Automaton:
    """States with counts of visits, ends and outgoing symbols."""

    def __init__(self):
        self.visits: list[int] = [0]
        self.ends: list[int] = [0]
        self.moves: list[dict[int, int]] = [{}]
        self.counts: list[dict[int, int]] = [{}]

    def add(self, symbols: bytes) -> None:
        state = 0
        for symbol in symbols:
            self.visits[state] += 1
            self.counts[state][symbol] = self.counts[state].get(symbol, 0) + 1
            target = self.moves[state].get(symbol)
            if target is None:
                target = len(self.visits)
                self.visits.append(0)
                self.ends.append(0)
                self.moves.append({})
                self.counts.append({})
                self.moves[state][symbol] = target
            state = target
        self.visits[state] += 1
        self.ends[state] += 1

    def log_likelihood(self, symbols: bytes) -> float:
        """Of the string with its end; what was never seen costs the smoothed share of its state."""
        state: int | None = 0
        total = 0.0
        for symbol in symbols:
            if state is None:
                total -= math.log(SYMBOLS)
                continue
            seen = self.counts[state].get(symbol, 0)
            total += math.log((seen + SMOOTHING) / (self.visits[state] + SMOOTHING * SYMBOLS))
            state = self.moves[state].get(symbol)
        if state is None:
            return total - math.log(SYMBOLS)
        return total + math.log((self.ends[state] + SMOOTHING) / (self.visits[state] + SMOOTHING * SYMBOLS))


def infer(strings: list[bytes], alpha: float = 0.05) -> Automaton:
    """Prefix tree of the strings' classes, then red-blue merging of compatible states."""
    machine = Automaton()
    for s in strings:
        machine.add(s.translate(_CLASSES))
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    red, blue = [0], [(0, symbol) for symbol in sorted(machine.moves[0])]
    while blue:
        parent, symbol = blue.pop(0)
        state = machine.moves[parent][symbol]
        if state in red:
            continue
        target = next((r for r in red if _compatible(machine, r, state, bound)), None)
        if target is None:
            red.append(state)
            blue += [(state, s) for s in sorted(machine.moves[state])]
            continue
        machine.moves[parent][symbol] = target
        _fold(machine, target, state)
        # folding can give red states new outgoing moves
        known = set(blue)
        blue += [(r, s) for r in red for s in sorted(machine.moves[r])
                 if machine.moves[r][s] not in red and (r, s) not in known]
    return machine


def _compatible(machine: Automaton, left: int, right: int, bound: float) -> bool:
    todo = [(left, right)]
    while todo:
        a, b = todo.pop()
        m, n = machine.visits[a], machine.visits[b]
        if not m or not n:
            continue
        allowed = bound * (1 / math.sqrt(m) + 1 / math.sqrt(n))
        if abs(machine.ends[a] / m - machine.ends[b] / n) > allowed:
            return False
        for symbol in machine.counts[a].keys() | machine.counts[b].keys():
            p, q = machine.counts[a].get(symbol, 0) / m, machine.counts[b].get(symbol, 0) / n
            if abs(p - q) > allowed:
                return False
            x, y = machine.moves[a].get(symbol), machine.moves[b].get(symbol)
            if x is not None and y is not None and x != y:
                todo.append((x, y))
    return True


def _fold(machine: Automaton, left: int, right: int) -> None:
    """Adds the tree below ``right`` to ``left``."""
    todo = [(left, right)]
    while todo:
        a, b = todo.pop()
        machine.visits[a] += machine.visits[b]
        machine.ends[a] += machine.ends[b]
        for symbol, n in machine.counts[b].items():
            machine.counts[a][symbol] = machine.counts[a].get(symbol, 0) + n
        for symbol, target in machine.moves[b].items():
            own = machine.moves[a].get(symbol)
            if own is None:
                machine.moves[a][symbol] = target
            elif own != target:
                todo.append((own, target))


class FormatScore:
    """The gain in log-likelihood per character of the best credential automaton over the best ordinary one."""

    def __init__(self, credentials: list[Automaton], ordinary: list[Automaton]):
        self.credentials, self.ordinary = credentials, ordinary

    def __call__(self, token: bytes) -> float:
        symbols = token.translate(_CLASSES)
        plain = max(a.log_likelihood(symbols) for a in self.ordinary)
        return (max(a.log_likelihood(symbols) for a in self.credentials) - plain) / (len(symbols) + 1)


def learn_formats(documents: DataFrame, text_col: str = "text", sample: int = 400) -> FormatScore | None:
    """Automata from at most ``sample`` different values per kind, or None without any credential."""
    at = documents.columns.index(text_col)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {kind: Smallest(sample) for kind in (*KINDS[:BASE_KINDS], *ORDINARY)}
        for batch in batches:
            for texts in byte_texts(batch.column(at)):
                for data in texts:
                    if not data:
                        continue
                    spans = base_spans(data)
                    for _, kind, _, start, end in spans:
                        kept[KINDS[kind]].offer(data[start:end])
                    for start, end in long_tokens(data):
                        if outside((start, end), spans):
                            value = data[start:end]
                            kept[ORDINARY[_LETTER.search(value) is None]].offer(value)
        rows = [(kind, h, value.decode("ascii")) for kind, k in kept.items() for h, value in k.values()]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        types = (pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                         names=["kind", "h", "value"])

    gathered = cut_lineage(documents.mapInArrow(gather, "kind string, h long, value string"))
    machines = {}
    for kind in (*KINDS[:BASE_KINDS], *ORDINARY):
        values = (gathered.filter(F.col("kind") == kind).select("h", "value").distinct()
                  .orderBy("h", "value").limit(sample).collect())
        if values:
            machines[kind] = infer([r["value"].encode() for r in values])
    ordinary = [machines.pop(kind) for kind in ORDINARY if kind in machines] or [Automaton()]
    return FormatScore(list(machines.values()), ordinary) if machines else None


class Smallest:
    """The values with the smallest hashes among those offered, at most ``size`` different ones."""

    def __init__(self, size: int):
        self.size, self.heap, self.held = size, [], set()

    def offer(self, value: bytes) -> None:
        h = xxhash.xxh64_intdigest(value) >> 1
        if len(self.heap) == self.size and h >= -self.heap[0][0] or value in self.held:
            return
        heapq.heappush(self.heap, (-h, value))
        self.held.add(value)
        if len(self.heap) > self.size:
            self.held.discard(heapq.heappop(self.heap)[1])

    def values(self) -> list[tuple[int, bytes]]:
        return [(-h, value) for h, value in self.heap]


# --- the scan ---

def all_spans(data: bytes, score: FormatScore | None, least_gain: float) -> list[tuple]:
    """(start, kind, end, score) in bytes, by start, then kind; base spans score 1."""
    base = base_spans(data)
    found = [(s, k, e, 1.0) for s, k, e, _, _ in base]
    if score:
        for token in long_tokens(data):
            value = data[token[0]:token[1]]
            if outside(token, base):
                gain = score(value)
                if gain >= least_gain:
                    found.append((token[0], len(KINDS) - 1, token[1], gain))
    return sorted(found)


def find_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 formats: FormatScore | None = None, least_gain: float = 1.0) -> DataFrame:
    """(doc_id, spans): start, kind (place in KINDS), end in code points, and score."""
    shared = documents.sparkSession.sparkContext.broadcast(formats)

    def prepare():
        score = shared.value

        def spans(data: bytes | None):
            found = all_spans(data, score, least_gain) if data else []
            if not found:
                return ([],)
            cuts = sorted({s for s, *_ in found} | {e for _, _, e, _ in found})
            place = dict(zip(cuts, code_point_offsets(data, cuts)))
            return ([(place[s], k, place[e], g) for s, k, e, g in found],)

        return spans

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_columns_from_text(rows, "text", [StructField("spans", SPANS)], prepare).drop("text")


def digest_columns(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans) of the rows of ``find_secrets``."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(i):
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")

    return found.select(
        "doc_id", *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(written(F.filter("spans", lambda s: s["kind"] < BASE_KINDS)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def redact_secrets(documents: DataFrame, text_col: str = "text", formats: FormatScore | None = None,
                   least_gain: float = 1.0, mark: str = "[secret]") -> DataFrame:
    """``documents`` with every span in the text replaced by ``mark``; overlapping spans give one mark.

    The column order and all other columns stay. The number of replaced characters is not kept.
    """
    shared = documents.sparkSession.sparkContext.broadcast(formats)
    marked = mark.encode()

    def prepare():
        score = shared.value

        def clean(data: bytes | None):
            if not data:
                return (None if data is None else "",)
            out, at = [], 0
            for start, _, end, _ in all_spans(data, score, least_gain):
                if start >= at:
                    out += [data[at:start], marked]
                at = max(at, end)
            return (b"".join([*out, data[at:]]).decode("utf-8", "replace"),)

        return clean

    fresh = f"{text_col}+"
    while fresh in documents.columns:
        fresh += "+"
    cleaned = with_columns_from_text(documents, text_col, [StructField(fresh, StringType())], prepare)
    return cleaned.withColumn(text_col, F.col(f"`{fresh}`")).drop(fresh)
