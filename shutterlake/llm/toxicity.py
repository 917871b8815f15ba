"""Toxicity: class-conditional Kneser-Ney models of toxic and ordinary texts.

Two whole class models (``likelihood``) give every text its log-likelihoods as a toxic and as an ordinary text, all
words and pairs of the labelled texts included. A logistic function weighs both, per word, beside the evidence of
single expressions. It is fitted on a bounded sample of training texts (``calibration_rows``); the likelihoods' weights on
the first fourth of the training texts at most, which the class models do not count, as a model finds the texts it
has counted too likely. With less than
ten texts of the rarer class for each of them these weights stay 0.

For the evidence Spark counts words, word pairs and word beginnings, once per document, for each
class. A pair backs off to its last word, and a word to its beginnings, the longest with evidence
first, so that rare forms share the counts of what they have in common. Both class models discount
their counts and end in counts shared by the classes, with one shared back-off weight; an expression
without evidence is as likely under either model and adds nothing. Evidence is a G test of the class
counts and an e-fold difference, and the expression must follow several different words of toxic texts
(its continuation count), so that many copies of one text are not evidence for each of its words.
The logistic function gets its sum, in total and per word.

The labelled texts are found with a Bloom filter of fixed size before the exact join, so only they are
shuffled; ordinary texts are only counted for expressions that toxic texts hold. Retained expressions
go to the tasks in slices of at most ``slice_entries``; each further slice scans the texts once more.
Score inputs are the text alone.

Null and empty texts have no words and get the score of a text without evidence. Rows with equal or
null ids are scored one by one; labels given several times for an id count as toxic if one is.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from shutterlake.llm.bloom import Bloom, build_bloom
from shutterlake.llm.common import byte_texts, tidy, with_columns_from_text
from shutterlake.llm.likelihood import ClassModels, log_likelihoods, pair_keys, train_classes, words_of
from shutterlake.session import cut_lineage

DISCOUNT = 0.75
LEAST_CONTEXTS = 5
LEAST_G = 30.0  # one in ten million by chance
LEAST_GAIN = 1.0
LEAST_PER_WEIGHT = 10  # texts of the rarer class for each fitted weight of the likelihoods
BEGINNINGS = range(8, 2, -1)  # lengths, the longest first
SHORTEST = min(BEGINNINGS)
FLUSH_AT = 100_000  # counters a task holds before it passes them on
ALL_WORDS = ""  # counts the different words of all texts


def expressions_of(words: list[str]) -> set[str]:
    """The different words, "first second" pairs and "beginning*" forms."""
    single = set(words)
    found = single | {f"{w[:n]}*" for w in single for n in BEGINNINGS if n < len(w)}
    found.update(map(" ".join, zip(words, words[1:])))
    return found


def held_out(doc_id: Column) -> Column:
    """The fifth of the ids that no label may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class ToxicityModel:
    """``entries``: (expression, gain), an expression being a word or two words joined by a space.

    ``classes``: both class models, or None if the counted texts lack a class.
    """

    entries: DataFrame
    slices: int
    weights: tuple[float, ...]
    classes: ClassModels | None = None


# --- training ---

def labelled_texts(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                   label_col: str = "toxic") -> DataFrame:
    """(id, text, toxic) of the training rows; ``labels`` has the columns ``id_col`` and ``label_col``."""
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")))
    known = cut_lineage(known)
    bloom = documents.sparkSession.sparkContext.broadcast(build_bloom(known.select(F.xxhash64("id"))))

    def may_be_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = bloom.value.holds(np.asarray(batch.column(2)).astype(np.int64).view(np.uint64))
            yield batch.filter(pa.array(keep))

    texts = documents.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    # the same plan at every size: labels grow with the texts, so they are never broadcast
    return texts.mapInArrow(tidy(may_be_labelled), texts.schema).drop("h").join(known.hint("merge"), "id")


def _hashes(expressions: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, expressions), dtype=np.uint64, count=len(expressions))


def count_expressions(texts: DataFrame, only: Bloom | None = None) -> DataFrame:
    """(expression, n): the number of texts that hold it. With ``only``, of those the filter holds.

    The filter is one of ``candidate_hashes``. The expression ``ALL_WORDS`` counts the different words of each
    text. Counts are added up per task.
    """
    shared = texts.sparkSession.sparkContext.broadcast(only)
    at = texts.columns.index("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = KnownForms(shared.value) if shared.value is not None else None
        counter: Counter = Counter()
        for batch in batches:
            for block in byte_texts(batch.column(at)):
                split = [words_of(data) for data in block]
                for words, found in zip(split, map(expressions_of, split) if forms is None else forms.of(split)):
                    counter.update(found)
                    counter[ALL_WORDS] += len(set(words))
                    if len(counter) > FLUSH_AT:
                        yield _counts_batch(counter)
                        counter = Counter()
        yield _counts_batch(counter)

    parts = texts.mapInArrow(tidy(count), "expression string, n long")
    return parts.groupBy("expression").agg(F.sum("n").alias("n"))


class KnownForms:
    """The expressions of texts that a filter of ``candidate_hashes`` holds.

    A form in the filter has all its beginnings there, as these have no fewer contexts; so longer ones are only
    looked up where the shorter ones are held.
    """

    def __init__(self, bloom: Bloom):
        self.bloom = bloom
        self.held: dict[str, list[str]] = {}  # of a word: itself and its beginnings

    def of(self, texts: list[list[str]]) -> Iterator[set[str]]:
        if len(self.held) > 2 * FLUSH_AT:
            self.held.clear()
        flat = [word for words in texts for word in words]
        single = set(flat)
        self._learn([w for w in single if w not in self.held])
        hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=False)
        ends = np.cumsum([len(words) for words in texts])
        known = self.bloom.holds(pair_keys(hashes[:-1], hashes[1:]))
        known[ends[(ends > 0) & (ends < len(flat))] - 1] = False
        pairs = np.flatnonzero(known)
        cuts = np.searchsorted(pairs, ends).tolist()
        pairs, start = pairs.tolist(), 0
        for words, cut in zip(texts, cuts):
            found = {form for word in set(words) for form in self.held[word]}
            found.update([f"{flat[i]} {flat[i + 1]}" for i in pairs[start:cut]])
            start = cut
            yield found

    def _learn(self, words: list[str]) -> None:
        for word in words:
            self.held[word] = []
        for n in reversed(BEGINNINGS):
            self._keep([w for w in words if len(w) <= n], None)
            words = self._keep([w for w in words if len(w) > n], n)
        self._keep(words, None)

    def _keep(self, words: list[str], n: int | None) -> list[str]:
        """Those of ``words`` whose beginning of ``n`` letters, or which themselves, the filter holds."""
        forms = words if n is None else [f"{w[:n]}*" for w in words]
        kept = []
        for place in np.flatnonzero(self.bloom.holds(_hashes(forms))).tolist():
            self.held[words[place]].append(forms[place])
            kept.append(words[place])
        return kept


def candidate_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column(0).to_pylist()
        pairs = [e.split(" ") for e in found if " " in e]
        first, last = (pd.util.hash_array(np.array([p[i] for p in pairs], dtype=object), categorize=False) for i in (0, 1))
        hashes = np.concatenate([_hashes([e for e in found if " " not in e]), pair_keys(first, last)])
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["h"])


def _counts_batch(counter: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())],
        names=["expression", "n"])


def _g_test(toxic: Column, ordinary: Column, all_toxic: float, all_ordinary: float) -> Column:
    whole = all_toxic + all_ordinary

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    both = toxic + ordinary
    return 2 * (part(toxic, both * all_toxic / whole) + part(ordinary, both * all_ordinary / whole))


def continuations(toxic: DataFrame) -> DataFrame:
    """(expression, contexts): for words and beginnings, the different pairs of toxic texts they end."""
    word = F.substring_index("expression", " ", -1)
    ended = toxic.filter(F.instr("expression", " ") > 0).groupBy(word.alias("word")).agg(
        F.count("*").alias("contexts"))
    forms = F.array("word", *[F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*")))
                              for n in BEGINNINGS])
    return (ended.select(F.explode(forms).alias("expression"), "contexts").filter("expression IS NOT NULL")
            .groupBy("expression").agg(F.sum("contexts").alias("contexts")))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", slice_entries: int = 200_000, calibration_rows: int = 20_000,
          head_entries: int = 1_000_000) -> ToxicityModel:
    texts = cut_lineage(labelled_texts(documents, labels, id_col, text_col, label_col))
    classes = texts.groupBy("toxic").count().collect()
    if len(classes) < 2:
        none = documents.sparkSession.createDataFrame([], "expression string, gain double")
        return ToxicityModel(none, 1, _constant(0.0))
    toxic = cut_lineage(count_expressions(texts.filter("toxic = 1")))
    is_pair = F.instr("expression", " ") > 0
    single = toxic.join(continuations(toxic), "expression").filter(F.col("contexts") >= LEAST_CONTEXTS)
    pair = toxic.filter(is_pair & (F.col("n") >= 2 * LEAST_CONTEXTS))
    candidates = cut_lineage(single.select("expression", "n").unionByName(pair.select("expression", "n")))

    hashes = candidates.select("expression").mapInArrow(candidate_hashes, "h long")
    ordinary = cut_lineage(count_expressions(texts.filter("toxic = 0"), build_bloom(hashes)))
    total = F.col("expression") == ALL_WORDS
    n_toxic = float(toxic.filter(total).agg(F.sum("n")).first()[0] or 1)
    n_ordinary = float(ordinary.filter(total).agg(F.sum("n")).first()[0] or 1)
    plain = ~is_pair & ~F.col("expression").endswith("*") & ~total
    weight = DISCOUNT * max(toxic.filter(plain).count(), 1) / n_toxic

    counted = (candidates.withColumnRenamed("n", "toxic")
               .join(ordinary.withColumnRenamed("n", "ordinary"), "expression", "left").fillna(0, ["ordinary"])
               .withColumn("g", _g_test(F.col("toxic"), F.col("ordinary"), n_toxic, n_ordinary)))
    shared = weight * (F.col("toxic") + F.col("ordinary")) / (n_toxic + n_ordinary)
    words = cut_lineage(counted.filter(~is_pair).withColumns({
        "p_toxic": F.greatest(F.col("toxic") - DISCOUNT, F.lit(0.0)) / n_toxic + shared,
        "p_ordinary": F.greatest(F.col("ordinary") - DISCOUNT, F.lit(0.0)) / n_ordinary + shared,
    }))
    first = words.select(F.col("expression").alias("first"), F.col("toxic").alias("first_toxic"),
                         F.col("ordinary").alias("first_ordinary"))
    last = words.select(F.col("expression").alias("last"), "p_toxic", "p_ordinary")
    pairs = (counted.filter(is_pair)
             .withColumns({"first": F.substring_index("expression", " ", 1),
                           "last": F.substring_index("expression", " ", -1)})
             .join(first, "first").join(last, "last"))

    def conditional(name):
        seen = F.greatest(F.col(name) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"first_{name}"), F.lit(1))
        return seen + weight * F.col(f"p_{name}")

    kept = words.select("expression", "g", F.log(F.col("p_toxic") / F.col("p_ordinary")).alias("gain")).unionByName(
        pairs.select("expression", "g", F.log(conditional("toxic") / conditional("ordinary")).alias("gain")))
    entries = cut_lineage(kept.filter((F.col("g") >= LEAST_G) & (F.abs("gain") >= LEAST_GAIN))
                          .select("expression", "gain"))
    model = ToxicityModel(entries, max(1, math.ceil(entries.count() / slice_entries)), ())
    # the ids are ranked without their texts; equal hashes are equal ids, which stay together
    ranked = cut_lineage(texts.select(F.xxhash64("id").alias("h")).orderBy("h").limit(calibration_rows))
    aside = max(1, min(calibration_rows, sum(r["count"] for r in classes) // 4))

    def first_rows(n):
        return F.xxhash64("id") <= F.lit(ranked.orderBy("h").limit(n).agg(F.max("h")).first()[0])

    by_evidence = _fit(add_evidence(texts.filter(first_rows(calibration_rows)), model, "text"))
    uncounted = first_rows(aside)
    models = train_classes(texts.filter(~uncounted), head_entries)
    sample = add_likelihoods(add_evidence(texts.filter(uncounted), model, "text"), models, "text")
    return ToxicityModel(entries, model.slices, _weigh_likelihoods(sample, by_evidence), models)


# --- scoring ---

def add_evidence(documents: DataFrame, model: ToxicityModel, text_col: str, prefix: str = "") -> DataFrame:
    """``documents`` with evidence (summed gains: toxic less ordinary log-likelihood) and words."""
    total, count = f"{prefix}evidence", f"{prefix}words"
    out = documents.withColumns({total: F.lit(0.0), count: F.lit(0)})
    for number in range(model.slices):
        # a slice holds whole words with their beginnings and pairs, so backing off stays inside it
        root = F.substring(F.substring_index("expression", " ", -1), 1, SHORTEST)
        rows = model.entries.filter(F.pmod(F.xxhash64(root), F.lit(model.slices)) == number).collect()
        out = _add_slice(out, text_col, {r["expression"]: r["gain"] for r in rows}, total, count)
        if number + 1 < model.slices:
            out = cut_lineage(out)
    return out


class Gains(dict):
    """The gain of each word: its own, else that of its longest known beginning, else 0."""

    def __init__(self, known: dict[str, float]):
        super().__init__()
        self.known = known
        self.roots = {e[:SHORTEST] for e in known if e.endswith("*")}

    def __missing__(self, word: str) -> float:
        if len(self) > FLUSH_AT:
            self.clear()
        gain = self.known.get(word)
        if gain is None:
            gain = 0.0
            if word[:SHORTEST] in self.roots:
                starts = (self.known.get(f"{word[:n]}*") for n in BEGINNINGS if n < len(word))
                gain = next((g for g in starts if g is not None), 0.0)
        self[word] = gain
        return gain


def _add_slice(df: DataFrame, text_col: str, known: dict[str, float], total: str, count: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(known)
    fields = [StructField(f"{total}+", DoubleType()), StructField(f"{count}+", IntegerType())]

    def prepare():
        gains = Gains(shared.value)
        after: dict[str, dict[str, float]] = {}  # of a word: the gains of its pairs, by their first word
        for expression, gain in shared.value.items():
            first, space, word = expression.partition(" ")
            if space:
                after.setdefault(word, {})[first] = gain

        def evidence(data: bytes | None):
            words = words_of(data)
            gained = sum(map(gains.__getitem__, words))
            for at, pairs in enumerate(map(after.get, words)):
                if pairs is not None and at:
                    gain = pairs.get(words[at - 1])
                    if gain is not None:
                        gained += gain - gains[words[at]]
            return gained, len(words)

        return evidence

    out = with_columns_from_text(df, text_col, fields, prepare)
    return out.withColumns({
        total: F.col(f"`{total}`") + F.col(f"`{total}+`"), count: F.col(f"`{count}+`"),
    }).drop(f"{total}+", f"{count}+")


def add_likelihoods(documents: DataFrame, models: ClassModels | None, text_col: str, prefix: str = "") -> DataFrame:
    """``documents`` with the log-likelihoods ``toxic_ll`` and ``ordinary_ll``, each with ``prefix``."""
    names = [f"{prefix}toxic_ll", f"{prefix}ordinary_ll"]
    if models is None:
        return documents.withColumns({name: F.lit(0.0) for name in names})
    key = f"{prefix}text_hash"
    found = log_likelihoods(documents, models, text_col).toDF(key, *names)
    return documents.withColumn(key, F.xxhash64(text_col)).join(found.hint("merge"), key).drop(key)


def _features(evidence, words):
    """Total evidence, evidence per word, and length."""
    return [evidence, evidence / np.maximum(words, 1) * 100.0, np.log1p(words)]


def _constant(rate: float) -> tuple[float, ...]:
    rate = min(max(rate, 0.001), 0.499)
    return (math.log(rate / (1 - rate)), 0.0, 0.0, 0.0, 0.0, 0.0)


def _fit(sample: DataFrame) -> tuple[float, ...]:
    """Intercept and one weight per feature of the evidence."""
    rows = sample.select("evidence", "words", "toxic").toPandas()
    y = rows["toxic"].to_numpy(dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return _constant(float(y.mean()) if len(y) else 0.0)[:4]
    return _logistic(_features(rows["evidence"].to_numpy(dtype=float), rows["words"].to_numpy(dtype=float)), y, 0.1)


def _weigh_likelihoods(sample: DataFrame, by_evidence: tuple[float, ...]) -> tuple[float, ...]:
    """``by_evidence`` with the weights of both log-likelihoods per word, fitted beside it, and its new intercept."""
    rows = sample.select("evidence", "words", "toxic_ll", "ordinary_ll", "toxic").toPandas().astype(float)
    evidence, words, toxic, ordinary, y = (rows[c].to_numpy() for c in rows.columns)
    features = [toxic / (words + 1), ordinary / (words + 1)]
    if min((y > 0).sum(), (y == 0).sum()) < LEAST_PER_WEIGHT * (1 + len(features)):
        return (*by_evidence, 0.0, 0.0)
    known = by_evidence[0] + sum(w * x for w, x in zip(by_evidence[1:], _features(evidence, words)))
    shift, *weights = _logistic(features, y, 1.0, known)
    return (by_evidence[0] + shift, *by_evidence[1:], *weights)


def _logistic(features: list, y: np.ndarray, least: float, known: np.ndarray | float = 0.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps with the small ridge ``least``: intercept and one weight per
    feature, added to the log-odds ``known``."""
    x = np.column_stack(features)
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(y)), (x - mean) / spread])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-6] + [least] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(known + z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple([float(w[0] - (w[1:] * mean / spread).sum()), *(w[1:] / spread).tolist()])


def score_texts(documents: DataFrame, model: ToxicityModel, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``documents`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), each with ``prefix``."""
    own = f"{prefix}toxicity_"
    gathered = add_likelihoods(add_evidence(documents, model, text_col, own), model.classes, text_col, own)
    evidence, words = F.col(f"{own}evidence"), F.col(f"{own}words")
    toxic, ordinary = F.col(f"{own}toxic_ll"), F.col(f"{own}ordinary_ll")
    b, total, mean, length, as_toxic, as_ordinary = model.weights
    logit = (b + total * evidence + mean * evidence / F.greatest(words, F.lit(1)) * 100.0
             + length * F.log1p(words.cast("double"))
             + as_toxic * toxic / (words + 1) + as_ordinary * ordinary / (words + 1))
    score = 1 / (1 + F.exp(-logit))
    return gathered.withColumn(f"{prefix}score", score).withColumn(
        f"{prefix}predicted", (F.col(f"{prefix}score") >= 0.5).cast("int")
    ).drop(f"{own}evidence", f"{own}words", f"{own}toxic_ll", f"{own}ordinary_ll")
