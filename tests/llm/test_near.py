"""Near-duplicates: the Jaccard join, repeated passages, and the pipeline over both, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shutterlake.llm import queries
from shutterlake.llm.jaccard_join import (SignatureTree, block_links, candidate_edges, candidate_keys,
                                          keep_one_per_component, leaf_pairs, linked_pairs, near_duplicates, similar,
                                          similar_pairs)
from shutterlake.llm.passages import RunHashes, alike_stretches, compact_windows, repeated_passages, runs_of
from shutterlake.llm.shingles import PigeonholeKeys, WordHashes, set_hash, shingle_set
from shutterlake.session import cut_lineage

from tests.llm.conftest import SF_DIR
from tests.llm.test_learned import plain_spans
from tests.llm.test_scans import plain_hits


def plain_set(text, width):
    words = (text or "").encode().lower().split()
    size = min(width, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()


def plain_components(rows, width, percent):
    """{place: (set size, smallest linked id)} of (id, text) rows with ids."""
    sets = [plain_set(t, width) for _, t in rows]
    above = list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                above[root(i)] = root(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), low[root(i)]) for i, (doc_id, _) in enumerate(rows)]


def edited_texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([1, 2, 4, 9, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 6, 14])):
            own = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 18))):
                at = rng.randrange(len(own) + 1)
                change = rng.random()
                if change < .4 and own:
                    own[min(at, len(own) - 1)] = rng.choice(words)
                elif change < .7:
                    own.insert(at, rng.choice(words))
                elif len(own) > 1:
                    own.pop(min(at, len(own) - 1))
            rows.append((rng.randrange(10 ** 6) * 100 + len(rows), " ".join(own).replace("w1", "W1")))
    return rows


@pytest.mark.parametrize("width, percent, chunk_sets", [(3, 90, 1024), (5, 80, 1024), (3, 90, 4), (2, 50, 7)])
def test_components_equal_plain_comparison(spark, width, percent, chunk_sets):
    rows = edited_texts(width * percent + chunk_sets)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_duplicates(df, width, percent, chunk_sets=chunk_sets).collect())
    assert got == sorted(plain_components(rows, width, percent))


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_similar_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    keys = PigeonholeKeys(percent)
    for _ in range(400):
        size = int(rng.choice([1, 2, 3, 5, 9, 10, 19, 40, 200, 3000]))
        a = np.unique(rng.integers(0, 2 ** 63, size=size, dtype=np.uint64))
        differing = int((100 - percent) * 2 * len(a) / (100 + percent))
        removed = int(rng.integers(0, differing + 1))
        added = rng.integers(0, 2 ** 63, size=differing - removed, dtype=np.uint64)
        b = np.unique(np.concatenate([rng.permutation(a)[:len(a) - removed], added]))
        if len(b) and similar(a, b, percent):
            (own, slots), (other, theirs) = keys.of(a), keys.of(b)
            common = set(own.tolist()) & set(other.tolist())
            assert common, (len(a), len(b))
            # any agreeing keys but as many as the smaller room can be passed over
            levels = [sum(k in common for k in own[slots % 2 == p].tolist()) - slots[slots % 2 == p][0] // 2
                      for p in (0, 1)]
            assert max(levels) >= 0


def test_sets_that_share_a_few_keys_are_no_candidates(spark):
    words = [[f"{name}{i}" for i in range(3000)] for name in "abc"]
    quoting = words[0][:1500] + words[1][:1500]  # half of another text, far from similar
    near = words[2][:1400] + ["new"] + words[2][1401:]
    texts = spark.createDataFrame([(" ".join(t),) for t in (words[0], quoting, words[2], near, words[2])], "text string")
    keys = candidate_keys(texts, "text", 5, 80)
    linked = {set_hash(shingle_set(WordHashes().of([w.encode() for w in t]), 5))[0] for t in (words[2], near)}
    shared = keys.distinct().groupBy("key").count().filter("count > 1").join(keys, "key").select("h1").distinct().count()
    assert shared == 4  # each of the four sets shares keys with another
    assert [{r["src"], r["dst"]} for r in candidate_edges(keys).collect()] == [linked]


def test_trees_lose_no_pair():
    rng = np.random.default_rng(0)
    base = [np.unique(rng.integers(0, 2 ** 63, size=n, dtype=np.uint64)) for n in (1, 3, 40, 41, 200, 900)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > .04], rng.integers(0, 2 ** 63, size=len(b) // 60, dtype=np.uint64)]))
            for b in base for _ in range(25)]
    sets = [s for s in sets if len(s)]
    left, right = sets[::2], sets[1::2]
    for percent in (80, 90):
        first, second = SignatureTree(left, 32), SignatureTree(right, 32)
        found = {p for a, b in leaf_pairs(first, second, percent) for p in zip(a.tolist(), b.tolist())}
        want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if similar(a, b, percent)}
        assert want <= found and len(found) < len(left) * len(right) / 2
        whole = SignatureTree(sets, 32)
        own = {p for a, b in leaf_pairs(whole, whole, percent) for p in zip(a.tolist(), b.tolist())}
        assert all(i < j for i, j in own)
        assert {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similar(sets[i], sets[j], percent)} <= own
    assert linked_pairs([base[0]], None, 80) == [] and linked_pairs([base[0]], [base[0]], 80) == [(0, 1)]


def test_jaccard_odd_rows(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = near_duplicates(odd, 3, 90)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == len(rows)
    sizes = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"]) for r in got.collect())
    assert sizes == sorted((d is None, d or 0, len(plain_set(t, 3))) for d, t in rows)
    by_id = {r["doc_id"]: r["component_id"] for r in got.collect() if r["doc_id"] != 1}
    assert by_id[13] == by_id[12] == 12 and by_id[0] == 0 and by_id[2] == 2 and by_id[None] is None
    assert near_duplicates(nothing).count() == 0
    kept = keep_one_per_component(odd, 3, 90)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # the two rows with id 1 are not alike: both stay
    assert 13 not in ids and ids.count(1) == 2 and ids.count(None) == 1 and len(ids) == len(rows) - 1
    assert keep_one_per_component(nothing).count() == 0


@pytest.mark.parametrize("chunk_sets", [1, 512])
def test_repeated_ids_keep_their_own_links(spark, chunk_sets):
    first, second = ([f"{name}{i}" for i in range(100)] for name in "ab")
    chain = first[:60] + second[:60]  # of a text like neither
    texts = [(1, first), (1, second), (2, first[:97]), (3, second[:97]), (1, first[:99]), (4, chain), (4, chain)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    got = sorted(tuple(r) for r in near_duplicates(df, 3, 90, chunk_sets=chunk_sets, count_links=True).collect())
    assert got == [(1, 97, 1, 2), (1, 98, 1, 1), (1, 98, 1, 2), (2, 95, 1, 2), (3, 95, 1, 1), (4, 118, 4, 1), (4, 118, 4, 1)]
    kept = sorted(tuple(r) for r in keep_one_per_component(df, 3, 90).collect())
    assert kept == sorted([(1, " ".join(first[:99])), (1, " ".join(second)), (4, " ".join(chain))])


def test_repeated_rows_of_a_block(spark):
    sets = [(1, i, list(range(100))) for i in (1, 2, 3)] * 2
    df = spark.createDataFrame(sets, "block long, doc_id long, shingles array<long>")
    assert block_links(df, 90, 1024).count() == 2


@pytest.mark.parametrize("chunk_sets", [4, 512])
def test_links_equal_plain_comparison(spark, chunk_sets):
    rows = edited_texts(chunk_sets)
    rows += [(10 ** 9 + i, t) for i, (_, t) in enumerate(rows[::3])]
    sets = {d: plain_set(t, 3) for d, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
            and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, 3, 80, chunk_sets=chunk_sets, count_links=True).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == {d: sum(d in p for p in want) for d in sets}
    pairs, members = similar_pairs(df, 3, 80, chunk_sets=chunk_sets)
    rep = {r["doc_id"]: r["rep"] for r in members.collect()}
    linked = [tuple(r) for r in pairs.collect()]
    assert len(linked) == len(set(linked))
    assert want == {(a, b) for a in sets for b in sets if a < b and a in rep and b in rep and (
        rep[a] == rep[b] or (min(rep[a], rep[b]), max(rep[a], rep[b])) in linked)}


# --- passages ---

def test_compact_windows_hold_each_subsequence_once():
    rng = np.random.default_rng(2)
    for n, least in ((1, 1), (30, 1), (40, 7), (6, 7), (64, 64)):
        values = rng.integers(0, 50, size=n).astype(np.uint64)
        windows = compact_windows(values, least)
        for i in range(n):
            for j in range(i + least - 1, n):
                holding = [(low, c, high) for low, c, high in windows if low <= i <= c <= j <= high]
                assert len(holding) == 1 and values[holding[0][1]] == values[i:j + 1].min()


def test_alike_stretches():
    a = np.arange(200)
    b = a.copy()
    assert alike_stretches(a, b, 5, 50, 80) == [(0, 199)]
    b[100:150] = -1
    assert alike_stretches(a, b, 5, 50, 80) == [(0, 99), (150, 199)]
    b[60] = -2
    assert alike_stretches(a[:90], b[:90], 5, 50, 80) == [(0, 89)]
    assert alike_stretches(a[:49], a[:49], 5, 50, 80) == [] and alike_stretches(a, a + 1, 5, 50, 80) == []


def plain_covered(rows, passage=50):
    """{id: places of words inside a run of ``passage`` words that another id also holds}."""
    words = {d: (t or "").encode().lower().split() for d, t in rows}
    where = {}
    for d, w in words.items():
        for i in range(len(w) - passage + 1):
            where.setdefault(tuple(w[i:i + passage]), set()).add(d)
    return {d: {j for i in range(len(w) - passage + 1) if len(where[tuple(w[i:i + passage])]) > 1
                for j in range(i, i + passage)} for d, w in words.items()}


def covered(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["last_word"] + 1))
    return found


def test_passages_of_the_smallest_table(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = covered(repeated_passages(documents))
    want = {d: s for d, s in plain_covered([(r["doc_id"], r["text"]) for r in documents.collect()]).items() if s}
    assert set(want) <= set(got)
    assert sum(len(s & got[d]) for d, s in want.items()) >= 0.99 * sum(map(len, want.values()))


def test_planted_passages(spark):
    rng = random.Random(4)
    text = lambda n: [f"v{rng.randrange(10 ** 6)}" for _ in range(n)]
    shared, long, short = text(55), text(400), text(30)
    near = list(shared)
    near[27] = "edited"
    rows = [(i, text(rng.randrange(0, 90)) + shared + text(rng.randrange(0, 90))) for i in range(40)]
    rows += [(50, text(20) + near + text(20)), (60, text(10) + long), (61, long + text(10)), (70, text(40) + short),
             (71, short + text(60)), (80, text(300)), (81, (text(60)) * 3)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    out = repeated_passages(df)
    got = covered(out)
    assert set(got) == {*range(40), 50, 60, 61}
    want = plain_covered([(d, " ".join(w)) for d, w in rows])
    assert all(want[d] <= got[d] for d in got) and len(got[60]) == 400
    assert all(len(got[d]) == 55 for d in range(40))
    places = {d: w for d, w in rows}
    for r in out.collect():
        a = places[r["doc_id"]][r["first_word"]:r["last_word"] + 1]
        b = places[r["rep_doc_id"]][r["rep_first_word"]:r["rep_first_word"] + len(a)]
        assert sum(x == y for x, y in zip(a, b)) >= 0.8 * len(a)
    assert all(r["rep_doc_id"] <= r["doc_id"] for r in out.collect())


@pytest.mark.parametrize("kind", ["added", "dropped", "changed", "two added"])
def test_passages_with_an_edit(spark, kind):
    rng = random.Random(kind)
    text = lambda n: [f"v{rng.randrange(10 ** 6)}" for _ in range(n)]
    rows, held = [], {}
    for i in range(40):
        shared = text(70)
        near = {"added": shared[:35] + ["new"] + shared[35:], "dropped": shared[:35] + shared[36:],
                "changed": shared[:35] + ["new"] + shared[36:],
                "two added": shared[:35] + ["new", "newer"] + shared[35:]}[kind]
        for d, words in ((2 * i, shared), (2 * i + 1, near)):
            before = text(rng.randrange(5, 90))
            rows.append((d, " ".join(before + words + text(rng.randrange(5, 90)))))
            held[d] = set(range(len(before), len(before) + len(words)))
    got = covered(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(got.get(d) == s for d, s in held.items()) >= 0.95 * len(held)
    assert all(s <= held[d] for d, s in got.items())


def test_runs_are_shared_wherever_a_passage_lies():
    runs = runs_of(5, 50, 80)
    assert min(a + b for a, b in runs) == 45
    for before in range(46):
        assert any(a <= before and b <= 50 - before for a, b in runs)
    rng = np.random.default_rng(5)
    x, y, shared = (rng.integers(0, 2 ** 63, size=n).astype(np.uint64) for n in (200, 90, 50))
    x[70:120], y[3:53] = shared, shared
    hashes = RunHashes(runs)
    for c in range(46):
        a, b = hashes.of(x, np.array([70 + c])), hashes.of(y, np.array([3 + c]))
        inside = [before <= c and on <= 50 - c for before, on in runs]
        assert (a[0] == b[0]).tolist() == [i or p == q == 0 for i, p, q in zip(inside, a[0], b[0])]
        assert any(i and p for i, p in zip(inside, a[0]))


def test_passages_behind_smaller_documents_that_quote_a_few_words(spark):
    rng = random.Random(9)
    text = lambda n: [f"v{rng.randrange(10 ** 6)}" for _ in range(n)]
    shared = text(60)
    rows = []
    for i in range(306):  # every signature of the passage occurs in smaller documents that are not similar
        words = text(110)
        words[50:60] = shared[i % 51:i % 51 + 10]
        rows.append((i, words))
    rows += [(1000, text(30) + shared + text(40)), (1001, text(50) + shared + text(20)), (1002, text(90))]
    rows += [(900 + i, text(80) + shared[25 * i:25 * i + 30] + text(80)) for i in range(2)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = covered(repeated_passages(df))
    assert got == {1000: set(range(30, 90)), 1001: set(range(50, 110))}


def test_passages_odd_rows(spark, odd, nothing):
    assert repeated_passages(odd).filter("doc_id IS NULL").count() == 0
    assert repeated_passages(nothing).count() == 0


# --- the pipeline ---

def test_pipeline_stages_equal_plain_decisions(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("score", F.lit("own"))
    kept = docs
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept = cut_lineage(stage(spark, kept, SF_DIR))
        states.append(kept)
    assert all(s.columns == docs.columns for s in states[:-1])
    texts = [{r["doc_id"]: r["text"] for r in s.collect()} for s in states[:-1]]

    predicted = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op7_toxicity"](spark, SF_DIR).collect()}
    assert texts[0].keys() - texts[1].keys() == {d for d, p in predicted.items() if p}

    parts = plain_components(sorted(texts[1].items()), 5, 80)
    assert set(texts[2]) == {d for d, n, c in parts if d == c}

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert set(texts[3]) == {d for d, t in texts[2].items() if not plain_hits(t, items)[1]}

    assert texts[4].keys() == texts[3].keys()
    for d, t in texts[3].items():
        assert plain_spans(texts[4][d]) == [] and (texts[4][d] == t or plain_spans(t))
    assert states[4].filter("n_chars <> length(text)").count() == 0

    packed = states[5].groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {d: len(t.encode().split()) for d, t in texts[4].items()}


def test_pipeline_of_odd_rows(spark, odd, nothing):
    docs = odd.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn(
        "n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for start in (docs, docs.filter("false"), nothing):
            out = cut_lineage(stage(spark, start, SF_DIR))
            assert out.columns == start.columns, name
    assert corpus_pipeline.pack(spark, docs, SF_DIR).count() >= docs.count()
