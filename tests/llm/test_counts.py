"""Phrase collocations, tokenizer alignment and exact top-k search against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.llm import queries
from shutterlake.llm.alignment import (FOLDER, Aligner, Tokenizers, align_tokenizers, byte_symbols, heap_merge,
                                       highest_of_side, token_groups)
from shutterlake.llm.collocations import collocations, word_counts
from shutterlake.llm.common import prepare
from shutterlake.llm.topk import Block, best_places, exact_top_k, whole_weights

from tests.llm.conftest import SF_DIR

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- collocations -----------------------------------------------------------------------------

def plain_collocations(rows, least, longest, keep, percent=100):
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, tuple(words[i:i + m])) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    found = defaultdict(list)
    frequent = {k: a for k, a in f.items() if a >= least}
    swallowed = set()
    for (lang, words), a in frequent.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                part = words[i:j]
                if part != words and 100 * a >= percent * f[lang, part]:
                    swallowed.add((lang, part))
    for (lang, words), a in frequent.items():
        if len(words) < 2 or (lang, words) in swallowed:
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found[lang].append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], total[lang], score))
    out = []
    for rows in found.values():
        rows.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], n, *r[1:]) for n, r in enumerate(rows[:keep], 1)]
    return sorted(out)


def spoken(seed, texts=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "ßx", "a b", "…"]
    phrases = [[rng.choice(words) for _ in range(rng.randint(2, 7))] for _ in range(12)]
    rows = []
    for _ in range(texts):
        out = []
        for _ in range(rng.randint(0, 20)):
            out += rng.choice(phrases) if rng.random() < .5 else [words[min(int(rng.expovariate(.15)), 43)]]
            if rng.random() < .2:
                out.append(rng.choice([".", ",", "\n", "\r", "\x0b", "!", " \t "]))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), " ".join(out).replace("w1", "W1")))
    return rows


@pytest.mark.parametrize("seed, least, longest, keep, percent, band", [
    (1, 5, 5, 2000, 100, 64), (2, 3, 5, 7, 100, 2), (3, 4, 3, 3, 100, 2), (4, 5, 5, 10, 60, 3), (5, 2, 2, 4, 100, 2)])
def test_collocations_equal_plain_counts(spark, seed, least, longest, keep, percent, band):
    """Small bands and few places make the bound leave nodes out."""
    rows = spoken(seed)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations(df, least=least, longest=longest, keep=keep, percent=percent, band=band)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, least, longest, keep, percent)


def test_collocations_in_small_chunks(spark, monkeypatch):
    from shutterlake.llm import collocations as module

    rows = spoken(6, 120)
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(module, "CHUNK_WORDS", 50)  # read on the driver only where tasks run in it
    assert sorted(map(tuple, collocations(df, least=3, keep=5).collect())) == plain_collocations(rows, 3, 5, 5)


def test_ties_at_the_last_place(spark):
    """Equal scores beyond the last place are settled by a, then by phrase."""
    rows = [("en", f"{a} {b}") for a, b in zip("hgfedcba", "HGFEDCBA") for _ in range(4)]
    rows = [(lang, f"x{t.split()[0]} y{t.split()[0]}") for lang, t in rows]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = [r["phrase"] for r in collocations(df, least=2, keep=3).orderBy("rank").collect()]
    assert got == ["xa ya", "xb yb", "xc yc"]


def test_collocations_of_odd_tables(spark, odd, nothing):
    assert collocations(nothing).collect() == []
    tagged = odd.withColumn("lang", F.lit(None).cast("string")).withColumn("phrase", F.lit("x")).withColumn("f", F.lit(1))
    got = collocations(tagged, least=2)
    rows = [(None, r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 2, 5, 2000)
    counts = {r["phrase"]: r["f"] for r in word_counts(tagged).collect()}
    assert counts["word"] == 30_000 and counts["text"] == 3


def test_refused_parameters(spark, nothing):
    for wrong in ({"longest": 1}, {"least": 0}, {"percent": 0}, {"percent": 101}):
        with pytest.raises(ValueError):
            collocations(nothing, **wrong)


# --- alignment --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizers():
    return Tokenizers(f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model")


def plain_alignment(rows, tokenizers):
    """Groups by walking both sides token by token."""
    docs = []
    for doc_id, text in rows:
        encoded = tokenizers.encode(text.encode()) if text else None
        groups, own_a, own_b, at_a, at_b = [], [], [], 0, 0
        if encoded is not None:
            a, b = (ids.tolist() for ids in encoded)
            while a or b:
                if at_a <= at_b and a and not (at_a == at_b and own_a):
                    own_a.append(a.pop(0))
                    at_a += len(tokenizers.bytes_a[own_a[-1]])
                else:
                    own_b.append(b.pop(0))
                    at_b += len(tokenizers.bytes_b[own_b[-1]])
                if at_a == at_b and own_a and own_b:
                    groups.append((own_a, own_b))
                    own_a, own_b = [], []
        docs.append((doc_id, groups))
    counts = Counter((a[-1], b[-1]) for _, groups in docs for a, b in groups)
    top = {}
    for (a, b), n in counts.items():
        top[b] = max(n, top.get(b, 0))
    out = []
    for doc_id, groups in docs:
        links = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, counts, top


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) for v in r))


TEXTS = ["Hello world", "Hello world", "hello  worlds", "ÄÖÜ straße 漢字 🙂", "<|endoftext|> and <s></s>", "a▁b", "x\x00y",
         "  lead", "\n\t\r\n", "don't we're 12345", "", None, "word " * 400, "Hello", "￼ﬁ", "z" * 3000]


@pytest.mark.parametrize("run_links, fan, at_once, radix", [(1 << 21, 64, 8, 16), (20, 2, 1, 3), (1, 3, 2, 1)])
def test_alignment_equals_plain_walk(spark, tokenizers, run_links, fan, at_once, radix):
    """Small runs are merged in several levels."""
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(None, "Hello null"), (0, "id again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    prepare(spark)
    docs, pairs = align_tokenizers(df, run_links=run_links, fan=fan, runs_at_once=at_once, radix=radix)
    expected, counts, top = plain_alignment(rows, tokenizers)
    assert in_order(docs.collect()) == in_order(expected)
    assert sorted(map(tuple, pairs.collect())) == sorted((a, b, n, n == top[b]) for (a, b), n in counts.items())


def test_alignment_of_the_smallest_documents(spark, tokenizers):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_tokenizer_alignment"](spark, SF_DIR)
    assert in_order(got.collect()) == in_order(plain_alignment(rows, tokenizers)[0])


def test_groups_spell_the_text(spark, tokenizers):
    """Round trip: the bytes of either side's ids, group by group, are space+text."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for doc_id, groups in token_groups(df).collect():
        text = TEXTS[doc_id]
        if groups is None:
            assert not text or Aligner(tokenizers).align(text.encode()) is None
            continue
        sides = [[[int(i) for i in side.split(",")] for side in group.split("|")] for group in groups.split(";")]
        for a, b in sides:
            assert b"".join(tokenizers.bytes_a[i] for i in a) == b"".join(tokenizers.bytes_b[i] for i in b)
        assert b"".join(tokenizers.bytes_a[i] for a, _ in sides for i in a).decode() == " " + text


def test_texts_whose_bytes_change_have_no_tokens(tokenizers):
    assert Aligner(tokenizers).align("a▁b".encode()) is None  # the mark of side B stands for a space
    assert Aligner(tokenizers).align(None) is None and Aligner(tokenizers).align(b"") is None
    assert 50256 not in Aligner(tokenizers).align(b"<|endoftext|>").a.tolist()


def test_both_ways_of_side_a_agree(spark, tokenizers):
    """The encoder by rank gives the library's ids: every text of the table, random mixtures, all characters it takes."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()]
    rng = random.Random(3)
    bits = ["a", "Z", "don't", " ", "  ", "\n", "\t", "\u00a0", "\u0085", "é", "1", "²", "-", ".", "'s", " x", "\x00", "\x1f"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    texts += [f" a{chr(c)}b{chr(c)}{chr(c)} {chr(c)}1{chr(c)} {chr(c)}" for c in range(0x250)]
    assert tokenizers._ranked is not None
    for text in texts:
        library = tokenizers._a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        assert tokenizers._ranked.encode_ordinary(" " + text) == library


def test_byte_symbols_cover_all_bytes():
    assert sorted(byte_symbols().values()) == list(range(256))
    assert byte_symbols()["Ġ"] == 0x20


def test_heap_merge_and_side_maxima():
    runs = [(np.array([1, 5, 12]), np.array([2, 1, 4])), (np.array([5, 6]), np.array([1, 2])), (np.array([], int),) * 2]
    pairs, totals = heap_merge(runs)
    assert (pairs, totals) == ([1, 5, 6, 12], [2, 2, 2, 4])
    assert highest_of_side(pairs, totals, 10).tolist() == [True, True, True, True]
    assert highest_of_side([1, 2, 30], [3, 4, 1], 10).tolist() == [False, True, True]


def test_alignment_of_odd_tables(spark, odd, nothing, tokenizers):
    prepare(spark)
    docs, pairs = align_tokenizers(nothing)
    assert docs.collect() == [] and pairs.collect() == []
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    clash = odd.withColumn("run", F.lit("x")).withColumn("place", F.lit("y")).withColumn("radix", F.lit(None).cast("int"))
    assert in_order(align_tokenizers(clash)[0].collect()) == in_order(plain_alignment(rows, tokenizers)[0])


# --- exact top-k ------------------------------------------------------------------------------

def plain_top(rows, k, every=50, scale=256):
    """Sorted (query id, ranked (score, id)) lists, one per query row."""
    whole = []
    for vec_id, vector in rows:
        usable = vector is not None and all(x is not None and np.isfinite(x) for x in vector)
        if usable:
            whole.append((vec_id, [int(np.floor(float(np.float32(x)) * scale)) for x in vector]))
    out = []
    for at, (query, q) in enumerate(whole):
        if query is None or query % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, c)), (i is None, i or 0), i)
                  for n, (i, c) in enumerate(whole) if n != at]
        out.append((query, [(i, -s) for s, _, i in sorted(scored)[:k]]))
    return sorted(out, key=str)


def ranked(df):
    by_query = defaultdict(list)
    for row in df.collect():
        by_query[row["query_id"]].append(row)
    out = []
    for query, rows in by_query.items():
        rows.sort(key=lambda r: r["rank"])
        times = Counter(r["rank"] for r in rows)[1]
        assert all(r["rank"] == 1 + n // times for n, r in enumerate(rows))
        out.append((query, times, sorted((r["rank"], -r["score"], str(r["vec_id"])) for r in rows)))
    return sorted(out, key=str)


def expected_ranks(rows, k, every=50):
    by_query = defaultdict(list)
    for query, best in plain_top(rows, k, every):
        by_query[query].append(best)
    return sorted([(query, len(lists), sorted((n, -s, str(i)) for best in lists for n, (i, s) in enumerate(best, 1)))
                   for query, lists in by_query.items() if lists[0]], key=str)


@pytest.mark.parametrize("block_rows, group_queries, k", [(16_384, 4096, 5), (37, 2, 5), (5, 1, 3)])
def test_top_k_equals_brute_force(spark, block_rows, group_queries, k):
    rng = np.random.default_rng(k + block_rows)
    vectors = rng.normal(size=(160, 9)).round(2) * (rng.random((160, 9)) < .5)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900 + i, rows[3][1]) for i in range(30)]                    # ties
    rows += [(0, rows[7][1]), (50, rows[50][1]), (100, rows[0][1])]       # repeated ids
    rows += [(None, rows[0][1]), (150, None), (200, [1.0, None]), (250, [float("nan")]), (300, [float("inf")]),
             (350, []), (400, [0.0] * 9), (450, [1.5, -2.5])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, id string, rank int")
    got = exact_top_k(df, F.col("vec_id") % 50 == 0, k, block_rows=block_rows, group_queries=group_queries)
    assert ranked(got) == expected_ranks(rows, k)


def test_top_k_of_few_or_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_top_k(empty, F.col("vec_id") % 50 == 0).collect() == []
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert exact_top_k(one, F.col("vec_id") % 50 == 0).collect() == []
    two = spark.createDataFrame([(50, [1.0]), (1, [-.001])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_top_k(two, F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 1, -256)]


def test_top_k_of_huge_weights(spark):
    """Scores beyond 64 bits count as the nearest 64-bit number; ties go to the smaller id."""
    rows = [(50, [1e17, 1e17]), (1, [1e17, 1e17]), (2, [9e16, 1e17]), (3, [-1e17, -1e17]), (4, [1e-2, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in exact_top_k(df, F.col("vec_id") == 50).orderBy("rank").collect()]
    assert [(g[2], g[3]) for g in got] == [(1, 2 ** 63 - 1), (2, 2 ** 63 - 1), (4, 2 ** 63 - 1), (3, -2 ** 63)]
    assert whole_weights(np.array([1e300, -1e300, -.001]), 256).tolist() == [2 ** 63 - 1, -2 ** 63, -1]


def test_best_places_break_ties_by_place():
    assert best_places(np.array([1, 5, 5, 5, 0]), 2).tolist() == [1, 2]
    assert best_places(np.array([3, -2 ** 63, 9]), 5).tolist() == [2, 0, 1]
    assert best_places(np.array([], dtype=np.int64), 3).tolist() == []


def test_scores_skip_absent_terms():
    row = {"ids": [1, 2, 3], "block": 0, "terms": np.array([0, 4], np.int32).tobytes(),
           "sizes": np.array([0, 3, 1, 1]).tobytes(), "places": np.array([2], np.int32).tobytes(),
           "weights": np.array([1, 0, -2, 7]).tobytes()}
    assert Block(row).scores([0, 4, 9], [10, 2, 5]).tolist() == [10, 0, -6]
