"""Scans that judge each row by itself: personal data, licences, URLs, benchmark windows."""

import hashlib
import re

import pytest

from shutterlake.llm import queries
from shutterlake.llm.decontamination import WindowSearch, mark_contamination, words_of
from shutterlake.llm.licences import NOTICES, bigrams_of, default_templates, licence_report, scan_licences
from shutterlake.llm.pii import digest_columns, find_pii
from shutterlake.llm.url_filters import Rule, judge_urls

from tests.llm.conftest import SF_DIR


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    """The base kinds as plain regular expressions."""
    found = []
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    for place, (kind, pattern, good) in enumerate(kinds):
        if kind == "email" and len(text) > 50_000:
            continue  # the plain pattern is quadratic there
        for m in re.finditer(pattern, text or "", re.ASCII):
            if good(m.group()):
                found.append((m.start(), place, kind, m.end()))
    return sorted(found)


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans).encode()).hexdigest()


PII_TEXTS = [
    "write a.b@c.de or x@y.zz_m@d.ef, also é@q.w.e ñ x@@y.z a@b.c@d.e",
    "ip 10.0.0.1 999.1.1.1 1.2.3.4.5 0255.001.2.3 99999999999999.1.1.1",
    "card 4847705742015541 4847-7057-4201-5541 4847 7057 4201 5542 0000000000000000",
    "call +1 (832) 555-8455 or +49 30 1234567, not +1 2 or +123456789012345678",
    "IBAN DE89 3702 0044 0532 0130 00 and GB82WEST12345698765432, not DE88370400440532013000",
    "her ssn is 123-45-6789 while part 123-45-6789 is not near, €€ 1.2.3.4",
]


def test_pii_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id long, text string")
    for row in digest_columns(find_pii(df)).collect():
        want = base_spans(PII_TEXTS[row["doc_id"]])
        assert row["base_sha256"] == sha(want), (PII_TEXTS[row["doc_id"]], row["spans"], want)
        assert [row[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            sum(w[2] == k for w in want) for k in ("email", "ip", "card", "phone")]


def test_pii_checks_and_context(spark):
    df = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in digest_columns(find_pii(df)).collect()}
    assert rows[4]["n_iban"] == 1 and "iban:37:59" in rows[4]["spans"]
    assert rows[5]["n_ssn"] == 1 and rows[5]["spans"].startswith("ssn:11:22")
    assert rows[3]["top_score"] == 1.0


def test_pii_query_equals_plain_patterns(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = {r["doc_id"]: r["base_sha256"] for r in queries.QUERIES["op10_pii"](spark, SF_DIR).collect()}
    assert got == {d: sha(base_spans(t)) for d, t in texts.items()}


def test_pii_odd_rows(spark, odd, nothing):
    out = digest_columns(find_pii(odd)).collect()
    assert len(out) == odd.count()
    for row, text in zip(out, [r["text"] for r in odd.collect()]):
        assert row["base_sha256"] == sha(base_spans(text or ""))
    assert digest_columns(find_pii(nothing)).collect() == []


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def plain_licences(text, threshold=0.8):
    low = re.sub("[^a-z0-9\n]+", " ", (text or "").lower())
    low = re.sub(" *\n *", "\n", low)
    units = dict.fromkeys([*re.split("\n+", low), *[p.replace("\n", " ") for p in re.split("\n{2,}", low)]])
    best = []
    for unit in dict.fromkeys(u.strip() for u in units):
        own = set(bigrams_of(unit))
        scored = [(-dice(own, set(t.bigrams)), t.licence) for t in default_templates()]
        minus, name = min(scored)
        if -minus >= threshold - 1e-9:
            best.append((minus, name))
    return min(best)[1] if best else None, len(best)


LICENCE_TEXTS = [
    "Foo bar\nReleased under the MIT License.\nbar", "Licensed under CC BY-NC 4.0.",
    "Licensed under the Apache License, Version 2.0.", "licensed ñunder the mit license",
    "This work is licensed under the GNU General Public License, version 3.\n\nReleased under the MIT License.",
    "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted\n"
    "provided that the following conditions are met:\n\nmore", "License", "the the the the", "ñlicensed under the mit license",
]


def test_licences_equal_plain_comparison(spark):
    texts = LICENCE_TEXTS + [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in licence_report(scan_licences(df)).collect():
        assert (row["licence"], row["n_matches"]) == plain_licences(texts[row["doc_id"]]), texts[row["doc_id"]][:200]


def test_each_notice_is_its_own_licence(spark):
    gnu = ("This program is free software{0} you can redistribute it and/or modify\nit under the terms of the GNU {1} "
           "as published by\nthe Free Software Foundation{2} either version {3} of the License, or\n"
           "(at your option) any later version.")
    rows = [("GPL-2.0", gnu.format(";", "General Public License", ";", 2)),
            ("GPL-3.0", gnu.format(":", "General Public License", ",", 3)),
            ("LGPL-3.0", gnu.format(":", "Lesser General Public License", ",", 3)),
            ("AGPL-3.0", gnu.format(":", "Affero General Public License", ",", 3))]
    rows += [(key, text) for key, notices in NOTICES.items() for text in notices]
    df = spark.createDataFrame([(i, f"Copyright 2020 A. Author\n\n{text}\n\nMore text.")
                                for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licence"] for r in licence_report(scan_licences(df)).collect()}
    assert [got[i] for i in range(len(rows))] == [key for key, _ in rows]
    assert {t.licence for t in default_templates()} == set(NOTICES)


def test_licences_odd_rows(spark, odd, nothing):
    out = licence_report(scan_licences(odd)).collect()
    assert len(out) == odd.count() and not any(r["n_matches"] for r in out)
    assert licence_report(scan_licences(nothing)).collect() == []
    assert licence_report(scan_licences(odd, templates=[])).count() == odd.count()


def test_urls(spark):
    rules = [Rule(*r) for r in queries.URL_RULES]
    cases = {
        "http://a.example.com/en/x": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "http://WWW.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://b.com/porn": ("b.com", "/porn", "com/", "allow"),
        "https://b.com": ("b.com", "", None, "allow"),
        "https://x.net/fr/1?q=/es/": ("x.net", "/fr/1", "net/fr/", "block"),
        "https://x.org/porn": ("x.org", "/porn", None, "block"),
        "https://x.org/pornography": ("x.org", "/pornography", None, "allow"),
        "https://x.org/casino": ("x.org", "/casino", None, "allow"),
        "https://x.org/casino?poker": ("x.org", "/casino", None, "block"),
        "https://x.org/casino/casino": ("x.org", "/casino/casino", None, "allow"),
        "no scheme casino poker": ("", "", None, "block"),
        "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://?x": ("", "", None, "allow"), "ftp://a\nb.com/\nc#d": ("a\nb.com", "/\nc", "com/", "allow"),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df, rules).collect()}
    assert got == {i: want for i, want in enumerate(cases.values())}
    assert judge_urls(df, [], strict=(), soft=()).filter("verdict = 'block'").count() == 0
    assert judge_urls(df.filter("false"), rules).count() == 0


def plain_hits(text, items, width=10):
    words = words_of(text.encode() if text else None)
    hit, found = set(), set()
    for item, item_text in items:
        own = words_of(item_text.encode() if item_text else None)
        size = min(width, len(own))
        windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1) if size else []:
            if tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(item)
    return len(words), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("slice_windows", [200_000, 3])
def test_decontamination_equals_plain_search(spark, odd, slice_windows):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Same text"), (10, "x"),
             (3, "word word word"), (4, ""), (5, None), (2, "again; same TEXT twice"), (7, "é über-straße")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["ONE, two three four-five six seven eight nine ten eleven", "x y x", "one two",
             "é über straße é über", "two three four five six seven eight nine ten eleven twelve x"]
    more = spark.createDataFrame([(100 + i, t, None, None, None) for i, t in enumerate(texts)], odd.schema)
    rows = odd.unionByName(more)
    out = mark_contamination(rows, bench, slice_windows=slice_windows, prefix="_").collect()
    assert len(out) == rows.count()
    for row in out:
        n_words, n_hit, found = plain_hits(row["text"], items)
        assert (row["_n_words"], row["_n_hit"], row["_n_items"]) == (n_words, n_hit, len(found)), row["text"][:80]
        assert row["_items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert row["_contaminated"] == (n_hit > 0)


def test_decontamination_of_nothing(spark, odd, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert mark_contamination(odd, bench, prefix="_").filter("_contaminated").count() == 0
    assert mark_contamination(nothing, bench).count() == 0


def test_window_search_overlaps():
    search = WindowSearch({(b"a", b"b", b"a"): ["p"], (b"b", b"a"): ["q"], (b"a",): ["r"]})
    found = sorted((s, n) for s, n, _ in search.occurrences([b"a", b"b", b"a", b"b", b"a"]))
    assert found == [(0, 1), (0, 3), (1, 2), (2, 1), (2, 3), (3, 2), (4, 1)]


def test_items_without_an_id_are_searched(spark):
    docs = spark.createDataFrame([(1, "x a b c y"), (2, "x y"), (3, "d e a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c"), (None, "y"), ("k", "D e")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
           for r in mark_contamination(docs, items).collect()}
    nothing, k = (hashlib.sha256(t).hexdigest() for t in (b"", b"k"))
    assert got == {1: (4, 1, nothing, True), 2: (1, 1, nothing, True), 3: (5, 2, k, True)}
