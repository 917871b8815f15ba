"""Licence scan: lines and paragraphs compared with templates by the Dice coefficient of word bigrams.

DataFrame functions only; every text is judged in its own row and nothing is shuffled. The units of a
text are its lines and its paragraphs, normalised to lower-case words. Dice(A, B) =
2 |A and B| / (|A| + |B|) can only reach the threshold t when the sizes differ by less than the factor
(2 - t) / t, so a unit meets only templates within these bounds. A further exact filter: a unit that
reaches t shares at least ``need`` bigrams with the template, hence one of any (size - need + 1) of
them; texts and units without a word of such a bigram set are passed over.

Null and empty texts, and units of fewer than two words, match nothing.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: licence names, and the notices as their authors published them ---

LICENCE_NAMES = {
    "AGPL-3.0": "the GNU Affero General Public License, version 3",
    "Apache-2.0": "the Apache License, Version 2.0",
    "BSD-2-Clause": "the BSD 2-Clause License",
    "BSD-3-Clause": "the BSD 3-Clause License",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0",
    "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC0-1.0": "CC0 1.0 Universal",
    "GPL-2.0": "the GNU General Public License, version 2",
    "GPL-3.0": "the GNU General Public License, version 3",
    "ISC": "the ISC License",
    "LGPL-3.0": "the GNU Lesser General Public License, version 3",
    "MIT": "the MIT License",
    "MPL-2.0": "the Mozilla Public License, version 2.0",
    "Unlicense": "the Unlicense",
    "Zlib": "the zlib License",
}

STATEMENTS = ("Licensed under {}", "Released under {}", "Distributed under {}",
              "This work is licensed under {}", "This software is released under {}",
              "This program is distributed under the terms of {}")

NOTICES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met:",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
        "in compliance with the License. You may obtain a copy of the License at",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation; either version 3 of the "
        "License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
    ],
    **{key: [f"This work is licensed under the Creative Commons {name} 4.0 International License.",
             f"This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of "
             f"this license, visit http://creativecommons.org/licenses/{key[3:-4].lower()}/4.0/ or send a letter to "
             "Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."]
       for key, name in (("CC-BY-4.0", "Attribution"), ("CC-BY-SA-4.0", "Attribution-ShareAlike"),
                         ("CC-BY-NC-4.0", "Attribution-NonCommercial"),
                         ("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike"),
                         ("CC-BY-NC-ND-4.0", "Attribution-NonCommercial-NoDerivatives"))},
    "CC0-1.0": [
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright "
        "and related or neighboring rights to this work.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


@dataclass(frozen=True)
class Template:
    licence: str
    bigrams: tuple[str, ...]


def bigrams_of(text: str) -> tuple[str, ...]:
    words = re.findall("[a-z0-9]+", text.lower())
    return tuple(sorted({f"{a} {b}" for a, b in zip(words, words[1:])}))


def default_templates() -> list[Template]:
    texts = [(key, form.format(name)) for key, name in LICENCE_NAMES.items() for form in STATEMENTS]
    texts += [(key, text) for key, notices in NOTICES.items() for text in notices]
    return [Template(key, bigrams_of(text)) for key, text in texts]


def signal_words(templates: list[Template], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold for some template holds at least one."""
    words: set[str] = set()
    for template in templates:
        size = len(template.bigrams)
        least_unit = math.ceil(size * threshold / (2 - threshold) - 1e-9)
        need = math.ceil(threshold * (size + least_unit) / 2 - 1e-9)
        longest = [max(b.split(), key=lambda w: (len(w), w)) for b in template.bigrams]
        ranked = sorted(longest, key=lambda w: (w not in words, -len(w), w))
        words.update(ranked[:size - need + 1])
    return sorted(words)


def _units(text: Column) -> Column:
    """Normalised words of every line and paragraph that may be a notice, one string each."""
    low = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9\n]+", " "), " *\n *", "\n")
    lines = F.split(low, "\n+")
    paragraphs = F.transform(F.split(low, "\n{2,}"), lambda p: F.replace(p, F.lit("\n"), F.lit(" ")))
    return F.transform(F.array_distinct(F.concat(lines, paragraphs)), lambda u: F.trim(u))


def _bigrams(unit: Column) -> Column:
    words = F.split(unit, " ")
    pairs = F.zip_with(
        F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
        lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def scan_licences(documents: DataFrame, templates: list[Template] | None = None, threshold: float = 0.8,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, matches): per unit that reaches the threshold (dice, licence, unit), the best template's.

    Equal scores go to the licence whose name comes first. One row per row of ``documents``.
    """
    templates = default_templates() if templates is None else templates
    kind = "array<struct<dice:double,licence:string,unit:string>>"
    text = F.coalesce(F.col(text_col), F.lit(""))
    if not templates:
        return documents.select(F.col(id_col).alias("doc_id"), F.array().cast(kind).alias("matches"))
    known = F.array(*[
        F.struct(F.lit(t.licence).alias("licence"), F.array(*[F.lit(b) for b in t.bigrams]).alias("bigrams"))
        for t in sorted(templates, key=lambda t: t.licence)])
    wide = (2 - threshold) / threshold
    most = int(max(len(t.bigrams) for t in templates) * wide)
    pattern = "(?<![a-z0-9])(?:" + "|".join(signal_words(templates, threshold)) + ")(?![a-z0-9])"

    def compared(unit):
        own = unit["bigrams"]
        fitting = F.filter(known, lambda t: (F.size(t["bigrams"]) <= F.size(own) * wide + 1e-9)
                           & (F.size(own) <= F.size(t["bigrams"]) * wide + 1e-9))
        scored = F.transform(fitting, lambda t: F.struct(
            (-2.0 * F.size(F.array_intersect(t["bigrams"], own)) / (F.size(t["bigrams"]) + F.size(own))).alias("minus"),
            t["licence"].alias("licence")))
        best = F.array_min(scored)  # highest score, then first name
        return F.struct((-best["minus"]).alias("dice"), best["licence"].alias("licence"), unit["unit"].alias("unit"))

    candidates = F.filter(_units(text), lambda u: u.rlike(pattern) & (F.size(F.split(u, " ")) >= 2))
    # the number of different bigrams is at most the number of words, so the upper bound is checked after
    with_bigrams = F.filter(
        F.transform(candidates, lambda u: F.struct(u.alias("unit"), _bigrams(u).alias("bigrams"))),
        lambda x: F.size(x["bigrams"]).between(1, most))
    matches = F.filter(F.transform(with_bigrams, compared),
                       lambda m: F.coalesce(m["dice"] >= threshold - 1e-9, F.lit(False)))
    found = F.when(F.lower(text).rlike(pattern), matches.cast(kind)).otherwise(F.array().cast(kind))
    return documents.select(F.col(id_col).alias("doc_id"), found.alias("matches"))


def licence_report(scanned: DataFrame) -> DataFrame:
    """(doc_id, licence, dice, licences, n_matches): the best match and all licences found, in name order."""
    best = F.array_min(F.transform("matches", lambda m: F.struct(
        (-m["dice"]).alias("minus"), m["licence"].alias("licence"))))
    return scanned.select(
        "doc_id", best["licence"].alias("licence"), (-best["minus"]).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))), ",").alias("licences"),
        F.size("matches").cast("long").alias("n_matches"),
    )
