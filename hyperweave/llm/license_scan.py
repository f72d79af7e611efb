"""License scans: MinHash bands over overlapping text windows, then exact shingle containment. DataFrame operations only.

A template's shingles are its runs of five words. Texts are cut into windows of shingles, twice as wide as the
template's (rounded up to a power of two) and overlapping by half, so that every run as long as a template lies in one
window whole. A window and a template meet where one of ``BANDS`` MinHash values is the same. A window that holds 80 %
of a template has a Jaccard similarity of 0.19 or more with it (at most 4 times its shingles, and a fifth missing):
the chance to miss all bands is at most 0.81 ** 64, about one in a million. What meets is verified exactly, at the first
of the bands in which it does.

A band's value is one of the template's shingles' hashes, so only windows that hold some template's shingle can meet
any. A Bloom filter of the templates' shingles, a literal of 32 to 64 bits for each, leaves others out before MinHash;
what passes by chance costs work and changes no result.

Scale: one narrow stage up to the matches, which are few and are pre-aggregated; the work for a text is linear in its
length for each width of windows (a power of two, so few) and hardly depends on the number of templates. Templates are
a parameter: their bands (64 rows each) and their shingles (once each) are broadcast up to ``BROADCAST_SHINGLES``, which
is counted (at most 32 MB of shingles), and joined by shuffle beyond it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.llm.common import table

# Notices by which licenses are declared, headers of source files, and bodies of short licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
SHINGLE_WORDS, PER_CENT, BANDS, BROADCAST_SHINGLES = 5, 80, 64, 1 << 22
SHIFTS = (0, 13, 26, 39)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")


def shingle_hashes(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the hashes of its text's shingles in place of the text.

    Exploding an array of one keeps the words, and then the hashes, from being computed anew wherever they are used."""
    kept = [c for c in df.columns if c != text]
    worded = df.select(*kept, F.explode(F.array(word_list(F.col(text)))).alias("words"))
    n = F.size("words") - SHINGLE_WORDS + 1
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("words"), i + j) for j in range(SHINGLE_WORDS)]))
    return worded.select(*kept, F.explode(F.array(hashes)).alias(name))


def signature(shingles: Column) -> Column:
    """One long for each band: its number and the smallest hash under its seed."""

    def band(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), F.array_min(F.transform(shingles, lambda s: F.xxhash64(F.lit(seed), s))))

    return F.array(*map(band, range(BANDS)))


def window_words(shingles: int) -> int:
    """Width, in shingles, of the windows for a template of so many."""
    return 2 * (1 << max(0, shingles - 1).bit_length())


def bitmap(shingles: list[int]) -> list[int]:
    """Longs of 64 bits each, a power of two of them: a Bloom filter in which a shingle sets the bits that its bits from
    each of ``SHIFTS`` on number. At 32 to 64 bits a shingle, one other shingle in 5 000 to 70 000 finds all its bits set."""
    size = max(1024, 1 << (32 * max(1, len(shingles)) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    for shift in SHIFTS:
        bits[(np.array(shingles, np.int64) >> shift) & (size - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def maybe_known(bits: list[int]) -> Callable[[Column], Column]:
    """A test of an array of shingles: whether one of them has all its bits set; mostly the first bit decides."""
    held = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")  # folded to one literal

    def known(s: Column) -> Column:
        places = [F.shiftright(s, shift) for shift in SHIFTS]
        tests = [F.getbit(F.get(held, F.shiftright(x, 6).bitwiseAND(F.lit(len(bits) - 1)).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")) == 1 for x in places]
        return functools.reduce(lambda x, y: x & y, tests)

    return lambda shingles: F.exists(shingles, known)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, n_windows, first_word, containment): a row for each document and template that it holds.

    ``n_windows``: windows with 80 % or more of the template's distinct shingles; ``first_word``: where the first of
    them begins (from 0); ``containment``: the largest share. Null, empty and short texts hold nothing; a null id is
    an id; repeated rows count once; long texts are read whole; other columns are not read. A template must have five
    words or more, a name given twice is one license with several templates: its windows are those of any of them, and
    its better match counts.
    """
    spark = docs.sparkSession
    values = ", ".join(f"({i}, " + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in t) + ")" for i, t in enumerate(templates))
    listed = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, license, notice)") if templates else spark.sql("SELECT 0 AS template, '' AS license, '' AS notice WHERE false")
    listed = shingle_hashes(listed, "notice", "own").select("template", "license", F.array_distinct("own").alias("own"))
    known = [r[0] for r in listed.select("own").collect()]  # as large as the parameter
    if not all(known):
        raise ValueError("a template has fewer than five words")
    total = sum(map(len, known))
    small = F.broadcast if max(total, BANDS * len(known)) <= BROADCAST_SHINGLES else lambda df: df
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    candidate = maybe_known(bitmap(sorted({v for own in known for v in own})))
    worded = shingle_hashes(texts, "text", "shingles").where(candidate(F.col("shingles")))
    widths = sorted({window_words(len(own)) for own in known})
    cut = lambda w: F.filter(
        F.transform(F.sequence(F.lit(1), F.size("shingles"), F.lit(w // 2)), lambda s: F.struct(F.lit(w).alias("width"), (s - 1).alias("first"), F.array_distinct(F.slice("shingles", s, F.lit(w))).alias("held"))),
        lambda x: candidate(x["held"]),
    )
    windows = worded.select("doc_id", F.explode(F.flatten(F.array(*map(cut, widths))) if widths else F.array().cast("array<struct<width:int,first:int,held:array<bigint>>>")).alias("window"))
    signed = windows.select("doc_id", "window", F.explode(F.array(signature(F.col("window.held")))).alias("signs"))
    meeting = signed.select("doc_id", "window", "signs", F.explode("signs").alias("band"))
    width = F.lit(0)
    for w in reversed(widths):
        width = F.when(F.size("own") <= w // 2, w).otherwise(width)
    described = listed.select("template", "license", "own", width.alias("width"), signature(F.col("own")).alias("own_signs"))
    bands = described.select("template", "width", F.explode("own_signs").alias("band"))
    met = meeting.join(small(bands), (meeting["band"] == bands["band"]) & (F.col("window.width") == bands["width"])).select("doc_id", "window", "signs", meeting["band"], "template")
    found = met.join(small(described.select("template", "license", "own", "own_signs")), "template")
    found = found.where(F.get(F.array_intersect("signs", "own_signs"), F.lit(0)) == F.col("band"))
    share = F.size(F.array_intersect("window.held", "own")) / F.size("own")
    matches = found.select("doc_id", "license", "window.width", "window.first", share.alias("share")).where(F.col("share") * 100 >= PER_CENT)
    once = matches.groupBy("doc_id", "license", "width", "first").agg(F.max("share").alias("share"))
    return once.groupBy("doc_id", "license").agg(F.count("*").alias("n_windows"), F.min("first").alias("first_word"), F.max("share").alias("containment"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: licenses that documents declare."""
    return scan_licenses(table(spark, sf_dir, "documents"), list(TEMPLATES))


def _words_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), lambda w: w <> '')"


OP6_SQL = f"""
WITH templates(template, license, notice) AS (VALUES {", ".join(str((i, *t)) for i, t in enumerate(TEMPLATES))}),
tw AS (SELECT template, license, {_words_sql("notice")} AS w FROM templates),
ts AS (SELECT DISTINCT template, license, array_to_string(w[i : i + 4], ' ') AS shingle FROM tw, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
tn AS (SELECT template, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS stride FROM ts GROUP BY template),
dw AS (SELECT DISTINCT doc_id, {_words_sql("text")} AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS i, array_to_string(w[i : i + 4], ' ') AS shingle FROM dw, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
hits AS (SELECT doc_id, template, license, stride, n, i, shingle FROM ds JOIN ts USING (shingle) JOIN tn USING (template)),
held AS (SELECT doc_id, template, license, stride, n, (i // stride - back) * stride AS first, shingle FROM hits, (VALUES (0), (1)) AS b(back) WHERE i // stride >= back),
windows AS (SELECT doc_id, template, license, stride, first, count(DISTINCT shingle)::DOUBLE / n AS share FROM held GROUP BY doc_id, template, license, stride, first, n),
once AS (SELECT doc_id, license, stride, first, max(share) AS share FROM windows WHERE share * 100 >= {PER_CENT} GROUP BY doc_id, license, stride, first)
SELECT doc_id, license, count(*) AS n_windows, CAST(min(first) AS INTEGER) AS first_word, max(share) AS containment
FROM once GROUP BY doc_id, license
"""
