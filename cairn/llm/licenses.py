"""License notices in documents.

DataFrame expressions only. Texts and notices are cut into overlapping windows of words, and each
window's set of five-word shingles into ``BANDS`` MinHash bands of ``ROWS`` minima. A window of a text
retrieves the notices that have a window with an equal band: with probability 1 - (1 - J**2)**12 at
similarity J, that is 0.97 at one half, 0.9999 at 0.75 and for certain at 1.

Long notices have windows of twelve words at every word, texts have them at every fourth word and at
their end: wherever fifteen words of a notice stand unchanged, a window of the text is one of the
notice's. Notices of five to fourteen words have windows of six words, texts have them at every word,
with ``BANDS`` bands of one minimum: one of six words or more is retrieved for certain where six words stand
unchanged, one of five words, a single shingle, is missed with a probability of 4e-7.

Retrieved notices are then verified: of a notice's shingles, the share that stands in the
stretch of text around the windows that retrieved it, exactly, must reach ``LEAST_CONTAINED`` per cent.

A band of a window can only equal a notice's if its least shingles are the notice's too. So texts that share
no shingle with any notice, all but a few, are told apart first, by a join with the notices' shingles, and are not banded.

A notice of fewer than five words is one shingle of its own length and is found where it stands
whole; texts are cut at the lengths that such notices have.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import materialize, small_side

SHINGLE, BANDS, ROWS, LEAST_CONTAINED = 5, 12, 2, 75
#: Words of a long notice's windows, and words from one window of a text to the next; notices of under both together are short.
LONG, STRIDE = 12, 4
MASKS = [int(m) for m in np.random.default_rng(11).integers(-(1 << 63), 1 << 63, BANDS * ROWS)]

#: Notices by which texts are licensed, by SPDX identifier.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The MIT License (MIT) Copyright (c)",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "Eclipse Public License, Version 2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}
#: Notices of fewer than five words.
SHORT_TEMPLATES = {"All-rights-reserved": ["All rights reserved."], "MIT": ["MIT License Copyright (c)"], "CC0-1.0": ["CC0 1.0 Universal"]}
#: Identifiers that stand in tags of the form ``SPDX-License-Identifier: MIT``.
TAGGED = "MIT Apache-2.0 GPL-3.0 GPL-2.0 LGPL-3.0 LGPL-2.1 AGPL-3.0 BSD-3-Clause BSD-2-Clause CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC0-1.0 MPL-2.0 ISC BSL-1.0 Unlicense Zlib EPL-2.0".split()


def templates(spark: SparkSession) -> DataFrame:
    """``(license, notice, text)``: the built-in notices; any table of this form can take their place."""
    rows = [(name, i, text) for name, texts in [*TEMPLATES.items(), *SHORT_TEMPLATES.items()] for i, text in enumerate(texts)]
    rows += [(name, -1, f"SPDX-License-Identifier: {name}") for name in TAGGED]
    return spark.createDataFrame(rows, "license string, notice int, text string")


def _hashed(text: Column) -> Column:
    """Hashes of the words: runs of letters and digits, lower-cased."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingled(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the array ``shingles`` in place of ``text``; none where there are fewer than five words."""
    keep = [c for c in rows.columns if c != text]
    hashed = rows.select(*keep, _hashed(F.col(text)).alias("_h"))
    runs = F.transform(F.sequence(F.lit(0), F.size("_h") - SHINGLE), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(SHINGLE)]))
    return hashed.withColumn("shingles", F.when(F.size("_h") >= SHINGLE, runs).otherwise(F.array().cast("array<bigint>"))).drop("_h")


def _keys(windows: DataFrame, columns: list[str], rows: int, *keep: str) -> DataFrame:
    """A row per window and band, ``key``: a hash of the band's minima over the window's shingles, its ``columns``.

    Windows are rows by now, so the bands' arithmetic is compiled. The order of hashes after XOR with a
    random mask is a permutation whose least element is any of them alike.
    """
    least = lambda m: F.least(*[F.col(c).bitwiseXOR(F.lit(m)) for c in columns]) if len(columns) > 1 else F.col(columns[0]).bitwiseXOR(F.lit(m))
    bands = [F.xxhash64(F.lit(b), F.lit(rows), *[least(MASKS[b * rows + r]) for r in range(rows)]) for b in range(BANDS)]
    return windows.select(*keep, F.explode(F.array(*bands)).alias("key"))


def _short_keys(shingled: DataFrame, *keep: str) -> DataFrame:
    """Keys of the windows of six words, at every word; a text's only shingle is a window alone.

    The outer explode keeps the optimizer from evaluating the array a second time.
    """
    second = F.slice(F.col("shingles"), F.lit(2), F.greatest(F.size("shingles") - 1, F.lit(1)))
    windows = shingled.select(*keep, F.size("shingles").alias("n"), F.posexplode_outer(F.arrays_zip(F.col("shingles").alias("x"), second.alias("y"))).alias("at", "s"))
    real = windows.where("s.x is not null and (s.y is not null or n = 1)").select(*keep, F.col("s.x").alias("x"), F.coalesce("s.y", "s.x").alias("y"))
    return _keys(real, ["x", "y"], 1, *keep)


def _long_keys(shingled: DataFrame, stride: int, *keep: str) -> DataFrame:
    """Keys of the windows of ``LONG`` words, at every ``stride``-th word and at the end."""
    n = LONG - SHINGLE + 1
    last = F.size("shingles") - n
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))
    runs = F.when(F.size("shingles") >= n, F.transform(starts, lambda i: F.slice("shingles", i + 1, F.lit(n))))
    windows = shingled.select(*keep, F.explode_outer(runs).alias("s")).where("s is not null").select(*keep, *[F.get("s", F.lit(k)).alias(f"s{k}") for k in range(n)])
    return _keys(windows, [f"s{k}" for k in range(n)], ROWS, *keep)


def _short_runs(rows: DataFrame, text: str, lengths: list[int], *keep: str) -> DataFrame:
    """A row per word and length, ``key``: the run of that many words from word ``at`` on."""
    hashed = rows.select(*keep, _hashed(F.col(text)).alias("h"))
    nth = [F.slice("h", k + 1, F.greatest(F.size("h") - k, F.lit(0))).alias(f"w{k}") for k in range(max(lengths))]
    windows = hashed.select(*keep, F.posexplode_outer(F.arrays_zip(*nth)).alias("at", "s")).where("s.w0 is not null")
    runs = [F.when(F.col(f"s.w{n - 1}").isNotNull(), F.xxhash64(F.lit(n), *[F.col(f"s.w{k}") for k in range(n)])) for n in lengths]
    return windows.select(*keep, "at", F.explode(F.array(*runs)).alias("key")).where("key is not null")


def _with_known(named: DataFrame, known: DataFrame) -> DataFrame:
    """The texts that share a shingle with a notice, as rows of their own in the shared folder."""
    shingles = small_side(materialize(known.select(F.explode("wanted").alias("s")).distinct(), "license-shingles"), 16)
    each = _shingled(named, "text").select("doc_id", "version", F.explode_outer("shingles").alias("s")).where("s is not null")
    ids = materialize(each.join(shingles, "s", "left_semi").select("doc_id", "version").distinct(), "license-texts")
    return materialize(named.join(small_side(ids, 24), ["doc_id", "version"], "left_semi"), "license-bodies")


def license_matches(docs: DataFrame, notices: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, license, containment, at_word)`` per document and license found in it.

    ``notices`` has (license, notice, text). containment is that of the license's best notice, at_word
    where the stretch that holds it begins, in words. Notices of under five words must stand whole.
    Notices and texts that are null or without words match nothing; rows without doc_id can't be
    reported. Rows that repeat a doc_id are searched each, and reported once; of stretches that contain as
    much, the first counts. Empty tables give no rows; other columns are ignored. A text costs some 100
    bytes a word while its row is worked on.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null").withColumn("version", F.xxhash64("text"))
    words = notices.select("license", "text").withColumn("length", F.size(_hashed(F.col("text"))))
    short = materialize(words.where(F.col("length").between(1, SHINGLE - 1)), "license-short")
    lengths = sorted(r[0] for r in short.select("length").distinct().collect())  # under five
    known = _shingled(notices.select("license", "notice", "text"), "text").withColumn("wanted", F.array_distinct("shingles"))
    known = materialize(known.where(F.size("wanted") > 0), "license-notices")
    is_long = F.size("shingles") >= LONG + STRIDE - SHINGLE
    with_any = _with_known(named, known)
    shingled, found = _shingled(with_any, "text"), []
    for keys_of, own in ((lambda x, *keep: _long_keys(x, 1 if "license" in keep else STRIDE, *keep), known.where(is_long)), (_short_keys, known.where(~is_long))):
        index = materialize(keys_of(own, "license", "notice").distinct(), "license-index")
        if index.take(1):
            found.append(keys_of(shingled, "doc_id", "version").join(small_side(index, 60), "key").select("doc_id", "version", "license", "notice"))
    found = materialize(reduce(DataFrame.unionByName, found, named.limit(0).selectExpr("doc_id", "version", "'' as license", "0 as notice")).distinct(), "license-candidates")

    ids = small_side(found.select("doc_id").distinct(), 16)
    texts = _shingled(with_any.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "version"]), "text")
    both = found.join(texts, ["doc_id", "version"]).join(known.select("license", "notice", "wanted"), ["license", "notice"])
    # where the notice's shingles stand, and of these the most that fit one stretch of its length and a half
    at = both.withColumn("hits", F.filter(F.transform("shingles", lambda s, i: F.when(F.array_contains("wanted", s), F.struct(i.alias("i"), s.alias("s")))), lambda h: h.isNotNull()))
    reach = (F.size("wanted") * 3 / 2 + SHINGLE).cast("int")
    stretch = lambda h, k: F.filter(F.slice("hits", k + 1, reach), lambda g: g["i"] < h["i"] + reach)
    inside = F.transform("hits", lambda h, k: F.struct(F.size(F.array_distinct(F.transform(stretch(h, k), lambda g: g["s"]))).alias("n"), (-h["i"]).alias("i")))
    best = at.withColumn("best", F.array_max(inside)).withColumn("containment", F.col("best.n") / F.size("wanted"))
    enough = best.where(F.col("best.n") * 100 >= F.size("wanted") * LEAST_CONTAINED)
    enough = enough.select("doc_id", "license", "containment", F.col("best.i").alias("i"))
    if lengths:
        wanted = [_short_runs(short.where(F.col("length") == n), "text", [n], "license").select("license", "key") for n in lengths]
        index = small_side(materialize(reduce(DataFrame.unionByName, wanted).distinct(), "license-short-index"), 60)
        stands = _short_runs(named, "text", lengths, "doc_id").join(index, "key").groupBy("doc_id", "license").agg((-F.min("at")).alias("i"))
        enough = enough.unionByName(stands.select("doc_id", "license", F.lit(1.0).alias("containment"), "i"))
    top = enough.groupBy("doc_id", "license").agg(F.max(F.struct("containment", "i")).alias("b"))
    return top.select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.i")).cast("long").alias("at_word"))
