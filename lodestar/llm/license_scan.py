"""License scans: MinHash bands over overlapping word windows, then exact shingle containment.

Each template is met by windows of its own size: a window is a quarter longer than the template, and
windows start a quarter of the template's length apart, so every stretch of text as long as the template
lies in a window. A window's MinHash values of five-word shingles are bands of one value; containment
0.8 in such a window means a Jaccard similarity of 0.4 or more, and 24 bands meet with a probability of
at least 1 - 0.6 ** 24, over 0.99999. What meets is verified by the exact share of the template's
shingles that the window holds. Windows are only taken where a marker word stands. Markers follow from
the templates, built in or given: so many of each one's shingles hold a marker that no window without
one can reach the containment.

Built-in expressions only; templates are a list of bounded size, broadcast as such.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let

WIDTH, CONTAINMENT, BANDS = 5, 0.8, 24
#: Shingles of all templates together, up to which they are broadcast.
MOST_SHINGLES = 1_000_000
#: Texts, file headers and notices of public licences.
TEMPLATES = {
    "agpl-3.0": "licensed under the GNU Affero General Public License version 3",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "licensed under the Apache License version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-3-clause-clauses": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-licence": "released under the BSD license",
    "bsd-licensed": "licensed under the BSD license",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "cc-by-4.0": "licensed under CC BY 4.0",
    "cc-by-nc-4.0": "licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "licensed under CC BY-SA 4.0",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0": "This work is licensed under the GNU General Public License version 2",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License version 3",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "lgpl-2.1": "licensed under the GNU Lesser General Public License version 2.1",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "released under the MIT License",
    "mit-licensed": "licensed under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "warranty": "the software is provided as is without warranty of any kind express or implied",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def grams_of(text: str) -> set[tuple[str, ...]]:
    words = words_of(text)
    return {tuple(words[k : k + WIDTH]) for k in range(len(words) - WIDTH + 1)}


def markers_of(templates: dict[str, str], least: float = CONTAINMENT) -> list[str]:
    """Words of which every window that holds ``least`` of a template's shingles has one.

    For each template long words are taken that stand in many of its shingles, since long ones are rare, until
    too few shingles are left without a marker. A template without a shingle is left out.
    """
    found: set[str] = set()
    for name in sorted(templates):
        grams = grams_of(templates[name])
        rest = [g for g in grams if not found.intersection(g)]
        while grams and len(rest) >= least * len(grams):
            words = {w for g in rest for w in g}
            best = max(words, key=lambda w: (len(w) ** 3 * sum(w in g for g in rest), w))  # noqa: B023
            found.add(best)
            rest = [g for g in rest if best not in g]
    return sorted(found)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda x: x != "")


def _shingles(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n < WIDTH, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - (WIDTH - 1), F.lit(1))), lambda k: F.xxhash64(F.slice(tokens, k, WIDTH)))))


def _bands(shingles: Column) -> Column:
    """Band numbers folded into the least values of as many hash orders."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda j: F.xxhash64(j, F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, j)))))


def template_table(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """template, size, its shingles and bands: one row for each band of each template that has a shingle."""
    spark = docs.sparkSession
    rows = [(name, len(words_of(text)), text) for name, text in templates.items() if grams_of(text)]
    table = spark.createDataFrame(rows, T.StructType([T.StructField("template", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("t", T.StringType())]))
    with_own = table.select("template", "size", _shingles(_tokens(F.col("t"))).alias("own"))
    return with_own.select("template", "size", "own", F.explode(_bands(F.col("own"))).alias("band"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = CONTAINMENT) -> DataFrame:
    """(doc_id, template, containment, first_word): each template found, at its best window, the first of equals.

    ``first_word`` is where that window begins. Null and empty texts hold nothing; a null doc_id stays
    null; rows that repeat an id are taken together. A template of fewer than five words has no shingle
    and is never found.
    """
    if sum(len(grams_of(t)) for t in templates.values()) > MOST_SHINGLES:
        raise ValueError(f"templates may hold {MOST_SHINGLES} shingles at most, as they are broadcast")
    text, markers = F.col("text").cast("string"), markers_of(templates, least)
    marked = let(F.lower(text), lambda low: reduce(lambda a, m: a | F.contains(low, F.lit(m)), markers, F.lit(False)))
    rows = docs.where(marked).select(F.col("doc_id").cast("long").alias("doc_id"), _tokens(text).alias("w"))
    spots = F.filter(F.transform("w", lambda x, k: F.when(x.isin(*markers) if markers else F.lit(False), k)), lambda k: k.isNotNull())
    windows = [F.array().cast("array<struct<size:int,start:int,span:int>>")]
    for size in sorted({len(words_of(t)) for t in templates.values() if grams_of(t)}):
        step = max(1, size // 4)
        span = size + step
        starts = lambda p: F.sequence(F.greatest(F.lit(0), F.floor((p - span) / step).cast("int") + 1), F.floor(p / step).cast("int"))  # noqa: B023, E731
        windows.append(F.transform(F.array_distinct(F.flatten(F.transform("p", starts))), lambda k: F.struct(F.lit(size).alias("size"), (k * step).alias("start"), F.lit(span).alias("span"))))  # noqa: B023
    cut_out = (
        rows.select("doc_id", "w", spots.alias("p"))
        .where(F.size("p") > 0)
        .select("doc_id", "w", F.explode(F.concat(*windows)).alias("x"))
        .select("doc_id", "x.size", F.col("x.start").cast("long").alias("start"), _shingles(F.slice("w", F.col("x.start") + 1, F.col("x.span"))).alias("sh"))
        .where(F.size("sh") > 0)
        .select("doc_id", "size", "start", "sh", F.explode(_bands(F.col("sh"))).alias("band"))
    )
    met = cut_out.join(F.broadcast(template_table(docs, templates)), ["size", "band"])
    share = F.size(F.array_intersect("sh", "own")) / F.size("own")
    found = met.select("doc_id", "template", "start", share.alias("containment")).where(F.col("containment") >= least)
    best = F.max(F.struct("containment", (-F.col("start")).alias("s")))
    return found.groupBy("doc_id", "template").agg(best.alias("b")).select("doc_id", "template", F.col("b.containment").alias("containment"), (-F.col("b.s")).alias("first_word"))


def oracle_sql() -> str:
    """The same by counting shingles in all windows: without markers, bands or hashes."""
    values = ", ".join(f"('{name}', '{' '.join(words_of(text))}')" for name, text in TEMPLATES.items())
    return f"""
WITH t AS (SELECT name, string_split(body, ' ') AS ws FROM (VALUES {values}) v(name, body)),
o AS (SELECT name, len(ws) AS n, greatest(1, len(ws) // 4) AS step, unnest(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')))) AS g FROM t),
own AS (SELECT name, count(*) AS total FROM o GROUP BY name),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, p - 1 AS p, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
h AS (SELECT doc_id, name, s.g, n, step, unnest(range(CAST(greatest(0, ceil((p + 5 - n - step) / step)) AS BIGINT), CAST(floor(p / step) AS BIGINT) + 1)) * step AS start FROM s JOIN o ON s.g = o.g),
c AS (SELECT doc_id, h.name, start, count(DISTINCT g)::DOUBLE / any_value(total) AS c FROM h JOIN own ON h.name = own.name GROUP BY ALL)
SELECT doc_id, name AS template, max(c) AS containment, arg_max(start, {{'c': c, 's': -start}})::BIGINT AS first_word FROM c WHERE c >= 0.8 GROUP BY doc_id, name
"""
