"""Licence scans: passages compared with licence templates by Dice over word bigrams (DataFrame functions only)."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import let, text_or_empty
from tickloom.session import stage

#: The wording of common public licences and notices.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim "
        "that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
        "altered from any source distribution."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details."
    ),
    "BSD-3-Clause-notice": "Redistribution is permitted under the BSD 3-Clause License.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}

#: Least Dice coefficient of a passage and a template.
THRESHOLD = 0.9


def words_of(text: Column) -> Column:
    """Normalised words: lower case, everything but letters, digits and inner dots parts words."""
    plain = F.regexp_replace(F.lower(text), r"\.(?![\p{L}\p{N}])|[^\p{L}\p{N}.]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    """Word bigrams; a single word is its own."""

    def pairs(ws: Column) -> Column:
        two = F.transform(F.slice(ws, F.lit(1), F.size(ws) - 1), lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1)))
        return F.when(F.size(ws) < 2, ws).otherwise(two)

    return let(words, pairs)


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Bigram counts a passage may have to reach the threshold with a template of n bigrams."""
    slack = 1e-9
    return math.ceil(threshold / (2 - threshold) * n - slack), math.floor((2 - threshold) / threshold * n + slack)


def anchors(grams: Counter, threshold: float) -> list[str]:
    """Bigrams of which a passage over the threshold has at least one: the longest, as the rarest in prose.

    It shares at least threshold / (2 - threshold) of the template's bigrams, so no more than the
    rest can be missing.
    """
    n = sum(grams.values())
    missing, out = n - bounds(n, threshold)[0], []
    for gram in sorted(grams, key=lambda g: (-len(g), g)):
        out.append(gram)
        missing -= grams[gram]
        if missing < 0:
            break
    return out


def passages(docs: DataFrame, limit: int) -> DataFrame:
    """Lines, paragraphs and whole texts of at most ``limit`` blank-separated words, each once per document."""
    text = text_or_empty("text")
    parts = F.array_distinct(F.concat(F.split(text, r"\r?\n"), F.split(text, r"\r?\n[ \t]*\r?\n"), F.array(text)))
    rows = docs.select("doc_id", F.xxhash64(text).alias("hash"), F.posexplode(parts).alias("at", "passage"))
    return rows.where(F.regexp_count("passage", F.lit(r"\S+")) <= limit)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The licence found in each row of ``docs`` (``doc_id``, ``text``).

    Columns: ``doc_id``, ``license`` (best template, or null), ``dice`` (of its best passage) and
    ``n_passages`` that match any template. A passage is a line, a paragraph or the whole text;
    text runs into no passage across a blank line unless it is the whole. Sizes bound the
    passages that can reach ``threshold``, and of each template some bigrams must occur; what is left is
    compared exactly (bigrams count as often as they occur). Equal coefficients go to the name
    first in order.

    Null and empty texts match nothing. Rows that share id and text get the same result each. An
    empty table gives an empty result, and other columns are ignored. The templates are a fixed, small
    list; their bigrams are the only thing sent to every task.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    source = spark.createDataFrame(list(templates.items()), "license string, body string")
    # A few hundred words, normalised by the same expressions as the passages.
    grams = {r["license"]: Counter(r["grams"]) for r in source.select("license", bigrams_of(words_of(F.col("body"))).alias("grams")).collect()}
    sizes = {k: sum(v.values()) for k, v in grams.items()}
    keys = sorted({g for v in grams.values() for g in anchors(v, threshold)})
    most = max(bounds(n, threshold)[1] for n in sizes.values())
    # Only what can be near a template is kept of the grams, so that they are worked out once.
    fits = lambda g: F.when(F.size(g).between(1, most) & F.exists(g, lambda x: x.isin(*keys)), g)
    parts = passages(docs, most + 1).select("doc_id", "hash", "at", let(bigrams_of(words_of(F.col("passage"))), fits).alias("grams"))
    likely = parts.where("grams is not null")
    likely = stage(likely.groupBy("doc_id", "hash", "at").agg(F.first("grams").alias("grams")), "licence-passages")
    index = spark.createDataFrame(
        [(k, sizes[k], *bounds(sizes[k], threshold), g, n) for k, v in grams.items() for g, n in v.items()],
        "license string, size int, low int, high int, gram string, times int",
    )
    own = likely.select("doc_id", "hash", "at", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    own = own.groupBy("doc_id", "hash", "at", "n", "gram").agg(F.count(F.lit(1)).alias("c"))
    met = own.join(F.broadcast(index), "gram").where(F.col("n").between(F.col("low"), F.col("high")))
    scored = met.groupBy("doc_id", "hash", "at", "license", "n", "size").agg(F.sum(F.least("c", "times")).alias("shared"))
    scored = scored.withColumn("dice", 2.0 * F.col("shared") / (F.col("n") + F.col("size"))).where(F.col("dice") >= threshold - 1e-12)
    best = scored.groupBy("doc_id", "hash").agg(
        F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("b"), F.countDistinct("at").alias("n_passages")
    )
    best = best.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.col("b.license").alias("license"),
                       (-F.col("b.d")).alias("dice"), "n_passages")
    rows = docs.select("doc_id", F.xxhash64(text_or_empty("text")).alias("hash"))
    return rows.join(best, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left").select(
        "doc_id", "license", "dice", F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages")
    )
