"""License scans, as DataFrame and SQL operations only: sparse TF-IDF cosine to templates, then directory inheritance.

Three kinds of units are compared: every line with notices (one line as license stewards and authors word it, and
SPDX tags), every block of lines and every whole text with headers and whole licence texts. Document frequencies of
the templates' words are counted over all documents; a word outside the templates weighs as one that no document has.

The cosine of a unit with a template is at most the template's share of norm on the words they have in common. So a
line needs one of the strong words, the fewest, rarest ones without which no notice keeps a share that reaches the
threshold; and a block or text needs so many strong words of the headers and texts as the best template needs to reach
it. Texts that these exact bounds rule out are passed over in one scan. The units of the others are sparse vectors,
one row a word, joined with the templates' words (a table whose size is that of the templates) and summed.

A document that is mostly license text is a licence file of its directory. Documents without a license of their own
inherit from the nearest directory above them that has one, by joins of distinct directories.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._common import no_null, staged

#: What a unit gets that reads like a notice but names none of the licenses below.
OTHER = "NOASSERTION"

#: Fixed texts: notices of one line, by SPDX identifier.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license.", "The MIT License (MIT)", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3", "Released under the GPL 3.0 license.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2", "Released under the GPL 2.0 license.", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"),
    "BSD-2-Clause": ("BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "ISC": ("ISC License", "Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.", "CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"),
    OTHER: ("Released under the License.", "Licensed under the License.", "SPDX-License-Identifier:"),
}

#: Fixed texts: headers of source files.
HEADERS = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU Affero General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
}
THRESHOLD = 0.6
FILE_SHARE = 0.5
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
_TERM = "[a-z0-9]+(?:[.][0-9]+)*"
#: Between blocks: lines without a letter or digit, such as blank ones and empty lines of a comment.
BETWEEN = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
LINE, BLOCK, WHOLE = 0, 1, 2
#: Templates of fewer different words than these are bounded together.
SIZES = (40, 120)


def terms(text: str) -> list[str]:
    return re.findall(_TERM, text.lower())


def templates(folder: str = TEXTS) -> list[tuple[str, bool, str]]:
    """(license, whether it is a notice, text): notices, headers, and the licence texts of a folder, whole and by block.

    A text's blocks stand for themselves too, so that a part of a licence is found within another text; titles and
    other short blocks are left to the notices.
    """
    found = [(name, True, t) for name, ts in NOTICES.items() for t in ts] + [(name, False, t) for name, t in HEADERS.items()]
    for file in sorted(os.listdir(folder)):
        with open(os.path.join(folder, file), encoding="utf-8") as f:
            text = f.read()
        name = file.removesuffix(".txt")
        found.append((name, False, text))
        if len(text) < 4000:
            found += [(name, False, b) for b in re.split(r"\n\s*\n", text) if len(set(terms(b))) >= 15]
    return found


def _line_terms(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"({_TERM})"), F.lit(1))


class Weights:
    """Template vectors under inverse document frequencies, and the exact bounds that follow from them."""

    def __init__(self, counts: dict[str, int], documents: int, known: list[tuple[str, bool, str]], threshold: float) -> None:
        self.counts = counts
        self.idf = {t: math.log((1 + documents) / (1 + n)) + 1 for t, n in counts.items()}
        self.unseen = math.log(1 + documents) + 1
        self.templates = []  # (license, notice, {word: share of norm})
        for name, notice, text in known:
            v = {t: n * self.idf[t] for t, n in Counter(terms(text)).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.templates.append((name, notice, {t: x / norm for t, x in v.items()}))
        need = (threshold - 1e-9) ** 2
        self.strong = self._strongest([v for _, notice, v in self.templates if notice], need)
        #: For templates of few, some and many words: strong words, and how many of them a block or text needs at least.
        self.bounds = []
        texts = [v for _, notice, v in self.templates if not notice]
        for low, high in zip((0, *SIZES), (*SIZES, math.inf)):
            if group := [v for v in texts if low <= len(v) < high]:
                strong = self._strongest(group, need / 2)
                self.bounds.append((strong, min(self._least(v, set(strong), need) for v in group)))

    def _strongest(self, vectors: list[dict[str, float]], need: float) -> list[str]:
        """Words without which no vector keeps ``need`` of its squared norm: those that take most from the vectors that
        still do, for the documents that hold them, come first."""
        words = sorted({t for v in vectors for t in v})
        squares = np.array([[v.get(t, 0.0) ** 2 for t in words] for v in vectors]).reshape(len(vectors), len(words))
        price = 1.0 + np.array([self.counts[t] for t in words])
        left, out = np.ones(len(vectors)), []
        while (still := left >= need).any():
            k = int(np.argmax(np.minimum(squares[still], (left[still] - need + 1e-12)[:, None]).sum(0) / price))
            out.append(words[k])
            left = left - squares[:, k]
            squares[:, k] = 0.0
        return out

    @staticmethod
    def _least(vector: dict[str, float], strong: set[str], need: float) -> int:
        missing = need - sum(x * x for t, x in vector.items() if t not in strong)
        found = 0
        for x in sorted((x * x for t, x in vector.items() if t in strong), reverse=True):
            if missing <= 0:
                break
            missing -= x
            found += 1
        return max(1, found)

    def may_be_line(self, words: Column) -> Column:
        return _count_of(words, self.strong, 1)

    def may_be_text(self, words: Column) -> Column:
        out = F.lit(False)
        for strong, least in self.bounds:
            out = out | _count_of(words, strong, least)
        return out


def _count_of(words: Column, strong: list[str], least: int) -> Column:
    """Whether an array has ``least`` different words of a constant set."""
    if least == 1:
        return F.exists(words, lambda w: w.isin(strong))
    return F.size(F.array_distinct(F.filter(words, lambda w: w.isin(strong)))) >= least


def document_frequencies(docs: DataFrame, text_col: str, known: list[tuple[str, bool, str]]) -> tuple[dict[str, int], int]:
    """How many documents hold each template word, over whole texts of all documents; and how many there are."""
    vocabulary = sorted({t for _, _, text in known for t in terms(text)})
    held = F.filter(F.array_distinct(_line_terms(F.lower(no_null(text_col)))), lambda w: w.isin(vocabulary))
    counts = {r["term"]: r["n"] for r in docs.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # as many as template words
    return {t: counts.get(t, 0) for t in vocabulary}, docs.count()


def _candidates(keyed: DataFrame, weights: Weights) -> DataFrame:
    """(k1, k2, n_words, kind, unit, words) of the units that the bounds leave; keyed: k1, k2, low."""
    words = keyed.select("k1", "k2", "low", _line_terms(F.col("low")).alias("words"))
    some = words.where(weights.may_be_line(F.col("words")) | weights.may_be_text(F.col("words")))
    unit = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("unit"), x.alias("words"))
    lines = F.filter(F.transform(F.split("low", "\n"), _line_terms), weights.may_be_line)
    blocks = F.filter(F.transform(F.split("low", BETWEEN), _line_terms), weights.may_be_text)
    whole = F.filter(F.array("words"), weights.may_be_text)
    units = F.concat(F.transform(lines, unit(LINE)), F.transform(blocks, unit(BLOCK)), F.transform(whole, unit(WHOLE)))
    return some.select("k1", "k2", F.size("words").alias("n_words"), F.explode(units).alias("u")).select("k1", "k2", "n_words", "u.kind", "u.unit", "u.words")


def _scored(spark: SparkSession, units: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """(k1, k2, n_words, kind, unit, words, license, cosine): units with the licenses that reach the threshold there, by their best template."""
    idf = F.broadcast(spark.createDataFrame(sorted(weights.idf.items()), "word string, idf double"))
    shares = [(t, n, notice, x) for n, (_, notice, v) in enumerate(weights.templates) for t, x in sorted(v.items())]
    postings = F.broadcast(spark.createDataFrame(shares, "word string, template int, notice boolean, share double"))
    names = F.broadcast(spark.createDataFrame([(n, name) for n, (name, _, _) in enumerate(weights.templates)], "template int, license string"))
    keys = ["k1", "k2", "n_words", "kind", "unit"]
    counted = units.select(*keys, F.size("words").alias("words"), F.explode("words").alias("word")).groupBy(*keys, "words", "word").agg(F.count("*").alias("n"))
    weighed = counted.join(idf, "word", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(weights.unseen)))
    # a unit's words that templates hold: a list bounded by the templates' words
    vectors = weighed.groupBy(*keys, "words").agg(F.sum(F.col("w") * F.col("w")).alias("norm2"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("word", "w"))).alias("held"))
    met = vectors.select(*keys, "words", "norm2", F.explode("held").alias("h")).select(*keys, "words", "norm2", "h.word", "h.w").join(postings, "word").where(F.col("notice") == (F.col("kind") == LINE))
    cosines = met.groupBy(*keys, "words", "norm2", "template").agg(F.sum(F.col("w") * F.col("share")).alias("dot")).withColumn("cosine", F.round(F.col("dot") / F.sqrt("norm2"), 9))
    reached = cosines.where(F.col("cosine") >= threshold).join(names, "template")
    return reached.groupBy(*keys, "words", "license").agg(F.max("cosine").alias("cosine"))


def license_units(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, bool, str]] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: id, license, cosine, n_words, license_words.

    license: the one that covers most, by words times cosine over the lines, the blocks or the whole that reach the
    threshold, the most of these three; null, as n_words, if none does. cosine: the greatest of its units.
    license_words: words on lines, in blocks or in the whole that reach the threshold for any license, the most of these.

    Null texts are empty, null ids and repeated rows are each answered, an empty table gives no rows, other columns
    are not read, whatever their names. Ties go to the first license by name. Very long lines and texts are rows of
    words, nothing is compared in pairs.
    """
    known = known or templates()
    counts, n = document_frequencies(docs, text_col, known)
    weights = Weights(counts, n, known, threshold)
    low = F.lower(no_null(text_col))
    # texts go by 128 bits of hashes: equal texts are one, and are scored once
    keyed = docs.select(F.col(id_col).alias("id"), low.alias("low"), F.xxhash64(low).alias("k1"), F.xxhash64(F.lit(1), low).alias("k2"))
    # not staged: as equal texts meet, each unit lies in one partition, so that its words are summed there and never shuffled
    units = _candidates(keyed, weights).dropDuplicates(["k1", "k2", "kind", "unit"])
    scored = staged(spark, _scored(spark, units, weights, threshold), "license-scores")
    covered = scored.groupBy("k1", "k2", "license", "kind").agg(F.round(F.sum(F.col("words") * F.col("cosine")), 6).alias("covered"), F.max("cosine").alias("cosine"))
    by_license = covered.groupBy("k1", "k2", "license").agg(F.max("covered").alias("covered"), F.max("cosine").alias("cosine"))
    chosen = by_license.groupBy("k1", "k2").agg(F.min(F.struct((-F.col("covered")).alias("c"), "license", "cosine")).alias("b"))
    on = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("words")).otherwise(0))
    units_of = scored.select("k1", "k2", "n_words", "kind", "unit", "words").distinct().groupBy("k1", "k2").agg(F.first("n_words").alias("n_words"), F.greatest(on(LINE), on(BLOCK), on(WHOLE)).alias("license_words"))
    best = staged(spark, chosen.join(units_of, ["k1", "k2"]), "license-texts")
    return keyed.select("id", "k1", "k2").join(best, ["k1", "k2"], "left").select(
        "id", "n_words", F.col("b.license").alias("license"), F.col("b.cosine").alias("cosine"), F.coalesce("license_words", F.lit(0)).alias("license_words")
    )


def license_scan(
    spark: SparkSession,
    docs: DataFrame,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    known: list[tuple[str, bool, str]] | None = None,
    threshold: float = THRESHOLD,
    file_share: float = FILE_SHARE,
) -> DataFrame:
    """id, path, own_license, cosine, is_license_file, inherited_from, license for every row of ``docs``.

    path: a column expression with ``/`` between directories and the file last. own_license: that of the text, as
    ``license_units`` tells it. A licence file has at least ``file_share`` of its words in license units; of several in a
    directory the one with the greatest cosine counts, then the smallest path. license: the own one, else that of
    the nearest directory upwards, the document's own first. Null texts are empty, null paths inherit nothing;
    repeated rows stay, an empty table gives no rows, other columns are not read.
    """
    named = docs.select(F.struct(F.col(id_col).alias("id"), path.alias("path")).alias("key"), F.col(text_col).alias("text"))
    marked = license_units(spark, named, "key", "text", known, threshold).select(
        F.col("id.id").alias("id"),
        F.col("id.path").alias("path"),
        F.regexp_extract("id.path", "^(.*)/[^/]*$", 1).alias("dir"),
        F.col("license").alias("own_license"),
        "cosine",
        F.coalesce(F.col("license").isNotNull() & (F.col("license_words") >= file_share * F.col("n_words")), F.lit(False)).alias("is_license_file"),
    )
    marked = staged(spark, marked, "licenses")
    files = (
        marked.where("is_license_file and path is not null")
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", F.col("own_license").alias("l"))).alias("file"))
        .select("dir", F.col("file.l").alias("given"))
    )
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(F.array_join(F.slice(steps, 1, k), "/").alias("up"), k.alias("depth")))
    chain = marked.where("path is not null").select("dir").distinct().select(F.col("dir").alias("below"), F.explode(above).alias("a")).select("below", "a.up", "a.depth")
    nearest = (
        chain.join(files, F.col("up") == F.col("dir"))
        .groupBy("below")
        .agg(F.max(F.struct("depth", "up", "given")).alias("n"))
        .select("below", F.col("n.up").alias("up"), F.col("n.given").alias("given"))
    )
    joined = marked.join(nearest, F.col("dir") == F.col("below"), "left")
    inherits = F.col("own_license").isNull() & F.col("path").isNotNull()
    return joined.select(
        "id",
        "path",
        "own_license",
        "cosine",
        "is_license_file",
        F.when(inherits, F.col("up")).alias("inherited_from"),
        F.coalesce("own_license", F.when(inherits, F.col("given"))).alias("license"),
    )
