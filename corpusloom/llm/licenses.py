"""Licence scan: TF-IDF cosine to templates, then inheritance along paths.

*Passages.* Every line of a file that holds a cue word is a passage, and so is
every block of comment lines that holds one, its lines joined, as notices are
wrapped; a file whose name says that it is a licence file is one more passage as a
whole.
*Vectors.* Terms are lower-case words and numbers. A term's IDF comes from all
passages, ``ln((1 + N) / (1 + df)) + 1``. Vectors are rows (passage, term,
weight); joined with the templates' weights of the term, they are summed to the
passage's length and its dot product with each template. The most similar
template names the passage's licence if the cosine is at least ``THRESHOLD``,
and a file takes the licence of its best passage (ties: the first name).
*Inheritance.* A licence file speaks for its directory (several: the most
similar, then the first name). A file without a licence of its own takes that
of the nearest directory above it that has one: the distinct directories are
joined, by their ancestors, with those that have a licence, and the files with
the result.

Templates are a short fixed list, so their terms may be broadcast: notices, the
identifiers that SPDX lines name, and the bodies of short licences. Terms,
directories and paths are looked up by joins that salt hot keys: every notice
holds the same words, and the root is above every directory. All texts
are scanned whole. Null or empty text has no passage, a null path no directory;
repeated rows are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import let
from corpusloom.operators.joins import lookup_join
from corpusloom.sources.staging import stage

THRESHOLD = 0.7
CUES = "(?i)licen[cs]|copyright|copyleft|public domain|rights reserved|spdx|hereby granted|redistribution"
LICENCE_FILE = "(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"
TERM = "[\\p{L}\\p{N}]+(?:[.-][\\p{L}\\p{N}]+)*"
# what a comment line begins with, and two or more such lines
MARK = "[ \\t]*(?:#+|//+|/\\*+|\\*+/?|--+|;+|%+|<!--)"
BLOCK = f"(?m)(?:^{MARK}[^\\n]*(?:\\n|\\z)){{2,}}"

# fixed values: wording of notices by licence name
NOTICES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Released under the BSD License."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

# fixed values: SPDX identifiers by licence name
IDENTIFIERS = {
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "Apache-2.0": ("Apache-2.0",),
    "BSD": ("BSD-2-Clause", "BSD-3-Clause"),
    "CC-BY-4.0": ("CC-BY-4.0",),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0",),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0",),
    "CC0-1.0": ("CC0-1.0",),
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "ISC": ("ISC",),
    "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "MIT": ("MIT",),
    "MPL-2.0": ("MPL-2.0",),
    "Unlicense": ("Unlicense",),
}

# fixed values: bodies of short licences
BODIES = (
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)
TEMPLATES = (
    *NOTICES,
    *((name, f"SPDX-License-Identifier: {i}") for name, ids in IDENTIFIERS.items() for i in ids),
    *BODIES,
)


def directory_of(path: Column) -> Column:
    """Path without its last name; the empty string is the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def passages(files: DataFrame) -> DataFrame:
    """``path, line, text``: lines with a cue, blocks of comment lines with one (line
    -2 and below), and licence files whole (line -1). Equal paths count as one file
    with several texts."""
    cued = files.where(F.col("path").isNotNull() & F.col("text").rlike(CUES))
    lines = cued.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.col("text").rlike(CUES))
    possessive = BLOCK + "+"  # a long block must not recurse
    blocks = F.regexp_extract_all("text", F.lit(possessive), F.lit(0))
    commented = cued.select("path", F.posexplode(blocks).alias("at", "text")).select(
        "path", (-2 - F.col("at")).alias("line"),
        F.regexp_replace(F.regexp_replace("text", f"(?m)^{MARK}", " "), "\\n", " ").alias("text"),
    ).where(F.col("text").rlike(CUES))
    whole = files.where(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE) & F.col("text").isNotNull())
    return lines.union(commented).union(whole.select("path", F.lit(-1).alias("line"), "text"))


def _counted(terms: Column) -> Column:
    """Different terms of a text with their counts, as runs of the sorted terms."""

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (ordered[i] != F.get(ordered, i - 1))
        )
        return let(
            starts,
            lambda at: F.transform(at, lambda i, k: F.struct(
                F.xxhash64(ordered[i]).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).alias("tf")
            )),
        )

    none = F.array().cast("array<struct<term: bigint, tf: int>>")
    return let(F.sort_array(terms), lambda s: F.when(F.size(s) == 0, none).otherwise(runs(s)))


def similarities(found: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``path, line, license, score``: the closest template of each passage that
    shares a term with one. Passages go by a number and terms by a 64-bit hash,
    so that no text is shuffled."""
    spark = found.sparkSession
    numbered = stage(found.withColumn("id", F.monotonically_increasing_id()))
    terms = numbered.select("id", F.inline(_counted(_terms(F.col("text")))))
    total = F.lit(float(numbered.count()))
    rarity = terms.groupBy("term").agg((F.log((1 + total) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))

    listed = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(templates)], "template int, wording string")
    own = listed.select("template", F.inline(_counted(_terms(F.col("wording")))))
    # a term that no passage holds is as rare as can be
    own = stage(own.join(rarity, "term", "left").select(
        "template", "term", (F.col("tf") * F.coalesce("idf", F.log(1 + total) + 1)).alias("weight")
    ))
    lengths = own.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    scaled = own.join(lengths, "template").groupBy("term").agg(
        F.map_from_entries(F.collect_list(F.struct("template", F.col("weight") / F.col("length")))).alias("of")
    )
    # as many rows as the templates have terms
    vectors = F.broadcast(scaled)

    weighted = lookup_join(terms, rarity, ["term"]).select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    known = weighted.join(vectors, "term", "left")
    dots = [
        F.sum(F.col("w") * F.coalesce(F.try_element_at("of", F.lit(i)), F.lit(0.0))).alias(f"dot{i}")
        for i in range(len(templates))
    ]
    sums = known.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
    ranked = F.array(*[
        F.struct((-F.round(F.col(f"dot{i}") / F.col("norm"), 6)).alias("minus"), F.lit(name).alias("license"))
        for i, (name, _) in enumerate(templates)
    ])
    best = sums.select("id", F.array_min(ranked).alias("best")).where(F.col("best.minus") < 0)
    closest = best.select("id", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"))
    return numbered.select("id", "path", "line").join(closest, "id").select("path", "line", "license", "score")


def inherited(directories: DataFrame, speaking: DataFrame) -> DataFrame:
    """``directory, from_directory, license`` for directories at or below one of
    ``speaking (at, license)``; the nearest counts."""
    parts = F.split("directory", "/")
    # every ancestor, the root and the directory itself
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    ancestors = directories.select("directory", F.explode(F.array_distinct(above)).alias("at"))
    reached = lookup_join(ancestors, speaking, ["at"]).select("directory", "at", "license", F.length("at").alias("depth"))
    nearest = reached.groupBy("directory").agg(F.max(F.struct("depth", "at", "license")).alias("n"))
    return nearest.select("directory", F.col("n.at").alias("from_directory"), F.col("n.license").alias("license"))


def scan(files: DataFrame, key: str, path: Column, text: str = "text") -> DataFrame:
    """Per row: key, path, ``own_license`` with its ``score``, and ``license``
    with the directory it was inherited from, if it was."""
    given = files.select(files[f"`{key}`"].alias("key"), path.alias("path"), files[f"`{text}`"].alias("text"))
    close = similarities(passages(given.select("path", "text"))).where(F.col("score") >= THRESHOLD)
    order = F.struct((-F.col("score")).alias("minus"), F.col("license"))
    own = close.groupBy("path").agg(F.min(order).alias("best"))
    own = stage(own.select("path", F.col("best.license").alias("own_license"), (-F.col("best.minus")).alias("score")))
    named = own.where(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE))
    speaking = named.withColumn("at", directory_of(F.col("path"))).groupBy("at").agg(
        F.min(F.struct((-F.col("score")).alias("minus"), F.col("own_license").alias("license"))).alias("best")
    ).select("at", F.col("best.license").alias("license"))
    rows = stage(given.select("key", "path", directory_of(F.col("path")).alias("directory")))
    resolved = inherited(rows.select("directory").where(F.col("directory").isNotNull()).distinct(), speaking)
    joined = lookup_join(lookup_join(rows, own, ["path"], "left", staged=True), resolved, ["directory"], "left")
    taken = F.col("own_license").isNull()
    return joined.select(
        F.col("key").alias(key),
        "path",
        "own_license",
        "score",
        F.coalesce("own_license", "license").alias("license"),
        F.when(taken, F.col("from_directory")).alias("inherited_from"),
    )
