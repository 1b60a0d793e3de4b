import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import licenses
from odd_documents import none, odd  # noqa: F401

TREE = [
    (1, "LICENSE", "Released under the MIT License."),
    (2, "a/b/c.py", "import x\n# Licensed under the Apache License, Version 2.0.\n"),
    (3, "a/b/d.py", "nothing here"),
    (4, "a/COPYING", "This work is licensed under the GNU General Public License, version 3.\n"),
    (5, "a/b/e/f.py", "print('driving licences of the region are not a notice about this text at all')"),
    (6, "other/g.py", ""),
    (7, "ab/h.py", None),
    (8, None, "All rights reserved."),
    (9, "a/b/LICENSE.txt", "some words that are no notice"),
    (10, "a/b/c.py", "the same path again"),
    (11, "top.py", "x"),
]


@pytest.fixture
def tree(spark):
    return spark.createDataFrame(TREE, "id int, path string, text string")


def test_tree(tree):
    got = {r["id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in licenses.scan(tree, "id", F.col("path")).collect()}
    assert got == {
        1: ("MIT", "MIT", None),
        2: ("Apache-2.0", "Apache-2.0", None),
        3: (None, "GPL-3.0", "a"),
        4: ("GPL-3.0", "GPL-3.0", None),
        5: (None, "GPL-3.0", "a"),
        6: (None, "MIT", ""),
        7: (None, "MIT", ""),
        8: (None, None, None),
        9: (None, "GPL-3.0", "a"),
        10: ("Apache-2.0", "Apache-2.0", None),
        11: (None, "MIT", ""),
    }


WRAPPED = """#!/usr/bin/env python
# Copyright 2020 somebody
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with
# the License.
import x
"""


def test_licences_as_they_stand_in_files(spark):
    """A whole licence file, a wrapped header, SPDX lines, and what is none."""
    bodies = dict(licenses.BODIES)
    wrap = lambda text: "\n".join(re.findall(r".{1,70}(?: |$)", text))
    files = [
        ("m/LICENSE", "MIT License\n\nCopyright (c) 2021 Jane Doe\n\n" + wrap(bodies["MIT"])),
        ("b/LICENSE.md", "Copyright 2019, The Authors\n\n" + wrap(bodies["BSD"])),
        ("i/COPYING", wrap(bodies["ISC"])),
        ("w/a.py", WRAPPED),
        ("w/b.c", "/* SPDX-License-Identifier: GPL-2.0-only */\nint x;"),
        ("w/c.rs", "// SPDX-License-Identifier: MIT\nfn main() {}"),
        ("w/d.rs", "// SPDX-License-Identifier: My-Own-1.0\nfn main() {}"),
        ("w/e.py", "# the driver's licence\n# of the region\n# is checked here\nprint()"),
        ("w/f.py", "# x\n" * 30_000 + "# All rights reserved."),
    ]
    files += [(f"z/{i}.txt", f"a copyright line number {i} with other words {i * 7}") for i in range(40)]
    df = spark.createDataFrame(files, "path string, text string")
    got = {r["path"]: r["own_license"] for r in licenses.scan(df, "path", F.col("path")).collect()}
    assert {p: got[p] for p, _ in files[:9]} == {
        "m/LICENSE": "MIT", "b/LICENSE.md": "BSD", "i/COPYING": "ISC", "w/a.py": "Apache-2.0", "w/b.c": "GPL-2.0",
        "w/c.rs": "MIT", "w/d.rs": None, "w/e.py": None, "w/f.py": "proprietary",
    }
    assert not any(got[p] for p, _ in files[9:])


def test_one_directory_of_half_the_files(spark, monkeypatch):
    from corpusloom.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    files = [("LICENSE", "Released under the MIT License.")] + [(f"a/b/{i}.py", "x") for i in range(600)]
    files += [(f"d{i}/x.py", "All rights reserved.") for i in range(600)]
    rows = licenses.scan(spark.createDataFrame(files, "path string, text string"), "path", F.col("path")).collect()
    assert sum(r["license"] == "MIT" and r["inherited_from"] == "" for r in rows) == 600
    assert sum(r["own_license"] == "proprietary" for r in rows) == 600


def test_scores_equal_brute_force(spark):
    lines = [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0.",
        "licensed to you under the apache license version 2.0 and more words",
        "Copyright 2020 somebody. All rights reserved.",
        "licence",
    ]
    found = spark.createDataFrame([(f"p{i}", 0, t) for i, t in enumerate(lines)], "path string, line int, text string")
    term = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
    bags = [Counter(term.findall(t.lower())) for t in lines]
    df = Counter(t for b in bags for t in b)
    idf = lambda t: math.log((1 + len(lines)) / (1 + df[t])) + 1

    def cosine(a, b):
        va, vb = ({t: n * idf(t) for t, n in x.items()} for x in (a, b))
        dot = sum(va[t] * vb[t] for t in va.keys() & vb.keys())
        return dot / math.sqrt(sum(x * x for x in va.values())) / math.sqrt(sum(x * x for x in vb.values()))

    expected = {}
    for i, bag in enumerate(bags):
        scores = [(-round(cosine(bag, Counter(term.findall(t.lower()))), 6), n) for n, t in licenses.TEMPLATES]
        least = min(s for s in scores if s[0])if any(s[0] for s in scores) else None
        if least:
            expected[f"p{i}"] = (least[1], -least[0])
    got = {r["path"]: (r["license"], r["score"]) for r in licenses.similarities(found).collect()}
    assert got.keys() == expected.keys()
    for path, (name, score) in expected.items():
        assert got[path] == (name, pytest.approx(score, abs=2e-6))


def test_odd_rows_and_empty_table(odd, none):
    path = F.concat_ws("/", "source", F.col("key").cast("string"))
    assert licenses.scan(odd, "doc_id", path).count() == odd.count()
    assert licenses.scan(none, "doc_id", path).count() == 0
