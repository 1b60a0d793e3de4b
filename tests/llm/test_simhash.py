import random
import re
from itertools import combinations

import numpy as np
import xxhash

import __spark_entry__ as entry
from corpusloom.llm import simhash
from odd_documents import TESTDATA, none, odd  # noqa: F401


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(codes, bits=2):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= bits:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {c: find(c) for c in root}


def brute_groups(rows):
    codes = [brute_fingerprint(t) for _, t in rows]
    roots = brute_roots(set(codes))
    least = {}
    for (key, _), code in zip(rows, codes):
        if key is not None:
            least[roots[code]] = min(key, least.get(roots[code], key))
    return sorted([(k, f"{c:016x}", least.get(roots[c])) for (k, _), c in zip(rows, codes)], key=repr)


def as_rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_groups_equal_brute_force(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert as_rows(simhash.groups(odd)) == brute_groups(rows)


def test_query_equals_brute_force(spark):
    sf_dir = str(TESTDATA / "sf0.01")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert as_rows(entry.queries()["op7_simhash"](spark, sf_dir)) == brute_groups(rows)


def test_links_in_dense_neighbourhoods(spark, monkeypatch):
    # hot cells over many parts: codes a few flips away from a few centres
    monkeypatch.setattr(simhash, "PART_ROWS", 150)
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(3)] + [0, 2**64 - 1]
    codes = set()
    for _ in range(1500):
        code = rng.choice(centres)
        for _ in range(rng.randint(0, 7)):
            code ^= 1 << rng.choice([0, 3, 20, 21, 22, 40, 42, 43, 44, 60, 62, 63, *range(5, 15)])
        codes.add(code)
    codes |= {rng.getrandbits(64) for _ in range(500)}
    signed = [(c - 2**64 if c >= 2**63 else c,) for c in codes]
    frame = spark.createDataFrame(signed, "fp bigint")
    tree = {r["node"] % 2**64: r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    ours = {c: tree.get(c, c - 2**64 if c >= 2**63 else c) for c in codes}
    theirs = brute_roots(codes)
    same = {}
    for c in codes:
        assert same.setdefault(ours[c], theirs[c]) == theirs[c]
    assert len(set(ours.values())) == len(set(theirs.values()))


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5)]
    found = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert found == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1300)}


def test_tree_search_has_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) for b in range(0, 40, 2)]))
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    codes = codes[np.argsort(rank)]
    got = {(int(a), int(b)) for q, m in simhash.links_in(codes, codes[:0], 2) for a, b in zip(codes[q], codes[m])}
    low = 2**43 - 1
    expected = {
        (int(a), int(b))
        for i, a in enumerate(codes)
        for b in codes[i + 1 :]
        if (int(a) ^ int(b)).bit_count() <= 2 and (int(a) ^ int(b)) <= low
    }
    assert got == expected


def test_keep_first_leaves_one_of_each_group(odd):
    rows = odd.collect()
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    codes = [brute_fingerprint(r["text"]) for r in rows]
    roots = brute_roots(set(codes))
    kept = kept.collect()
    assert len(kept) == len(set(roots.values()))
    best = {}
    for r, c in zip(rows, codes):
        if r["doc_id"] is not None:
            best[roots[c]] = min(r["doc_id"], best.get(roots[c], r["doc_id"]))
    for r in kept:
        assert r["doc_id"] == best.get(roots[brute_fingerprint(r["text"])])


def test_empty_table(none):
    assert simhash.groups(none).count() == 0
    assert simhash.keep_first(none).count() == 0
