import math
import random
import re
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from corpusloom.llm import mixing
from odd_documents import TESTDATA, none, odd  # noqa: F401


def brute_targets(sizes):
    """Share, cap, reshare the excess, until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = float(sum(sizes.values()))
    capped = {}
    while True:
        open_ = [s for s in order if s not in capped]
        rest, weights = total - sum(capped.values()), sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / weights for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in above}


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(result, rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    targets = brute_targets(sizes)
    expected = sorted([(i, size(t), sizes[s], round(targets[s], 6)) for i, t, s in rows], key=repr)
    got = [tuple(r) for r in result.select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted([(*r[:3], round(r[3], 6)) for r in got], key=repr) == expected
    taken, longest = defaultdict(int), defaultdict(int)
    for _, n, source_size, target, words in got:
        assert words <= 3 * n and (n == 0 or words % n == 0)
        # complete epochs come first
        if source_size:
            full = math.floor(target / source_size)
            assert words in (full * n, (full + 1) * n)
        taken[source_size, target] += words
        longest[source_size, target] = max(longest[source_size, target], n)
    sources = defaultdict(set)
    for s in sizes:
        sources[sizes[s], targets[s]].add(s)
    for (source_size, target), words in taken.items():
        if len(sources[source_size, target]) == 1:
            assert abs(words - target) <= longest[source_size, target]


def test_mix_of_odd_rows(odd):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    check(mixing.mix(odd), rows)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query(spark, scale):
    sf_dir = str(TESTDATA / scale)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(entry.queries()["op6_mixing"](spark, sf_dir), [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])


def test_reruns_agree_on_other_partitions(odd):
    first, second = (sorted(map(tuple, mixing.mix(odd.repartition(n)).collect()), key=repr) for n in (1, 7))
    assert first == second


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 7}, {"a": 0, "b": 0}, {"x": 4}, {"a": 1, "b": 0, "c": 900}])
def test_water_level(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_better_documents_come_first(spark):
    rows = [(i, "word " * 20 if i % 2 else "|a| |b| |c| |d| " * 5, "one") for i in range(2000)]
    rows += [(10_000 + i, "word " * 20, "two") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).where("source_size = 40000 and size = 20").collect()}
    del taken
    second = mixing.mix(docs).where("source_size = 80000").collect()
    assert 0 < sum(r["taken"] > 0 for r in second) < 4000


def test_mixed_repeats_rows(odd):
    copies = mixing.mixed(odd)
    assert copies.columns == odd.columns
    drawn = {(r["key"], r["digest"]): 0 for r in mixing.draw(odd).collect()}
    assert sum(r["epochs"] for r in mixing.draw(odd).collect()) == copies.count()
    assert drawn


def test_empty_table(none):
    assert mixing.mix(none).count() == 0
    assert mixing.mixed(none).columns == none.columns


def test_no_cell_is_large_whatever_the_quality(spark):
    """A source of pure markup: the cell at the edge of the budget is small."""
    for text in ("# * | # * |", "plain words only", "one sign # here"):
        rows = spark.range(60_000).selectExpr("id AS doc_id", f"'{text}' AS text", "'s' AS source")
        cells = mixing._narrow(rows, "doc_id", "text", "source", 6).groupBy("cell").count()
        assert cells.agg({"count": "max"}).first()[0] <= 60_000 * 0.001


def test_the_documents_with_the_smallest_keys_are_taken(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randint(1, 9) + ["#"] * rng.randint(0, 4)), rng.choice(["a", "b", "c"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    keys = {r["key"]: r for r in mixing._narrow(df, "doc_id", "text", "source", 6).collect()}
    drawn = {r["key"]: r for r in mixing.draw(df).collect()}
    for source in "abc":
        mine = sorted((k for k, r in keys.items() if r["source"] == source), key=lambda k: keys[k]["draw"])
        first = drawn[mine[0]]
        full = int(first["target"] // first["source_size"])
        rest = first["target"] - full * first["source_size"]
        before = 0
        for k in mine:
            taken = full + (before + keys[k]["size"] / 2 <= rest and before <= rest)
            assert drawn[k]["epochs"] == taken, (source, k)
            before += keys[k]["size"]
