import numpy as np
import pytest

import __spark_entry__ as entry
from corpusloom.llm import hard_negatives as hn
from odd_documents import TESTDATA

NAN, INF = float("nan"), float("inf")


def brute(rows, is_anchor):
    """All output rows by integer arithmetic; rows are (id, label, vector)."""
    kept = [
        (i, label, [int(np.floor(256 * float(c))) for c in v])
        for i, label, v in rows
        if label is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)
    ]
    first = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for at, (i, label, x) in enumerate(kept):
        if i is None or not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(x, y)), j, other == label) for k, (j, other, y) in enumerate(kept) if k != at]
        for score, positive, _ in sorted((s for s in scored if s[2]), key=first)[:5]:
            fit = [s for s in scored if not s[2] and 30 * score <= 100 * s[0] <= 90 * score]
            for rank, s in enumerate(sorted(fit, key=first)[:10], 1):
                out.append((i, positive, rank, s[1], score, s[0]))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark):
    sf_dir = str(TESTDATA / "sf0.01")
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["label"] if r["vec_id"] % 7 else (r["label"] + 1) % 10, r["embedding"]) for r in table]
    got = entry.queries()["op12_hard_negatives"](spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("dims", [1, 5, 70])
def test_intervals_hold_every_score(dims):
    rng = np.random.default_rng(dims)
    x = np.floor(256 * rng.normal(size=(300, dims)) ** 3).astype(np.int64)
    x[7] = 0
    low, high = hn.intervals(x[:40], hn.encode(x))
    exact = np.stack([hn.scores(x, a) for a in x[:40]])
    assert (exact == x[:40] @ x.T).all()
    assert (low <= exact).all() and (exact <= high).all()


def test_intervals_leave_most_rows_out():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    low, high = hn.intervals(x[:10], hn.encode(x))
    for a in range(10):
        assert (high[a] >= hn.nth_largest(low[a], 10)).sum() < 0.1 * len(x)


def test_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), [float(c) for c in rng.normal(size=6)]) for i in range(120)]
    rows += [(200, 1, None), (201, None, [1.0] * 6), (202, 1, [NAN] * 6), (203, 2, [INF] + [0.0] * 5), (204, 0, [1.0, None])]
    rows += [(205, 0, [1.0, 2.0]), (206, 1, []), (None, 1, rows[10][2]), rows[20], rows[20], rows[30]]
    rows += [(300 + i, 2, rows[40][2]) for i in range(30)]
    df = spark.createDataFrame([(*r, "u", 1) for r in rows], "vec_id bigint, label int, embedding array<double>, uid string, g int")
    monkeypatch.setattr(hn, "ENTRIES", 640)  # several groups and blocks
    got = hn.mine(df.repartition(4), lambda i: i % 10 == 0).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, lambda i: i % 10 == 0)


def test_empty(spark):
    for rows in ([], [(0, 1, None)], [(0, 1, [1.0])]):
        got = hn.mine(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>"), lambda i: i % 10 == 0)
        assert got.collect() == []
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
