import numpy as np
import pytest

from quakeframe.llm import op10_topk as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, v in ok:
        if q % 50 == 0:
            best = sorted(((int(v @ w), i) for i, w in ok if i != q and len(w) == len(v)), key=lambda x: (-x[0], x[1]))[:k]
            out[q] = [(r + 1, i, s) for r, (s, i) in enumerate(best)]
    return out


def check(rows, got):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(v) for q, v in by.items()} == {q: v for q, v in brute(rows).items() if v}


@pytest.mark.parametrize("clustered", [False, True])
def test_against_all_pairs(spark, monkeypatch, clustered):
    monkeypatch.setattr(op, "BLOCK", 40)
    monkeypatch.setattr(op, "QUERY_CHUNK", 3)
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=8) + (8 * np.eye(8)[k // 75] if clustered else 0)).tolist(), 0) for k in range(600)]
    rows += [(700 + k, rows[100][1], 0) for k in range(30)]
    check(rows, op.top_k(spark.createDataFrame(rows, SCHEMA), lambda v: v % 50 == 0).collect())


def test_bands_visit_fewer_blocks_than_one_pass(spark, monkeypatch):
    """With two bands the blocks after the first are all held against its threshold alone."""
    monkeypatch.setattr(op, "BLOCK", 20)
    monkeypatch.setattr(op, "PAGE_PARTS", 2)
    rng = np.random.default_rng(8)
    rows = []
    for k in range(1200):  # clusters along consecutive ids; each has one far member, which lifts its block's bounds
        far = 6.0 if k % 20 == 7 else 1.0
        rows.append((k, (far * (2 * np.eye(12)[k // 100] + 0.6 * rng.random(12))).tolist(), 0))
    df = spark.createDataFrame(rows, SCHEMA)
    counts = {}
    for bands in (2, 4):
        monkeypatch.setattr(op, "BANDS", bands)
        counts[bands] = []
        check(rows, op.top_k(df, lambda v: v % 50 == 0, visits=counts[bands]).collect())
    assert counts[4][0] == counts[2][0] == 24 and sum(counts[4]) < sum(counts[2]) < 24 * 60
    print(counts)


def test_lengths_are_kept_apart(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=1 + k % 3).tolist(), 0) for k in range(400)] + [(200, [1.0, 2.0, 3.0, 4.0], 0), (1000, [1e6, -1e6], 0), (1050, [3e7, 5.0], 0)]
    got = op.top_k(spark.createDataFrame([r for r in rows if r[0] != 200 or len(r[1]) < 4], SCHEMA), lambda v: v % 50 == 0).collect()
    check([r for r in rows if r[0] != 200 or len(r[1]) < 4], got)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 0), (50, None, 0), (1, [], 0), (2, [1.0, None], 0), (3, [float("nan"), 1.0], 0), (4, [float("inf"), 1.0], 0), (5, [0.5, -0.001], 0), (6, [1.0, 2.0], 0), (None, [1.0, 1.0], 0), (100, [-1.0, 0.0], 0)]
    check(rows, op.top_k(spark.createDataFrame(rows, SCHEMA), lambda v: v % 50 == 0).collect())
    assert op.top_k(spark.createDataFrame([], SCHEMA), lambda v: v % 50 == 0).collect() == []
    assert op.top_k(spark.createDataFrame(rows[:1], SCHEMA), lambda v: v % 50 == 0).collect() == []


def test_huge_components(spark, monkeypatch):
    """Scores beyond a long are held at the limit; sums that cancel are exact."""
    monkeypatch.setattr(op, "BLOCK", 3)
    big = float(np.float32(1e10))
    rows = [(0, [big, big], 0), (1, [big, big], 0), (2, [big, -big], 0), (3, [1.0, 1.0], 0), (4, [-big, -big], 0), (5, [0.0, 0.0], 0), (50, [1.0, 2.0], 0), (51, [3e38, 3e38], 0)]
    got = op.top_k(spark.createDataFrame(rows, SCHEMA), lambda v: v % 50 == 0).collect()
    by = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50)}
    b = 256 * int(big)
    held = lambda x: max(-op.LIMIT, min(op.LIMIT, x))
    assert by[0] == [(1, op.LIMIT), (51, op.LIMIT), (50, held(3 * 256 * b)), (3, held(2 * 256 * b)), (2, 0)]
    assert by[50] == [(51, op.LIMIT), (0, held(3 * 256 * b)), (1, held(3 * 256 * b)), (3, 3 * 65536), (5, 0)]
