import numpy as np
import pytest

from quakeframe.llm import op11_whitening as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """{vec_id: whitened by component}, n, deviations and explained shares, by a dense solver."""
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1000000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = np.array([[n * c - s for c, s in zip(r, sums, strict=True)] for r in x], float) / n
    v = d.T @ d / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    keep = e > 1e-9 * e[0]
    e, u = e[keep][:32], u[:, keep][:, :32]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    return [i for i, _ in good], d @ u / np.sqrt(e), n, deviations, e / np.trace(v)


def check(spark, rows):
    got = op.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)).collect()
    ids, w, n, deviations, explained = brute(rows)
    k = w.shape[1]
    assert len(got) == len(ids) * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    mine = np.array([[by[i][c].whitened for c in range(1, k + 1)] for i in ids])
    sign = np.sign((mine * w).sum(0))
    assert np.abs(mine * sign - w).max() < 1e-7
    for i, dev in zip(ids, deviations, strict=True):
        for c in range(1, k + 1):
            r = by[i][c]
            assert r.n == n and r.deviation == dev and abs(r.explained / explained[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def test_against_dense_solver(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 40)) * np.linspace(2, 0.2, 40)
    check(spark, [(k, [float(c) for c in v]) for k, v in enumerate(base)])


def test_nulls_and_odd_entries(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(rng.normal(size=(60, 6)) + 3)]
    rows += [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (102, [float("nan")] * 6), (103, [float("inf")] + [0.0] * 5), (104, [])]
    check(spark, rows)


def test_constant_and_copied_dimensions_have_no_component(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(a), float(a), 7.0, float(b)]) for k, (a, b) in enumerate(rng.normal(size=(50, 2)))]
    got = op.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9


def test_small_tables_repeated_rows_and_lengths(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert op.whiten(make([])).count() == 0
    assert op.whiten(make([(1, [1.0, 2.0])])).count() == 0
    assert op.whiten(make([(1, [1.0, 2.0])] * 3)).count() == 0
    got = op.whiten(make([(None, [0.0, 1.0]), (None, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [5.0]), (4, [7.0]), (5, [6.0])])).collect()
    assert sorted((r.n, r.component) for r in got) == [(3, 1)] * 6
    two = [r for r in got if r.vec_id in (None, 2)]
    assert [r.deviation for r in two if r.vec_id == 2] == [(3 * 64 - 64) ** 2]


def test_huge_entries(spark):
    rows = [(k, [float(k), 1e30 if k % 2 else -1e30]) for k in range(8)]
    got = op.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert {r.n for r in got} == {8} and {r.deviation for r in got} == {None} and np.isfinite([r.whitened for r in got]).all()


@pytest.mark.parametrize("seed", range(6))
def test_counts_and_components(seed):
    """Inertia counts and the numbering with well separated, close and equal eigenvalues."""
    rng = np.random.default_rng(seed)
    d = [1, 2, 5, 20, 40, 64][seed]
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    e = np.sort(np.concatenate([rng.uniform(0, 5, d - d // 2), np.repeat([3.0, 3.0 + 1e-9, 2.0], 99)[: d // 2]]))[::-1]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    for s in rng.uniform(-1, 6, 20):
        assert op.above(a, s) == (np.linalg.eigvalsh(a) > s).sum()
    values, vectors = op.leading(a, 32)
    assert len(values) == min(32, d) and np.abs(values - e[: len(values)]).max() < 1e-12
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-9
    assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-11


def test_pivots_of_two():
    assert op.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert op.above(np.zeros((3, 3)), 0.0) == 0
    assert op.above(np.array([[0.0, 2.0, 0.0], [2.0, 0.0, 1.0], [0.0, 1.0, 0.0]]), 0.1) == 1


def test_whole_table(spark):
    import pandas as pd

    dir_ = "/root/testdata/sf0.001"
    got = op.op11_whitening(spark, dir_).toPandas()
    e = spark.read.parquet(f"{dir_}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(e["embedding"].to_list()).astype(float))
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / len(c))
    want = (c @ vectors / np.sqrt(values))[:, ::-1][:, :32]
    mine = got.pivot(index="vec_id", columns="component", values="whitened").loc[e["vec_id"]].to_numpy()
    assert np.abs(mine * np.sign((mine * want).sum(0)) - want).max() < 1e-7
    assert isinstance(got, pd.DataFrame) and got["identity_error"].max() < 1e-4
