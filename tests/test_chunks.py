"""Series in chunks against the whole series, and long arrays against the plain recursion."""

import random
import time

import numpy as np
import pytest

from quakeframe.functions import kernels
from quakeframe.operators import picking as P


def recursion(sections, x):
    """Sample by sample."""
    y = np.array(x, float)
    for b0, b1, b2, _, a1, a2 in sections:
        z1 = z2 = 0.0
        for t, v in enumerate(y):
            o = b0 * v + z1
            z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
            y[t] = o
    return y


SECTIONS = kernels.bandpass_sections(1.0, 17.0, 100.0, 2)


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 1000, 5000])
def test_blocks_give_the_recursion(n):
    x = np.random.default_rng(n).normal(size=(2, n)) * 1000 + 5
    y, state = kernels.sections_run(SECTIONS, x)
    assert y.shape == x.shape and all(np.abs(a - recursion(SECTIONS, b)).max(initial=0) < 1e-9 for a, b in zip(y, x, strict=True))
    z, _ = kernels.sections_run(SECTIONS, np.ones((2, 10)), state)
    assert np.abs(z[0] - recursion(SECTIONS, np.concatenate([x[0], np.ones(10)]))[n:]).max() < 1e-9


def test_a_day_at_100_hz():
    """8,640,000 samples: in seconds, and equal to the recursion to 1e-9."""
    x = np.random.default_rng(0).normal(size=8_640_000)
    started = time.time()
    y, _ = kernels.sections_run(SECTIONS, x)
    assert time.time() - started < 60
    v = x.tolist()
    for b0, b1, b2, _, a1, a2 in SECTIONS.tolist():
        z1 = z2 = 0.0
        out = []
        for s in v:
            o = b0 * s + z1
            z1, z2 = b1 * s - a1 * o + z2, b2 * s - a2 * o
            out.append(o)
        v = out
    assert np.abs(y - np.array(v)).max() < 1e-9


def cuts(rng, n):
    at = sorted(rng.sample(range(n + 1), min(rng.randint(0, 12), n + 1)))
    return [0, *at, n]


def test_any_cut_gives_the_picks_of_the_whole(spark):
    """The 100-sample rule included: probabilities stay between the thresholds for long."""
    rng, rows, want = random.Random(4), [], {}
    for k in range(60):
        n, p, level = rng.choice([0, 1, 50, 400, 1500]), [], 0.0
        for _ in range(n):
            if rng.random() < 0.03:
                level = rng.choice([0.0, 0.27, 0.29, 0.35, 0.6, 0.9])
            p.append(min(1.0, max(0.0, level + rng.uniform(-0.02, 0.02))))
        want[k] = kernels.extract(np.array(p), 0.3, 0.05)
        c = cuts(rng, n)
        rows += [(k, j, p[a:b]) for j, (a, b) in enumerate(zip(c, c[1:], strict=False))]
    rows.append((60, 0, None))
    want[60] = []
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "series int, chunk int, p array<double>").repartition(5)
    got = {r.series: [(k["index"], k["width"], k["probability"]) for k in r.picks] for r in P.extract_picks_chunks(df, ["series"], "chunk", "p", 0.3).collect()}
    assert got == want and any(w > 100 for picks in want.values() for _, w, _ in picks)


def test_processing_of_chunks_is_that_of_the_whole(spark):
    rng = np.random.default_rng(5)
    whole = {k: rng.normal(size=n) * 100 + np.arange(n) for k, n in enumerate([700, 3000, 100])}
    rows = [(k, j, v[a : a + 333].tolist()) for k, v in whole.items() for j, a in enumerate(range(0, len(v), 333))]
    df = spark.createDataFrame(rows, "series int, chunk int, x array<double>")
    got = {}
    for r in P.processed_chunks(df.repartition(4), ["series"], "chunk", "x").orderBy("chunk").collect():
        got.setdefault(r.series, []).extend(r.x)
    one = spark.createDataFrame([(k, v.tolist()) for k, v in whole.items()], "series int, x array<double>")
    for r in P.processed(one, "x").collect():
        assert np.abs(np.array(r.x) - np.array(got[r.series])).max() < 1e-8


def test_ratio_and_triggers():
    rng = np.random.default_rng(6)
    x = rng.normal(size=500) * np.where((np.arange(500) // 60) % 3 == 1, 5, 1)
    r = kernels.window_ratio(x, 7, 50)
    plain = [np.nan if t < 49 else (x[t - 6 : t + 1] ** 2).mean() / (x[t - 49 : t + 1] ** 2).mean() for t in range(500)]
    assert np.allclose(r, plain, equal_nan=True)
    got, run, begin = [], False, None
    for t, q in enumerate([*r, np.nan]):
        if not q >= 0.7:
            if begin is not None:
                got.append((begin, t - 1))
            begin = None
        elif begin is None and q >= 1.5:
            begin = t
    assert kernels.triggers(r, 1.5, 0.7) == got and got and run is False
    assert kernels.triggers(np.array([]), 1.5, 0.7) == [] and np.isnan(kernels.window_ratio(np.zeros(60), 5, 50)).all()


def test_chunks_of_a_ratio(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3, 400))
    df = spark.createDataFrame([(k, j, x[k, j * 100 : j * 100 + 100].tolist()) for k in range(3) for j in range(4)], "series int, chunk int, x array<double>")
    got = P.sta_lta_arrays(df, "x", 5, 80, keys=["series"], order="chunk").orderBy("series", "chunk").collect()
    for k in range(3):
        mine = np.array([np.nan if q is None else q for r in got if r.series == k for q in r.ratio])
        assert np.allclose(mine, kernels.window_ratio(x[k], 5, 80), equal_nan=True)
    assert "Window" not in P.sta_lta_arrays(df, "x", 5, 80, keys=["series"], order="chunk")._jdf.queryExecution().toString()
